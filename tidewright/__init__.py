"""Tidewright: operational analytics over DataFrames, declared for Catalyst."""

__version__ = "0.1.0"
