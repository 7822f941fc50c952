"""Sinks: append-only versions, edges by type, search tables behind a pointer, pages as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_versions(rows: DataFrame, path: str, run_id: str) -> None:
    """Append only what an upsert says is not unchanged, under its run's partition."""
    rows.where("action <> 'unchanged'").drop("action").withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def overwrite_edges(edges: DataFrame, path: str) -> None:
    """Replace the edges of the source types that the load has; other types stay."""
    kind = F.substring_index("src", ":", 1)
    edges.withColumn("src_type", kind).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("src_type").parquet(path)


def publish(df: DataFrame, base: str, version: str, pointer: str) -> str:
    """Write a version of a table next to the others, then let the pointer name it: readers see
    the old one or the new one, never a half."""
    path = f"{base}/{version}"
    df.write.parquet(path)
    df.sparkSession.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(pointer)
    return path


def published(spark: SparkSession, pointer: str) -> DataFrame:
    """The version that the pointer names."""
    return spark.read.parquet(spark.read.schema("path string").json(pointer).first()["path"])


def front_matter(fields: Mapping[str, Column], body: Column) -> Column:
    """A page: a YAML block of string fields, nulls left out, and the body."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f'{k}: "'), F.replace(c.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"\n'))).otherwise("") for k, c in fields.items()]
    return F.concat(F.lit("---\n"), *lines, F.lit("---\n"), body)


def page(title: Column, sections: Mapping[str, Column]) -> Column:
    """A Markdown page: a title and `## ` sections of bullet lists (arrays); empty ones are left
    out."""
    parts = [F.when(F.size(c) > 0, F.concat(F.lit(f"\n## {k}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x.cast("string"))), "\n"), F.lit("\n"))).otherwise("") for k, c in sections.items()]
    return F.concat(F.lit("# "), title, F.lit("\n"), *parts)
