"""Shared pieces of the training-data operators."""

from __future__ import annotations

import functools
import importlib
import inspect
import sys
import uuid
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import ensure_checkpoint_dir

#: ASCII white space that separates words: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


def travels(module: str) -> None:
    """Send this module's functions to the executors by value, so that they need no copy of the
    library in a local folder."""
    cloudpickle.register_pickle_by_value(sys.modules.get(module) or importlib.import_module(module))


def words(text: Column | str) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def n_words(text: Column | str) -> Column:
    """How many words a text has, without keeping them (long)."""
    c = F.col(text) if isinstance(text, str) else text
    inner = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, "[ \\t-\\r]+"))).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shielded(columns: Sequence[str], outs: Sequence[str] = ()) -> Callable:
    """Decorator for operators on a table: no column of it can clash with theirs.

    The operator's first argument comes to it with columns renamed, and the arguments named in
    `columns` with them; its result gets the old names back. `outs` are columns that it adds:
    arguments that hold their names, or the names themselves. A column of the table that is
    named like one of them is replaced; case does not tell names apart."""

    def wrap(f: Callable) -> Callable:
        signature = inspect.signature(f)

        @functools.wraps(f)
        def run(*args, **kwargs) -> DataFrame:
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            first, docs = next(iter(bound.arguments.items()))
            inner = [f"tw_in_{i}" for i in range(len(docs.columns))]
            at = dict(zip(reversed(docs.columns), reversed(inner), strict=True))
            bound.arguments[first] = docs.toDF(*inner)
            for p in columns:
                if bound.arguments[p] is not None:
                    bound.arguments[p] = at[bound.arguments[p]]
            added = []
            for o in outs:
                name, own = bound.arguments.get(o, o), f"tw_out_{o}" if o in bound.arguments else o
                if o in bound.arguments:
                    bound.arguments[o] = own
                added.append((own, name))
            result, taken = f(*bound.args, **bound.kwargs), {name.lower() for _, name in added}
            kept = [(i, n) for i, n in zip(inner, docs.columns, strict=True) if n.lower() not in taken]
            return result.select(*(F.col(i).alias(n) for i, n in [*kept, *added]))

        return run

    return wrap


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, which goes when the application ends:
    its lineage ends, an executor that is lost later costs no recomputation, and Spark can
    split what is read from it. A frame is computed once, where a checkpoint computes it twice."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
