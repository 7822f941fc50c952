"""Line differences of two texts, as a column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGES = T.StructType([T.StructField("added", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("diff", T.ArrayType(T.StringType()))])


def line_changes(old: Column, new: Column, context: int = 1, most: int = 200) -> Column:
    """Struct (added, removed, diff) from the old text to the new one.

    Lines are matched in order, by the longest block that both have and then left and right of
    it. added and removed count lines, but for those that look like a diff's own head (`++` or
    `--` at their start); diff is a unified diff of `context` lines around each change, its first
    `most` lines. Without an old text all lines are added and there is no diff; a null new text is
    empty. A row is compared by itself, so memory is that of its two texts."""

    @F.arrow_udf(CHANGES)
    def changes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import difflib
        import itertools

        def one(a, b):
            b = b or ""
            if a is None:
                return {"added": b.count("\n") + 1, "removed": 0, "diff": []}
            a, b = a.splitlines(), b.splitlines()
            added = removed = 0
            for kind, i, i_end, j, j_end in difflib.SequenceMatcher(None, a, b).get_opcodes():
                if kind != "equal":
                    removed += sum(not x.startswith("--") for x in a[i:i_end])
                    added += sum(not x.startswith("++") for x in b[j:j_end])
            diff = [] if a == b else list(itertools.islice(difflib.unified_diff(a, b, lineterm="", n=context), most))
            return {"added": added, "removed": removed, "diff": diff}

        kind = pa.struct([("added", pa.int64()), ("removed", pa.int64()), ("diff", pa.list_(pa.string()))])
        for olds, news in batches:
            yield pa.array([one(a.as_py(), b.as_py()) for a, b in zip(olds, news, strict=True)], kind)

    return changes(old.cast("string"), new.cast("string"))
