"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt to shards. A shard keeps its vectors and, per dimension, the list of them sorted
by that component. For a query the lists are read side by side, each from the end that its
weight favours; what turns up is scored in full; the bound for all that has not turned up is
the score of a vector made of the values last read. Reading stops when the bound is below the
kth score, or when no vector is left. A bound that equals the kth score does not stop it: an unseen
vector could have that score and a smaller id.

Shards are written once, as an index; blocks of queries of bounded size meet each shard by an
equi-join on shard and block, and a shard's k best per query are merged. Spark deals shards and blocks out;
a task holds one of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewright.llm.common import travels, written

#: Vectors of a shard, and queries of a block.
SHARD = 4096
BLOCK = 2048
#: Entries of each list that are read before the bound is first looked at; then twice as many.
FIRST = 16
#: Largest sum of products of components that a score may reach.
LARGEST = 1 << 62

travels(__name__)


def scaled(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(row, vec_id, v) of the vectors that take part: v is floor(scale * x) of each component.

    Null vectors and those with a null or non-finite component take no part; row tells rows apart,
    whatever their ids."""
    v = F.col(embedding).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    small = F.forall("v", lambda x: F.abs(x) < float(1 << 52))
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(fine)
    kept = kept.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)).cast("array<double>"))
    kept = kept.withColumn("v", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for whole scores"))).cast("array<long>"))
    return written(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))


def _matrix(column: pa.Array, width: int):
    """Rows of a list column as whole numbers; shorter vectors end in zeros."""
    import numpy as np

    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    full = np.zeros((len(sizes), width), np.int64)
    full[np.arange(width)[None, :] < sizes[:, None]] = flat
    return full


def _pack(width: int):
    """A group's rows (row, vec_id, v) as one row of arrays, ordered by vec_id (null last), row."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        import numpy as np

        table = table.combine_chunks()
        ids, rows = table["vec_id"].combine_chunks(), table["row"].to_numpy()
        empty = np.asarray(ids.is_null())
        order = np.lexsort((rows, ids.fill_null(0).to_numpy(), empty))
        m = _matrix(table["v"].combine_chunks(), width)[order]
        lists = np.argsort(m, axis=0, kind="stable").T.astype("<u4")  # one list per dimension, ascending
        return pa.table({"group": [key[0].as_py()], "rows": [rows[order]], "ids": [ids.take(pa.array(order))], "m": [np.ascontiguousarray(m, "<i8").tobytes()], "lists": [np.ascontiguousarray(lists).tobytes()]}, schema=SCHEMA)

    return pack


SCHEMA = pa.schema([("group", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("m", pa.binary()), ("lists", pa.binary())])
PACKED = "group long, rows array<long>, ids array<long>, m binary, lists binary"


def best(m, lists, q, k: int, own: int = -1) -> tuple[list[int], list[int], int]:
    """The k best vectors of a shard for one query: places, scores, and how many were scored.

    m: vectors by place, whole numbers in doubles where these are exact; lists: per dimension the
    places, ascending by component; own: place of the query itself, which is no candidate. Best
    is the higher score, then the earlier place."""
    import numpy as np

    n = len(m)
    dims = np.flatnonzero(q)
    seen = np.zeros(n, bool)
    if own >= 0:
        seen[own] = True
    places, scores, lo, depth = np.zeros(0, np.int64), np.zeros(0, m.dtype), 0, FIRST
    up, down = dims[q[dims] < 0], dims[q[dims] > 0]
    while True:
        if not len(dims):  # all scores are zero: the first places are the best
            turned = np.flatnonzero(~seen)[:k]
            return turned.tolist(), [0] * len(turned), len(turned)
        depth = min(depth, n)
        turned = np.concatenate([lists[up, lo:depth].ravel(), lists[down, n - depth : n - lo].ravel()])
        fresh = np.zeros(n, bool)
        fresh[turned] = True
        fresh &= ~seen
        new = np.flatnonzero(fresh)
        seen |= fresh
        places, scores = np.concatenate([places, new]), np.concatenate([scores, m[new] @ q])
        n_scored = int(seen.sum()) - (own >= 0)
        if len(places) > k:
            # only the k best so far and what ties with them matter from here on
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            places, scores = places[scores >= least], scores[scores >= least]
        if depth == n or n_scored == n - (own >= 0):
            break
        bound = q[up] @ m[lists[up, depth - 1], up] + q[down] @ m[lists[down, n - depth], down]
        if len(places) >= k and scores.min() > bound:
            break
        lo, depth = depth, 2 * depth
    order = np.lexsort((places, -scores))[:k]
    return places[order].tolist(), [int(s) for s in scores[order]], n_scored


def _search(k: int, width: int):
    kind = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64()), ("n_scored", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for one in range(batch.num_rows):
                x = {c: batch.column(c)[one].as_py() for c in ("ids", "rows", "q_rows", "q_ids", "m", "lists", "q_m")}
                n = len(x["rows"])
                m, q = np.frombuffer(x["m"], "<i8").reshape(n, width), np.frombuffer(x["q_m"], "<i8").reshape(-1, width)
                reach = width * max(map(int, (-m.min(initial=0), m.max(initial=0)))) * max(map(int, (-q.min(initial=0), q.max(initial=0))))
                if reach > LARGEST:
                    raise ValueError("scores may not fit a long")
                if reach < 1 << 53:
                    m, q = m.astype(float), q.astype(float)  # exact, and much faster
                lists = np.frombuffer(x["lists"], "<u4").reshape(width, n).astype(np.int64)
                at = {r: i for i, r in enumerate(x["rows"])}
                out: list[list] = [[] for _ in kind]
                for row, name, weights in zip(x["q_rows"], x["q_ids"], q, strict=True):
                    places, scores, scored = best(m, lists, weights, k, at.get(row, -1))
                    for column, values in zip(out, ([row] * len(places), [name] * len(places), [x["ids"][p] for p in places], [x["rows"][p] for p in places], scores, [scored] * len(places)), strict=True):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind, strict=True)], schema=kind)

    return search


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score, n_scored.

    Components become floor(scale * x). Queries are the rows whose id is divisible by `every`;
    candidates are all rows but the query's own; the higher score comes first, then the smaller
    id (null last); fewer candidates, fewer rows. Vectors that are null or hold null or
    non-finite components take no part; shorter ones count as ending in zeros, an empty one as
    zeros; rows that repeat an id or a vector are rows of their own, so a repeated query has
    its ranks once per row. n_scored: vectors that were scored in full before the bound
    stopped the search, in the shard. An empty table gives an empty one; other columns are
    ignored. Components whose scores could pass 62 bits end the job with a message."""
    rows = scaled(vectors, vec_id, embedding, scale)
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    spark = rows.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, n_scored long")
    width = max(1, width)
    asked = rows.where(F.col("vec_id") % every == 0)
    shards, blocks = -(-n // SHARD), -(-max(1, asked.count()) // BLOCK)

    def packed(df: DataFrame, groups: int) -> DataFrame:
        dealt = df.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
        return dealt.groupBy("group").applyInArrow(_pack(width), PACKED)

    index = written(packed(rows, shards))
    asked = packed(asked, blocks).select(F.col("group").alias("block"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    # both sides go out once per pair of a shard and a block, so that no key has more than one pair
    each = lambda groups: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    asked = written(asked).withColumn("group", each(shards))
    pairs = index.withColumn("block", each(blocks)).join(asked.hint("shuffle_hash"), ["group", "block"])
    kind = "query_row long, query_id long, vec_id long, row long, score long, n_scored long"
    found = pairs.select("rows", "ids", "m", "lists", "q_rows", "q_ids", "q_m").mapInArrow(_search(k, width), kind)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    ranked = written(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "n_scored")
