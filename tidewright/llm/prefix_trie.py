"""Prefix trie of conversations, built level by level.

Per depth, live conversations are grouped by (parent node, next turn); a node's name is its
depth and its least conv_id. A conversation leaves the levels where it is alone, copies counted
as one, for the rest of its path is a chain that needs no grouping: so there are as many levels
as the longest opening that two different conversations share. Then leaves and savings are
rolled up from the deepest level to the root, one join a level.

Nothing gathers an unbounded group: turns are numbered in spans of a conversation, a level's
groups are counted per salt before they are summed, and the ids of copies are hashed as they
stream by, in order. Levels are written to the shared folder, so a lost executor costs tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import travels, written

#: Turns of a conversation that are numbered, joined or chained in one group, as a power of two.
SPAN_BITS = 10
#: Groups that a node's conversations are dealt to before they are summed.
SALTS = 32
#: Copies' ids that are one string before they are hashed, as a power of two of the ids' range.
IDS_BITS = 12
#: Code points of a text that order turns of equal number and role.
TIE_CHARS = 64

travels(__name__)


def numbered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv, d (from 1, by turn, null first), key (digest of role and text), len
    (code points of the text), cum (code points up to it).

    Null role or text counts as empty; turns of equal number are ordered by role, by the first
    64 code points of the text and by digest; rows without a conv_id take no part; texts are read whole,
    however long; other columns are ignored; an empty table gives an empty one."""
    plain = rows.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("conv IS NOT NULL")
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # spans keep the order of turns; null turns are a span of their own before all others
    span = F.coalesce(F.shiftright("turn", SPAN_BITS), F.lit(-(1 << 60)))
    keyed = written(plain.select("conv", span.alias("span"), "turn", "role", F.substring("text", 1, TIE_CHARS).alias("head"), key.alias("key"), F.char_length("text").cast("long").alias("len")))
    inside = Window.partitionBy("conv", "span").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "key")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.select("conv", "span", "key", "len", F.row_number().over(inside).alias("at"), F.sum("len").over(so_far).alias("run"))
    before = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = keyed.groupBy("conv", "span").agg(F.count("*").alias("n"), F.sum("len").alias("len"))
    spans = spans.select("conv", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("len").over(before), F.lit(0)).alias("len0"))
    return placed.join(spans, ["conv", "span"]).select("conv", (F.col("n0") + F.col("at")).alias("d"), "key", "len", (F.col("len0") + F.col("run")).alias("cum"))


def _span(d: str | Column) -> Column:
    return F.shiftright(d, SPAN_BITS)


def _spans(table: DataFrame, first: Column, last: Column) -> DataFrame:
    """table with a row for each span of the depths from first to last; none if there is none."""
    return table.where(first <= last).withColumn("span", F.explode(F.sequence(_span(first), _span(last))))


def with_openings(turns: DataFrame, base: Column, n_shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, n), and turns, where the first n_shared turns are those of another.

    turns: as from numbered_turns; `base` and `n_shared` (at most `most`) are functions of conv. A
    conversation takes the first n_shared turns of `base` (all if fewer, none if absent), then its
    own turns after its first n_shared."""
    h = n_shared.cast("long")
    own = turns.groupBy("conv").agg(F.max("d").alias("own"), F.max(F.when(F.col("d") <= h, F.col("cum"))).alias("skip"))
    heads = turns.where(F.col("d") <= most).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("d", "key", "len", "cum"))).alias("head"))
    taken = own.withColumns({"h": h, "base": base}).join(heads, "base", "left")
    taken = taken.select("conv", "own", "h", "skip", F.filter(F.coalesce("head", F.array()), lambda x: x["d"] <= F.col("h")).alias("head"))
    k = F.size("head").cast("long")
    taken = written(taken.select("*", k.alias("k"), F.when(k > 0, F.element_at("head", -1)["cum"]).otherwise(0).alias("head_len")))
    opened = taken.select("conv", F.explode("head").alias("t")).select("conv", "t.*")
    late = _spans(taken.select("conv", "own", "h", "k", "skip", "head_len"), F.col("h") + 1, F.col("own"))
    kept = turns.withColumn("span", _span("d")).join(late, ["conv", "span"]).where("d > h")
    kept = kept.select("conv", (F.col("d") - F.col("h") + F.col("k")).alias("d"), "key", "len", (F.col("cum") - F.coalesce("skip", F.lit(0)) + F.col("head_len")).alias("cum"))
    return taken.select("conv", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), opened.unionByName(kept)


def _copies(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """convs with total (code points) and seq, a digest that conversations share if and only if
    they have the same turns: sums of digests of (d, key), which need no order and no group."""
    mark = F.sha2(F.concat(F.col("d").cast("string").cast("binary"), F.lit(b":"), F.col("key")), 256)
    parts = [F.sum(F.conv(F.substring("mark", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    sums = turns.select("conv", "cum", mark.alias("mark")).groupBy("conv").agg(F.max("cum").alias("total"), *parts)
    seq = F.sha2(F.concat_ws(",", "n", "total", *(f"s{i}" for i in range(4))), 256)
    return convs.join(sums, "conv", "left").select("conv", "n", F.coalesce("total", F.lit(0).cast("long")).alias("total"), seq.alias("seq"))


def _hash_lists(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, sha) for rows (seq, ids) that come sorted: the hash of each seq's ids, comma-joined."""
    seq, state = None, None
    for batch in parts:
        done = []
        for now, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if now != seq:
                if state is not None:
                    done.append((seq, state.hexdigest()))
                seq, state = now, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["seq", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([state.hexdigest()])], ["seq", "sha"])


def _list_hashes(convs: DataFrame) -> DataFrame:
    """(seq, sha): the SHA-256 of each seq's conv_ids, ascending and comma-joined."""
    part = F.shiftright("conv", IDS_BITS)
    parts = convs.groupBy("seq", part.alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))
    return parts.repartition("seq").sortWithinPartitions("seq", "part").select("seq", "ids").mapInArrow(_hash_lists, "seq string, sha string")


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of conversations, its root included.

    convs: (conv, n turns), turnless ones too; turns: (conv, d, key, len, cum) as from
    numbered_turns. Columns: conv_id (least member), depth, parent_conv_id (of the root: null),
    n_convs, n_children, n_leaves (childless nodes in its subtree, itself included), saved_tokens
    (over its subtree, (n_convs - 1) times the code points of a node's last text), ends_sha256
    (SHA-256 of the ids of members that end there, ascending, comma-joined; of nothing where none
    does). Copies of a conversation are one in all levels; no conversation, no node."""
    turns = written(turns)
    convs = written(_copies(convs, turns))
    reps = written(convs.groupBy("seq", "n", "total").agg(F.min("conv").alias("c"), F.count("*").alias("m")))
    root = reps.agg(F.min("c").alias("conv"), F.sum("m").alias("n_convs"), F.count("*").alias("n_reps")).first()
    some = root["conv"] is not None
    alone = reps.first() if root["n_reps"] == 1 else {"n": None, "total": None}
    top = {"conv": root["conv"], "parent": None, "n_convs": root["n_convs"], "n_reps": root["n_reps"], "n": alone["n"], "len": 0, "rest": alone["total"]}
    levels = [convs.sparkSession.range(int(some)).select(*(F.lit(v).cast("long").alias(c) for c, v in top.items()))]
    ended = [reps.where("n = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(root["conv"]).cast("long").alias("conv"), "seq")]
    rows = written(turns.withColumnRenamed("conv", "c").join(reps.select("c"), "c", "left_semi"))
    live = reps.select("c", "m", "n", "total", "seq", F.lit(root["conv"]).cast("long").alias("node")).where(F.lit(root["n_reps"] > 1))
    pending, depth = rows, 0
    while True:
        depth += 1
        here = pending.where(F.col("d") == depth).join(live, "c").withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)))
        here = written(here.select("c", "m", "n", "seq", "total", "node", "key", "len", "salt", (F.col("total") - F.col("cum") + F.col("len")).alias("rest")))
        if here.isEmpty():
            break
        group = ["node", "key", "salt"]
        salted = here.groupBy(*group).agg(F.min("c").alias("first"), F.sum("m").alias("m"), F.count("*").alias("reps"), *(F.max(c).alias(c) for c in ("n", "len", "rest")))
        over = Window.partitionBy("node", "key")
        salted = written(salted.select(*group, "first", "n", "len", "rest", F.min("first").over(over).alias("conv"), F.sum("m").over(over).alias("n_convs"), F.sum("reps").over(over).alias("n_reps")))
        levels.append(salted.where("first = conv").select("conv", F.col("node").alias("parent"), "n_convs", "n_reps", "n", "len", "rest"))
        ends = here.where(F.col("n") == depth).join(salted.select(*group, "conv"), group)
        ended.append(ends.select(F.lit(depth).cast("long").alias("depth"), "conv", "seq"))
        shared = salted.where("n_reps > 1").select(*group, "conv")
        live = here.where(F.col("n") > depth).join(shared, group).select("c", "m", "n", "total", "seq", F.col("conv").alias("node"))
        if depth & (depth - 1) == 0:
            pending = written(pending.where(F.col("d") > depth).join(live.select("c"), "c", "left_semi"))

    # chains of those that are alone from a node on
    alone = _all([level.where("n_reps = 1").select(F.col("conv").alias("c"), F.lit(k).cast("long").alias("at")) for k, level in enumerate(levels)])
    alone = written(alone.join(reps, "c").where("n > at").select("c", "at", "m", "n", "total", "seq"))
    chains = rows.withColumn("span", _span("d")).join(_spans(alone, F.col("at") + 1, F.col("n")), ["c", "span"]).where("d > at")
    saved = (F.col("m") - 1) * (F.col("total") - F.col("cum") + F.col("len"))
    ended.append(alone.select(F.col("n").alias("depth"), F.col("c").alias("conv"), "seq"))
    one = F.lit(1).cast("long")
    nodes = [chains.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("c").alias("parent_conv_id"), F.col("m").alias("n_convs"), (F.col("d") < F.col("n")).cast("long").alias("n_children"), one.alias("n_leaves"), saved.alias("saved_tokens"))]

    below = None
    for k in reversed(range(len(levels))):
        level = levels[k]
        if below is None:
            level = level.select("*", *(F.lit(None).cast("long").alias(c) for c in ("kids", "leaves", "saved")))
        else:
            sums = below.groupBy("parent_conv_id").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            level = level.join(sums, F.col("conv") == F.col("parent_conv_id"), "left")
        chain = F.col("n_reps") == 1
        below = written(level.select(
            F.col("conv").alias("conv_id"), F.lit(k).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
            F.when(chain, (F.col("n") > k).cast("long")).otherwise(F.coalesce("kids", F.lit(0))).alias("n_children"),
            F.when(chain, one).otherwise(F.coalesce("leaves", one)).alias("n_leaves"),
            F.when(chain, (F.col("n_convs") - 1) * F.col("rest")).otherwise((F.col("n_convs") - 1) * F.col("len") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        ))
        nodes.append(below)

    ends = _all(ended).join(_list_hashes(convs), "seq").select(F.col("depth").alias("at"), F.col("conv").alias("who"), "sha")
    found = _all(nodes).join(ends, (F.col("depth") == F.col("at")) & (F.col("conv_id") == F.col("who")), "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(none)).alias("ends_sha256"))
