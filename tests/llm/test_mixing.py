import random

import pytest

from tests.llm.helpers import docs, prose, with_clashes
from tidewright.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s] or sizes[s] == 0}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    sources = [rng.choice(["a", "b", "é", "Z", "big", "big", "big", None, "tiny"]) for _ in range(150)]
    texts = [None if i % 37 == 0 else "" if i % 41 == 0 else prose(rng, rng.choice([1, 30, 300])) for i in range(150)]
    texts[5], sources[5] = prose(rng, 5000), "big"
    return docs(spark, texts + texts[:3], sources + sources[:3], [*range(150), 0, 1, None]), texts + texts[:3], sources + sources[:3]


def test_targets_and_taken(corpus):
    df, texts, sources = corpus
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    by_size = {}
    rows = mixing.mix_documents(with_clashes(df)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_size.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    assert sorted(k for k in by_size) == sorted((n, round(want[s], 6)) for s, n in sizes.items())
    for (_, target), taken in by_size.items():
        # half a block from rounding, and a last block that is short may be in or out
        assert abs(sum(taken) - target) <= 1.5 * mixing.BLOCK
    again = mixing.mix_documents(df.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["mark"], r["taken"])
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str) and sorted(rows, key=key) == sorted(again, key=key)


def test_blocks_hold_the_words(corpus):
    df, texts, _ = corpus
    blocks = mixing.mix_blocks(df).collect()
    taken = sum(r["taken"] for r in mixing.mix_documents(df).collect())
    assert sum(len(r["text"].split()) for r in blocks) == taken
    times, body = {}, {}
    for r in blocks:
        k = (r["source"], r["block"])
        times[k] = times.get(k, 0) + 1
        assert body.setdefault(k, r["text"]) == r["text"] and len(r["text"].split()) <= mixing.BLOCK
    assert max(times.values()) <= 2
    for s in {k[0] for k in body}:
        own = sorted(b for x, b in body if x == s)
        assert all(len(body[(s, b)].split()) == mixing.BLOCK for b in own[:-1])
        # a source that is taken whole has all of its words in its blocks
        if max(times[(s, b)] for b in own) == 2 and own == list(range(len(own))):
            words = sorted(w for t, x in zip(corpus[1], corpus[2], strict=True) if x == s for w in (t or "").split())
            assert sorted(w for b in own for w in body[(s, b)].split()) == words


def test_permutations_take_each_index_once_a_lap(spark):
    sources = spark.createDataFrame([(1, 1000003, 1000003), (2, 7, 14), (3, 1, 2), (4, 0, 0), (5, 100, 30)], "rank long, n_blocks long, n_slots long")
    got = {}
    for r in mixing.draw_slots(sources).where("rank > 1").collect():
        got.setdefault(r["rank"], []).append((r["slot"], r["block"]))
    assert sorted(b for _, b in got[2]) == sorted([*range(7)] * 2) and sorted(b for _, b in got[3]) == [0, 0]
    assert 4 not in got and len({b for _, b in got[5]}) == 30
    assert mixing.draw_slots(sources).where("rank = 1").select("block").distinct().count() == 1000003


def test_empty_cases(spark):
    assert mixing.mix_documents(docs(spark, ["a"]).limit(0)).count() == 0
    rows = mixing.mix_documents(docs(spark, [None, "", " "], ["a", "a", None])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in rows] == [(0, 0, 0.0)] * 3
    assert mixing.mix_blocks(docs(spark, [None, ""], ["a", "b"])).count() == 0


def test_counts_are_multinomial(spark):
    """Counts add up, first slots follow on, and their spread is that of a multinomial."""
    n = 400_000
    sources = spark.createDataFrame([(1, 50_000, n), (2, 3, 5), (3, 9, 0)], "rank long, n_blocks long, n_slots long")
    rows = [r for r in mixing.draw_counts(sources).collect() if r["rank"] == 1]
    rows.sort(key=lambda r: r["first"])
    assert [r["shard"] for r in rows] == list(range(512))
    assert [r["first"] for r in rows] == [sum(x["n"] for x in rows[:i]) for i in range(512)] and sum(r["n"] for r in rows) == n
    mean = n / 512
    chi = sum((r["n"] - mean) ** 2 / mean for r in rows)
    assert 511 - 5 * (2 * 511) ** 0.5 < chi < 511 + 5 * (2 * 511) ** 0.5
    slots = mixing.draw_slots(sources).groupBy("rank").count().collect()
    assert {r["rank"]: r["count"] for r in slots} == {1: n, 2: 5}
    assert mixing.draw_counts(sources).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ids_of_any_type(spark):
    from pyspark.sql import functions as F

    df = docs(spark, ["a b c", "d e", None, "f"], ["x", "x", "y", None]).withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))
    assert {r["doc_id"]: r["size"] for r in mixing.mix_documents(df).collect()} == {"id-0": 3, "id-1": 2, "id-2": 0, "id-3": 1}
    assert {i for r in mixing.mix_blocks(df).collect() for i in r["doc_ids"]} <= {"id-0", "id-1", "id-3"}
