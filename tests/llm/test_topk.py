"""The threshold algorithm against all inner products."""

import math
import random

import duckdb
import numpy as np
from tests.llm.helpers import with_clashes

from tidewright.llm import queries, topk

KIND = "vec_id long, embedding array<float>"


def brute(rows, k=10, every=100):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (name, q) in enumerate(kept):
        if name is None or math.fmod(name, every):
            continue
        scores = [(-sum(a * b for a, b in zip(q, v)), i is None, i or 0) for j, (i, v) in enumerate(kept) if j != at]
        out += [(name, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df, **more):
    return sorted((tuple(r)[:4] for r in topk.top_k(df, **more).collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 50)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(-200, 400)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, -1.0, 0.5, 0.25]) for i in range(200)]  # a very common vector
    rows += [(500, [0.0] * 6), (600, []), (700, [2.0]), (100, rows[5][1]), (100, rows[5][1])]  # zeros, short, repeats
    rows += [(800, None), (900, [1.0, None, 2.0]), (1100, [float("nan")] * 6), (1200, [float("inf")] * 6), (None, [1.0] * 6), (None, [9.0] * 6)]
    df = with_clashes(spark.createDataFrame(rows, KIND))
    assert found(df) == brute(rows)
    assert found(df, k=3) == brute(rows, k=3)


def test_few_rows(spark):
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (1, [2.0])], [(1, [1.0])], [(0, None)], [(0, [])]):
        assert found(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_stops_early_where_the_bound_allows_it():
    rng = np.random.default_rng(2)
    m = np.round(rng.pareto(1.0, (4000, 3)) * 100).astype(float)
    lists = np.argsort(m, axis=0, kind="stable").T
    for own in (-1, int(np.argmax(m.sum(axis=1)))):
        q = np.array([1.0, 2.0, 1.0])
        places, scores, scored = topk.best(m, lists, q, 5, own)
        want = sorted((-s, p) for p, s in enumerate((m @ q).tolist()) if p != own)[:5]
        assert [(-s, p) for p, s in zip(places, scores, strict=True)] == want
        assert scored < 400


def test_large_components_are_exact_or_refused(spark):
    rows = [(i * 100, [float(2**20 + i), float(2**18 - 7 * i)]) for i in range(20)]
    assert found(spark.createDataFrame(rows, KIND)) == brute(rows)
    rows[3] = (300, [1e30, 1.0])
    try:
        found(spark.createDataFrame(rows, KIND))
    except Exception as told:
        assert "too large" in str(told)
    else:
        raise AssertionError("scores beyond a long were given")


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.execute(queries.OP12_SQL)
    names = [x[0] for x in want.description]
    assert sorted(tuple(r) for r in queries.op12_top_k(spark, sf).select(*names).collect()) == sorted(want.fetchall())
