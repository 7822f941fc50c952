"""The prefix trie against one that is built by dictionaries."""

import hashlib
import random
import zlib

import duckdb
import pytest
from tests.llm.helpers import with_clashes
from pyspark.sql import functions as F

from tidewright.llm import prefix_trie, queries

KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes as the contract states them."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    stats = {}
    for p in sorted(members, key=len, reverse=True):
        kids = [k for k in stats if len(k) == len(p) + 1 and k[:-1] == p]
        saves = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        stats[p] = (len(kids), sum(stats[k][1] for k in kids) or 1, saves + sum(stats[k][2] for k in kids))
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), parent, len(who), *stats[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(df):
    c = F.col("conv")
    out = prefix_trie.trie(*prefix_trie.with_openings(prefix_trie.numbered_turns(df), c - c % 100, F.crc32(c.cast("string")) % 6, 5))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_equals_brute_force_with_nulls_ties_repeats_and_clashes(spark, monkeypatch):
    for name, value in (("SPAN_BITS", 1), ("SALTS", 2), ("IDS_BITS", 2)):
        monkeypatch.setattr(prefix_trie, name, value)
    rng = random.Random(5)
    text = lambda: rng.choice(["a", "b", "", None, "été 漢字 🙂"])
    rows = [(c, t, rng.choice(["user", None, ""]), text()) for c in [*range(0, 40), 100, 101, 105, 203, 417, -7, -100] for t in range(rng.randint(1, 7))]
    rows += [(c, None, "user", "a") for c in (0, 3, 100)] + [(5, 1, "user", "b")] * 3 + [(None, 1, "user", "a")]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(7)]  # copies
    rows += [(c, t, "user", "long" * (1 + t)) for c in (600, 601) for t in range(9)] + [(601, 9, "user", "x" * 100_000)]
    df = with_clashes(spark.createDataFrame(rows, KIND)).withColumns({"n": F.lit("own"), "d": F.lit("own"), "conv": F.lit("own")})
    assert built(df) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(7, 0, "user", "a")], [(0, 0, "user", "a"), (100, 0, "user", "a")], [(None, 0, "user", "a")]])
def test_few_conversations(spark, rows):
    assert built(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = queries.op13_prefix_trie(spark, sf)
    want = c.execute(queries.OP13_SQL)
    names = [x[0] for x in want.description]
    assert sorted(map(str, got.select(*names).collect())) and sorted(tuple(r) for r in got.select(*names).na.fill(-1).collect()) == sorted(tuple(-1 if v is None else v for v in r) for r in want.fetchall())
