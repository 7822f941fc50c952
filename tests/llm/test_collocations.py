"""Collocations against counting with dictionaries."""

import random
import re
from collections import Counter

import duckdb

from tests.llm.helpers import docs, with_clashes
from tidewright.llm import collocations, queries


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counted(rows, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for words in split(text):
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return f, n


def ranks(f, n, least, longest, top):
    phrases = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = lambda x, y: any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
    out = []
    for lang in {p[0] for p in phrases}:
        own = {p[1]: a for p, a in phrases.items() if p[0] == lang}
        best = []
        for p, a in own.items():
            if any(len(q) > len(p) and b >= a and inside(p, q) for q, b in own.items()):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def corpus(rng, n=60):
    words = ["Der", "die", "und", "été", "漢字", "a-b", "x", "Ünd", "\x00z", "it's", "\x1fq", " "]
    passage = "the Quick brown fox jumps over it"
    rows = [(rng.choice(["", " ", "\t"]).join([" ".join(rng.choices(words, [9, 8, 7, 1, 1, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 30))), rng.choice(". , \n \x0b ; :".split(" ")), passage]), rng.choice(["de", "en", None, "und"])) for _ in range(n)]
    rows += [("a  b\t c a b c,a b c", "en")] * 5 + [(None, "en"), ("", None), ("...", "de"), ("\n", "en")]
    return rows + [("very long " * 30_000, "en"), ("ha " * 500, "de")]


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = docs(spark, [t for t, _ in rows]).drop("lang")
    langs = spark.createDataFrame([(i, lang) for i, (_, lang) in enumerate(rows)], "doc_id long, lang string")
    return with_clashes(df.join(langs, "doc_id")).withColumns({"w": F.lit("own"), "piece": F.lit("own"), "f": F.lit("own"), "n": F.lit(1)})


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BATCH_BYTES", 5_000)
    rows = corpus(random.Random(3))
    got = collocations.collocations(frame(spark, rows), least=4, longest=5, top=40)
    assert sorted(tuple(r) for r in got.collect()) == ranks(*counted(rows, 5), 4, 5, 40)
    got = collocations.collocations(frame(spark, rows), least=2, longest=3, top=7)
    assert sorted(tuple(r) for r in got.collect()) == ranks(*counted(rows, 3), 2, 3, 7)


def test_counts_are_exact_where_the_filter_is_full(spark):
    rng = random.Random(4)
    rows = [(" ".join(f"w{rng.randint(0, 3000)}" for _ in range(400)), "en") for _ in range(60)] * 3
    f, _ = counted(rows, 3)
    found = collocations.pieces(frame(spark, rows)).persist()
    _, levels = collocations.frequent_sequences(found, 3, 3, bits=15)
    for n, level in enumerate(levels, 1):
        assert {r["gram"]: r["f"] for r in level.collect()} == {" ".join(p): a for (_, p), a in f.items() if len(p) == n and a >= 3}
    found.unpersist()


def test_products_beyond_64_bits(spark):
    f = {("en", ("a",)): 10**15 + 7, ("en", ("b",)): 10**14 + 9, ("en", ("c",)): 10**15, ("en", ("a", "b")): 10**13 + 1, ("en", ("b", "c")): 10**13 + 3, ("en", ("a", "b", "c")): 10**13 - 11}
    n = {"en": 9 * 10**18}
    level = lambda k: spark.createDataFrame([(lang, " ".join(p), a) for (lang, p), a in f.items() if len(p) == k], collocations.COUNTS)
    got = collocations.ranked(spark.createDataFrame(list(n.items()), "lang string, n long"), [level(1), level(2), level(3)], 10)
    assert sorted(tuple(r) for r in got.collect()) == ranks(f, n, 1, 3, 10)


def test_no_rows(spark):
    for rows in ([], [(None, None)], [("", "en")], [("one", "en")]):
        df = docs(spark, [t for t, _ in rows])
        assert collocations.collocations(df, least=1).collect() == []


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    sf = sf.replace("0.001", "0.01")  # the smallest tables have few frequent phrases
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute(queries.OP11_SQL)
    names = [x[0] for x in want.description]
    rows = sorted(want.fetchall())
    assert len(rows) > 20 and sorted(tuple(r) for r in queries.op11_collocations(spark, sf).select(*names).collect()) == rows
