"""Searches over a written index of several fields."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.operators import fielded
from tidewright.session import scratch

MOST, BEST = {"title": 3.0, "body": 1.0}, {"title.bigram": 0.6, "body.bigram": 0.2}


def analysers(title, body):
    words, pairs = (lambda c: tx.tokens(c, r"[\p{L}0-9_]+")), (lambda c: tx.bigrams(F.lower(c), r"[\p{L}\p{Nd}]"))
    return {"title": words(title), "body": words(body), "title.bigram": pairs(title), "body.bigram": pairs(body)}


def words(t):
    return [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split()]


def pairs(t):
    runs = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    return [p for r in runs for p in ([r] if len(r) == 1 else [r[i : i + 2] for i in range(len(r) - 1)])]


def brute(docs, questions, limit, allowed=None):
    fields = {"title": (1, words), "body": (2, words), "title.bigram": (1, pairs), "body.bigram": (2, pairs)}
    tf = {f: {d[0]: Counter(cut(d[at])) for d in docs if cut(d[at])} for f, (at, cut) in fields.items()}
    out = []
    for qid, q in questions:
        scores = {}
        for d in docs:
            total, late, hit = 0.0, [], False
            for f, (_, cut) in fields.items():
                n, avg = len(tf[f]), sum(sum(c.values()) for c in tf[f].values()) / max(1, len(tf[f]))
                own, asked = tf[f].get(d[0], Counter()), set(cut(q))
                met = [t for t in asked if own[t]]
                s = 0.0
                for t in met:
                    df = sum(1 for c in tf[f].values() if c[t])
                    s += {**MOST, **BEST}[f] * math.log(1 + (n - df + 0.5) / (df + 0.5)) * own[t] * 2.2 / (own[t] + 1.2 * (0.25 + 0.75 * sum(own.values()) / avg))
                if f in MOST and met:
                    total, hit = total + s, True
                elif f in BEST and met and len(met) >= max(1, math.floor(len(asked) * 0.6)):
                    late.append(s)
            if (hit or late) and (allowed is None or d[0] in allowed):
                scores[d[0]] = total + max(late, default=0.0)
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:limit]
        out += [(qid, i, round(scores[i], 6), r) for r, i in enumerate(best, 1)]
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    vocabulary = ["daily", "sales", "daily_sales", "결제", "지연", "결제지연", "ranking", "score", "x", "a1"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 3))), " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(120)]
    docs += [(500, None, None), (501, "", ""), (502, "uniq_id", "other"), (503, "other", "uniq_id " * 2000)]
    df = spark.createDataFrame(docs, "id long, title string, body string")
    index = fielded.write_index(df, "id", analysers(F.col("title"), F.col("body")), scratch(spark, "index"), 4)
    return docs, df, index


@pytest.mark.parametrize("few", [100_000, 0])
def test_equals_brute_force(spark, corpus, monkeypatch, few):
    monkeypatch.setattr(fielded, "FEW_TERMS", few)
    docs, df, index = corpus
    questions = [(1, "uniq_id"), (2, "결제 지연 장애"), (3, "score x"), (4, "nothing of it"), (5, ""), (6, "score score a1")]
    asked = spark.createDataFrame(questions, "qid long, query string")
    terms = fielded.question_terms(asked, analysers(F.col("query"), F.col("query")))
    got = fielded.search(index, terms, MOST, BEST, 0.6, 15).collect()
    assert sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in got) == sorted(brute(docs, questions, 15))
    assert min((r["rank"], r["id"]) for r in got if r["qid"] == 1)[1] == 502  # the exact identifier as a title
    odd = {i for i, *_ in docs if i % 2}
    got = fielded.search(index, terms, MOST, BEST, 0.6, 15, df.where("id % 2 = 1").select("id")).collect()
    assert sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in got) == sorted(brute(docs, questions, 15, odd))


def test_reads_postings_and_only_folders_of_its_terms(spark, corpus):
    _, _, index = corpus
    terms = spark.createDataFrame([(1, "title", "daily_sales")], "qid long, field string, term string")
    hits = index.hits(terms)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*folder", plan) and plan.count("FileScan") == 1 and "BroadcastHashJoin" in plan and hits.count() > 0


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, title string, body string")
    index = fielded.write_index(df, "id", analysers(F.col("title"), F.col("body")), scratch(spark, "index"), 2)
    terms = spark.createDataFrame([(1, "title", "a")], "qid long, field string, term string")
    assert fielded.search(index, terms, MOST, BEST).count() == 0


def test_pieces_of_runs_and_no_shuffled_postings(spark, corpus, monkeypatch):
    """Pieces cut while counting are those of the pattern, beyond the basic plane too, whatever the
    size of a slice; postings are written where they are counted."""
    docs, _, _ = corpus
    df = spark.createDataFrame([*docs, (600, "𝒜𝒷𝒸 d", "é漢字 x 漢 ab")], "id long, title string, body string")
    text, path = F.col("body"), scratch(spark, "index")
    made = {"whole": (tx.bigrams(F.lower(text), r"[\p{L}\p{Nd}]"), ()), "cut": (tx.tokens(text, r"[\p{L}\p{Nd}]+"), ("body",))}
    found = {}
    for name, (tokens, runs) in made.items():
        counted = fielded._counted(["body"], set(runs), 200)
        rows = df.select("id", F.coalesce(tokens, F.array().cast("array<string>")).alias("f0")).mapInArrow(counted, "id long, field string, len int, term string, tf int")
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        index = fielded.write_index(df, "id", {"body": tokens}, f"{path}-{name}", 4, runs)
        read = index._read(spark, "postings").drop("folder").collect()
        found[name] = (sorted(map(str, read)), sorted(map(str, rows.collect())), sorted(map(str, index._read(spark, "fields").collect())), sorted(map(str, index._read(spark, "terms").collect())))
    assert found["whole"] == found["cut"] and found["cut"][0] == found["cut"][1] and any("漢字" in x for x in found["cut"][0])
