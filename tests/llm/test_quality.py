import random
import re
import zlib

import numpy as np

from tests.llm.helpers import docs, prose, with_clashes
from tidewright.llm import quality_rules, rule_ensemble


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {p for at in seen.values() if len(at) > 1 for a in at for p in range(a, a + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [None, "", " \n\t ", "a\n\na\n a\nb\r\nb\r\n", "é\x0b漢 #*$%&|<>" * 4, "w " * 30, prose(rng, 3000), "x" * 50_000, prose(rng, 30) + "\x1c\xa0y"]
    got = quality_rules.judge(with_clashes(docs(spark, texts))).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        q, n = r["quality"], brute(t)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == n, t
        assert q["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (q["kept"] and q["base_failed"]) and r["mark"] == "own mark"


def test_rules_keep_prose_and_drop_junk(spark):
    rng = random.Random(6)
    clean = " ".join(["the", *prose(rng, 8).split()][k % 9] if k % 9 == 0 else prose(rng, 1) for k in range(200))
    texts = [clean, " ".join(x + "###" for x in clean.split()), " ".join(x + "!!" for x in clean.split())]
    kept = [r["quality"]["kept"] for r in quality_rules.judge(docs(spark, texts)).orderBy("doc_id").collect()]
    assert kept == [True, False, False]
    assert quality_rules.judge(docs(spark, ["x"]).limit(0)).count() == 0


def test_no_user_functions_in_the_plan(spark, sf):
    from tidewright.llm.queries import op4_quality_rules, op5_quality_classifier

    for q in (op4_quality_rules, op5_quality_classifier):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_ensemble_learns_rules():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 4))
    y = ((x[:, 0] > 0.6) | (x[:, 1] < 0.1) & (x[:, 2] > 0.5)).astype(float)
    m = rule_ensemble.fit(x, y, list("abcd"))
    z = np.full(len(x), m.bias)
    for r in m.rules:
        z += r.weight * np.all([(x[:, "abcd".index(f)] > t) == (op == ">") for f, op, t in r.tests], axis=0)
    assert ((z > 0) == y).mean() > 0.97
    assert 0 < len(m.rules) < 120


def test_one_class_and_no_rows():
    assert rule_ensemble.fit(np.zeros((0, 2)), np.zeros(0), ["a", "b"]).rules == ()
    m = rule_ensemble.fit(np.ones((5, 2)), np.ones(5), ["a", "b"])
    assert m.rules == () and m.bias > 0


def test_scores_of_odd_texts(spark, sf):
    from tidewright.llm.queries import quality_model

    model = quality_model(spark.read.parquet(f"{sf}/documents.parquet"), spark, sf)
    got = rule_ensemble.score(with_clashes(docs(spark, [None, "", "x" * 100_000, "a b", "a b"])), model, out="score").orderBy("doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["score"] == got[1]["score"] and got[3]["score"] == got[4]["score"]
    assert rule_ensemble.score(docs(spark, ["x"]).limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    from tidewright.llm.queries import op5_quality_classifier

    d = "/root/testdata/sf0.01"
    rows = op5_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93


def test_labels_may_be_missing(spark):
    d = docs(spark, ["a b c"] * 3)
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert rule_ensemble.learn(d, none, "quality").rules == ()
