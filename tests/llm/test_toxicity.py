import math
import random
import re
import zlib

from tests.llm.helpers import docs, prose, with_clashes
from tidewright.llm import toxicity


def corpus(rng, n, toxic):
    bad = ["scoundrel", "villain", "rascal", "knavework", "knavely"]
    out = []
    for _ in range(n):
        w = prose(rng, rng.randint(20, 120)).split()
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append(" ".join(w))
    return out


def model_of(spark, positives, others, prior=0.1):
    texts = positives + others
    labels = spark.createDataFrame([(i, 1) for i in range(len(positives))], "doc_id long, toxic int")
    return toxicity.learn(docs(spark, texts), labels, prior=prior)


def plain_score(m, text):
    """A score from the model's numbers alone, word by word."""
    total, hits, n = 0.0, 0, 0
    for line in dict.fromkeys(re.sub(r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]", " ", (text or "").lower()).split("\n")):
        for w in set(line.split()):
            n += 1
            for t, weight in m.terms.items():
                if w == t or t.endswith("*") and w.startswith(t[:-1]):
                    total, hits = total + weight, hits + 1
    z = m.bias + m.by_evidence * total / math.sqrt(max(1, n)) + m.by_hits * math.log1p(hits)
    return 1 / (1 + math.exp(-z))


def test_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(1)
    m = model_of(spark, corpus(rng, 80, True), corpus(rng, 300, False) + corpus(rng, 40, True), 0.12)
    assert {t.rstrip("*")[:5] for t in m.terms} == {"scoun", "villa", "rasca", "knave"}
    assert not any(a != b and a.rstrip("*").startswith(b.rstrip("*")) for a in m.terms for b in m.terms)
    good, bad = corpus(rng, 100, False), corpus(rng, 100, True)
    assert sum(plain_score(m, t) < 0.5 for t in good) > 97 and sum(plain_score(m, t) >= 0.5 for t in bad) > 97
    assert plain_score(m, "knavesomething " * 4) > plain_score(m, "plain words here")


def test_scores_equal_the_model(spark):
    rng = random.Random(5)
    m = model_of(spark, corpus(rng, 60, True), corpus(rng, 200, False))
    texts = corpus(rng, 30, True) + corpus(rng, 30, False) + ["Villain!\nvillain\nVILLAIN, rascal", "ÉVillain villain\n\nvillain", ""]
    got = toxicity.score(docs(spark, texts), m).orderBy("doc_id").collect()
    assert all(abs(r["score"] - plain_score(m, t)) < 1e-9 for r, t in zip(got, texts, strict=True))


def test_copies_are_no_evidence(spark):
    """Words of one toxic passage that stands in many altered copies don't get into the lexicon."""
    rng = random.Random(6)
    words = [f"rare{chr(97 + i)}{i}word" for i in range(60)]
    copies = []
    for _ in range(60):
        w = list(words)
        w[rng.randrange(60)] = "changed" + str(rng.randrange(999))
        copies.append(" ".join(w) + " villain")
    m = model_of(spark, corpus(rng, 60, True) + copies, corpus(rng, 300, False), 0.2)
    assert m.terms and not any(t.startswith("rare") and len(t) > 6 for t in m.terms)


def test_no_positives(spark):
    m = toxicity.learn(docs(spark, ["a b"]), spark.createDataFrame([(0, 0)], "doc_id long, toxic int"))
    assert m.terms == {} and m.bias < 0


def test_scores_of_odd_texts(spark):
    rng = random.Random(2)
    m = model_of(spark, corpus(rng, 60, True), corpus(rng, 200, False))
    got = toxicity.score(with_clashes(docs(spark, [None, "", " ", "villain rascal villain rascal scoundrel " + "x " * 50_000, "a", "a"])), m, out="score").orderBy("doc_id").collect()
    assert got[0]["score"] == got[1]["score"] == got[2]["score"] < 0.5 < got[3]["score"]
    assert got[4]["score"] == got[5]["score"] and got[0]["mark"] == "own mark"
    assert toxicity.score(docs(spark, ["x"]).limit(0), m).count() == 0


def test_learning_tables(spark):
    rng = random.Random(3)
    texts = corpus(rng, 40, True) + corpus(rng, 100, False)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(60)] + [(None, 1), (200, 1), (5, None), (3, 1)], "doc_id long, toxic int")
    m = toxicity.learn(docs(spark, texts), labels)
    assert m.terms and toxicity.learn(docs(spark, texts).limit(0), labels).terms == {}
    assert toxicity.learn(docs(spark, texts), labels.limit(0)).terms == {}


def test_held_out_recall_and_specificity(spark):
    from tidewright.llm.queries import op6_toxicity

    d = "/root/testdata/sf0.1"
    rows = op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    bad, good = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in bad) / len(bad) > 0.92
    assert sum(1 - r["predicted"] for r in good) / len(good) > 0.98
