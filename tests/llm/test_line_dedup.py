import random

from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose, with_clashes
from tidewright.llm import line_dedup


def test_chunks_make_up_the_text(spark):
    rng = random.Random(1)
    texts = ["", "a", "\n", "a\n\nb\n", None, "\n".join(prose(rng, rng.choice([1, 5, 20, 70])) for _ in range(60)), "x" * 100_000]
    rows = docs(spark, texts).select("text", line_dedup.chunked(F.col("text")).alias("c")).collect()
    for r in rows:
        if r["text"] is None:
            assert r["c"] is None
            continue
        assert "\n".join(c["body"] for c in r["c"]) == r["text"]
        assert [c["at"] for c in r["c"]] == list(range(len(r["c"])))
        assert all(c["lines"] == c["body"].count("\n") + 1 for c in r["c"])
        assert all(c["lines"] == 1 for c in r["c"] if c["big"])


def test_boundaries_resist_shifts(spark):
    rng = random.Random(2)
    passage = [prose(rng, 12) for _ in range(40)]
    texts = ["\n".join(passage), "\n".join(["head", *passage]), "\n".join([prose(rng, 9), prose(rng, 7), *passage, "tail"])]
    sets = [{c["body"] for c in r["c"]} for r in docs(spark, texts).select(line_dedup.chunked(F.col("text")).alias("c")).collect()]
    assert len(sets[0] & sets[1]) >= len(sets[0]) - 2 and len(sets[0] & sets[2]) >= len(sets[0]) - 4


def brute(rows, chunks):
    """First occurrences by id, null last, then the operator's text hash and place."""
    seen, gone = {}, {}
    for key in sorted(chunks, key=lambda k: (k[0] is None, k[0] or 0, k[1])):
        for c in chunks[key]:
            if (c["lines"] > 1 or c["big"]) and len(c["body"].split()) >= line_dedup.LEAST_WORDS:
                if c["body"] in seen:
                    gone.setdefault(key, []).append((c["at"], seen[c["body"]]))
                else:
                    seen[c["body"]] = key[0]
    return gone


def test_equals_brute_force(spark):
    rng = random.Random(3)
    shared = [[prose(rng, rng.choice([6, 15, 60])) for _ in range(6)] for _ in range(5)]
    texts = []
    for _ in range(60):
        lines = [prose(rng, 8) for _ in range(rng.randint(0, 4))]
        for p in rng.sample(shared, rng.randint(0, 2)):
            lines += p
        texts.append("\n".join(lines + [prose(rng, 5)]))
    texts += [texts[7], texts[8], None, "", shared[0][0] * 3]
    ids = [*range(len(texts) - 1), None]
    df = with_clashes(docs(spark, texts, ids=ids))
    marks = df.select("doc_id", F.xxhash64("text").alias("m"), line_dedup.chunked(F.col("text")).alias("c")).collect()
    gone = brute(texts, {(r["doc_id"], r["m"]): r["c"] or [] for r in marks})
    full = {(r["doc_id"], r["m"]): r["c"] for r in marks}
    out = line_dedup.remove_repeated_chunks(df)
    assert set(df.columns) - {"clean"} < set(out.columns)
    assert len(gone) > 10
    for r in out.select("doc_id", "text", "clean", F.xxhash64("text").alias("m")).collect():
        key = (r["doc_id"], r["m"])
        at = {a for a, _ in gone.get(key, [])}
        want = r["text"] if not at else "\n".join(c["body"] for c in full[key] if c["at"] not in at)
        assert r["clean"]["text"] == want and r["clean"]["n_chunks"] == len(at)
        assert r["clean"]["first_ids"] == sorted({f for _, f in gone.get(key, [])})


def test_whole_rows_that_repeat(spark):
    text = prose(random.Random(4), 80)
    got = line_dedup.remove_repeated_chunks(docs(spark, [text, text, text], ids=[1, 1, 2])).collect()
    assert sorted((r["doc_id"], r["clean"]["text"] == text) for r in got) == [(1, True), (1, True), (2, False)]
    assert line_dedup.remove_repeated_chunks(docs(spark, [text]).limit(0)).count() == 0


def test_passages_of_long_lines_go(spark):
    rng = random.Random(5)
    passage = prose(rng, 55)
    texts = [f"{prose(rng, 20)}\n{passage}\n{prose(rng, 20)}" for _ in range(20)]
    got = line_dedup.remove_repeated_chunks(docs(spark, texts)).collect()
    assert sum(passage in r["clean"]["text"] for r in got) == 1
    assert all(r["clean"]["text"].split()[:20] == r["text"].split()[:20] for r in got)


def test_no_python_in_the_plan(spark, sf):
    from tidewright.llm.queries import op3_license_scan, op7_line_dedup, op10_mix_sources

    for q in (op3_license_scan, op7_line_dedup, op10_mix_sources):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_repeated_runs_go_whole(spark):
    """Runs of over 50 words in shorter lines, wherever chunks end, and whole copies."""
    rng = random.Random(6)
    runs = [[prose(rng, rng.choice([1, 9, 13, 20, 50])) for _ in range(rng.randint(2, 9))] for _ in range(40)]
    runs = [r + [prose(rng, 30), "", prose(rng, 25)] for r in runs]
    texts = ["\n".join([prose(rng, 8), *runs[i % 40], prose(rng, 7)]) for i in range(120)]
    texts += [texts[3], texts[50]]
    n = len(texts)
    again = prose(rng, 20)
    texts += ["\n".join([again] * 9), "\n".join(prose(rng, 5) for _ in range(8)), None, ""]
    got = {r["doc_id"]: r for r in line_dedup.remove_repeats(with_clashes(docs(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i in range(40):
        assert got[i]["clean"]["text"] == texts[i] and got[i]["clean"]["n_lines"] == 0
    for i in range(40, 120):
        lines = texts[i].split("\n")
        assert [x for x in got[i]["clean"]["text"].split("\n") if x] == [lines[0], lines[-1]]
        assert i % 40 in got[i]["clean"]["first_ids"]
    assert all(not got[i]["clean"]["text"].strip() for i in range(120, n))
    # the first three lines of 20 words stay whole, what repeats them does not
    assert got[n]["clean"]["text"] == "\n".join([again] * 3)
    assert all(got[i]["clean"]["text"] == texts[i] for i in range(n + 1, len(texts)))
