"""Line differences, and previews of uploaded files."""

import random
import re

from pyspark.sql import functions as F

from tidewright.functions.linediff import line_changes
from tidewright.operators import search, uploads
from tidewright.plans import upload_queries


def patched(old, diff):
    """old with a unified diff applied."""
    lines, out, at = old.splitlines(), [], 0
    for x in diff[2:]:
        if m := re.match(r"@@ -(\d+)(?:,(\d+))? \+", x):
            start = int(m[1]) - (m[2] != "0")
            out += lines[at:start]
            at = start
        elif x[0] == "+":
            out.append(x[1:])
        else:
            assert lines[at] == x[1:]
            at += 1
            if x[0] == " ":
                out.append(x[1:])
    return out + lines[at:]


def least_edits(a, b):
    """Lines that any order-preserving difference adds and removes at least."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return len(b) - row[-1], len(a) - row[-1]


def test_line_changes_patch_the_old_text(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(150):
        old = [rng.choice("abcdefgh") * rng.randint(0, 2) for _ in range(rng.randint(0, 25))]
        new = [x for x in old if rng.random() > 0.2]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), rng.choice(["x", "a", "é", "漢"]))
        pairs.append(("\n".join(old), "\n".join(new)))
    long = [f"line {i % 997} of a long text with some words" for i in range(4000)]
    pairs.append(("\n".join(long), "\n".join(long[:100] + ["new"] + long[150:])))
    df = spark.createDataFrame(pairs, "old string, new string")
    rows = df.select("old", "new", line_changes(F.col("old"), F.col("new"), 1, 10**6).alias("c")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        old, new = r["old"].splitlines(), r["new"].splitlines()
        assert (patched(r["old"], r["c"]["diff"]) if r["c"]["diff"] else old) == new
        assert r["c"]["added"] - r["c"]["removed"] == len(new) - len(old)
        assert r["c"]["added"] >= least_edits(old, new)[0]
    assert sum(r["c"]["added"] == least_edits(r["old"].splitlines(), r["new"].splitlines())[0] for r in rows) > 0.9 * len(rows)


def test_line_changes_of_few_lines(spark):
    rows = [("a\nb", "a\nb"), (None, "a\nb"), ("a", None), ("", ""), ("a\nb\nc", "a\nX\nc"), ("a", "a\n++b"), ("--a\nb", "b"), ("x", "\n".join(map(str, range(500))))]
    got = spark.createDataFrame(rows, "o string, n string").select(line_changes(F.col("o"), F.col("n"), 0, 20).alias("c")).collect()
    counts = [(r["c"]["added"], r["c"]["removed"]) for r in got]
    assert counts == [(0, 0), (2, 0), (0, 1), (0, 0), (1, 1), (0, 0), (0, 0), (500, 1)]
    assert got[4]["c"]["diff"] == ["--- ", "+++ ", "@@ -2 +2 @@", "-b", "+X"] and len(got[7]["c"]["diff"]) == 20 and got[1]["c"]["diff"] == []


def test_query_patches_every_text(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", upload_queries.altered("text").alias("old"))
    rows = d.select("doc_id", "text", "old", line_changes(F.col("old"), F.col("text"), 1, 10**6).alias("c")).collect()
    got = {r["doc_id"]: r for r in upload_queries.version_diffs(spark, sf).collect()}
    assert len(got) == len(rows) > 100
    for r in rows:
        if r["c"]["diff"]:
            assert patched(r["old"], r["c"]["diff"]) == r["text"].splitlines()
        one = got[r["doc_id"]]
        assert (one["added"], one["removed"], one["n_diff"]) == (r["c"]["added"], r["c"]["removed"], min(200, len(r["c"]["diff"])))


FILES = [("a/RB 1.md", "# Title\nSee orders and 결제\n## One\n문서 ID: RB-OPS-12\n"), ("page.html", "<h1>Head</h1><p>text of orders</p>"), ("empty.txt", None)]


def test_preview_commit_list_and_delete(spark):
    files = spark.createDataFrame(FILES, "name string, text string")
    names = spark.createDataFrame([("table:orders", "orders"), ("sys:pay", "결제"), ("x", "absent")], "entity string, name string")
    stored = spark.createDataFrame([("runbook:RB_1", "# Title\nSee orders\n")], "id string, markdown string")
    p = uploads.preview(files, stored, names)
    got = {r["id"]: r for r in p.collect()}
    one = got["runbook:RB_1"]
    assert one["exists"] and one["title"] == "Title" and (one["added"], one["removed"]) == (3, 1) and one["diff"][0] == "--- "
    assert [(e["entity"], e["in_raw"]) for e in one["entities"]] == [("table:orders", True), ("sys:pay", True)] and "See orders" in one["entities"][0]["snippet"]
    assert {c["check"]: c["ok"] for c in one["checks"]} == {"title": True, "sections": True, "doc_id": True, "entities": True, "warnings": True}
    assert got["runbook:page"]["title"] == "Head" and not got["runbook:page"]["exists"] and got["runbook:page"]["diff"] == []
    assert not got["runbook:empty"]["entities"] and got["runbook:empty"]["title"] == "empty"

    versions = spark.createDataFrame([], "id string, version int, hash string, markdown string")
    first = uploads.commit(p, versions)
    versions = spark.createDataFrame(first.collect(), versions.schema)
    assert sorted((r["id"], r["version"]) for r in versions.collect()) == [("runbook:RB_1", 1), ("runbook:empty", 1), ("runbook:page", 1)]
    assert uploads.commit(p, versions).count() == 0
    again = uploads.commit(p.withColumn("markdown", F.concat("markdown", F.lit("more"))), versions)
    assert {r["version"] for r in again.collect()} == {2}
    assert {r["name"]: (r["bytes"], r["version"]) for r in uploads.listing(files, versions).collect()}["empty.txt"] == (0, 1)

    edges = spark.createDataFrame([("runbook:page", "t"), ("t", "runbook:page"), ("t", "u")], "src string, dst string")
    left, counts = uploads.delete(files, versions, edges, files.where("name = 'page.html'").select("name"))
    assert {r["table"]: r["n"] for r in counts.collect()} == {"files": 1, "versions": 1, "edges": 2}
    assert left["edges"].collect()[0]["dst"] == "u" and left["files"].count() == 2


def test_names_of_any_script_are_found_either_way(spark, monkeypatch):
    texts = [(1, "오늘 결제 실패"), (2, "결제가 늦다 API-결제"), (3, "no such thing"), (4, "C++ and ++"), (5, "日本語の本"), (6, None), (7, "")]
    names = [("pay", "결제"), ("plus", "++"), ("one", "本"), ("api", "API-결제"), ("none", "語本"), ("thing", "such thing"), ("null", None), ("blank", "")]
    docs, dic = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(names, "entity string, name string")
    want = sorted((i, e) for i, t in texts for e, n in names if t and n and re.search(r"(?<![A-Za-z0-9_])" + re.escape(n) + r"(?![A-Za-z0-9])", t, re.I))
    for few in (1000, 0):
        monkeypatch.setattr(search, "FEW_NAMES", few)
        got = search.dictionary_match(docs, dic, "id", "t").collect()
        assert sorted((r["id"], r["entity"]) for r in got) == want
        assert {(r["id"], r["entity"]): r["at"] for r in got}[1, "pay"] == 4


def test_capitals_of_any_script_are_found_either_way(spark, monkeypatch):
    texts = [(1, "Über uns"), (2, "ÜBER"), (3, "überall"), (4, "verſt"), (5, "ΛΟΓΟΣ λόγος"), (6, "Uber"), (7, "ßverst")]
    names = [("u", "über"), ("v", "verst"), ("l", "λογοσ")]
    docs, dic = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(names, "entity string, name string")
    for few in (1000, 0):
        monkeypatch.setattr(search, "FEW_NAMES", few)
        assert sorted((r["id"], r["entity"]) for r in search.dictionary_match(docs, dic, "id", "t").collect()) == [(1, "u"), (2, "u"), (4, "v"), (5, "l"), (7, "v")]
    files = docs.select(F.concat(F.lit("f"), "id", F.lit(".md")).alias("name"), F.concat(F.lit("# "), "t").alias("text"))
    got = uploads.preview(files, spark.createDataFrame([], "id string, markdown string"), dic).collect()
    assert sorted(r["name"] for r in got if [e["in_raw"] for e in r["entities"]] == [True]) == ["f1.md", "f2.md", "f4.md", "f5.md", "f7.md"]
