"""Operators on small rows whose answers are known."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.operators import anomaly, asking, graph, health, history, incidents, metrics, opsagg, search
from tidewright.operators.components import connected_components


def test_metric_breach_and_anomaly(spark):
    points = [("m", k, 4.10 if k % 2 else 4.12) for k in range(13)] + [("m", 13, 3.6)]
    df = spark.createDataFrame(points, "metric string, at long, v double").withColumn("slo", F.lit(3.8))
    last = metrics.evaluate(df, "metric", "at", "v", "slo").where("at = 13").first()
    assert (last["state"], last["anomaly"], last["delta_good"]) == ("breach", True, False)
    first = metrics.evaluate(df, "metric", "at", "v", "slo").where("at = 0").first()
    assert first["avg_prev"] is None and not first["anomaly"] and first["state"] == "ok"


def test_metric_nulls_near_and_directions(spark):
    df = spark.createDataFrame([("m", 1, 10.0), ("m", 2, None), ("m", 3, 10.2)], "metric string, at long, v double").withColumn("slo", F.lit(10.0))
    got = {r["at"]: r for r in metrics.evaluate(df, "metric", "at", "v", "slo").collect()}
    assert got[2]["state"] == "nodata" and got[3]["state"] == "near" and got[3]["avg_prev"] == 10.0
    down = {r["at"]: r for r in metrics.evaluate(df, "metric", "at", "v", "slo", at_least=False, higher_is_better=False).collect()}
    assert down[3]["state"] == "breach" and down[3]["delta_good"] is False


def test_half_even_slo(spark):
    df = spark.createDataFrame([("a", 2.5 / 0.6)], "metric string, v double")
    assert metrics.default_slo(df, "metric", "v").first()["slo"] == 2.0


def test_nearest_planned_over_midnight(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 00:10:00' AS at")
    r = opsagg.nearest_planned(df, "at", F.lit(23 * 3600 + 1800)).first()
    assert str(r["planned"]) == "2024-01-01 23:30:00" and r["off_sec"] == 2400
    w = opsagg.sla_window(df, "at", F.lit(23 * 3600), F.lit(3600)).first()
    assert str(w["expected_start"]) == "2024-01-01 23:00:00" and str(w["expected_end"]) == "2024-01-02 01:00:00"


def test_quality_outlier_branches(spark):
    rows = [("z", 0.0)] * 5 + [("z", 3.0)] + [("f", 10.0)] * 5 + [("f", 14.0), ("f", 16.0)]
    got = anomaly.quality_outlier(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()
    assert sorted((r["k"], r["v"]) for r in got) == [("f", 16.0), ("z", 3.0)]


def test_missing_runs(spark):
    rows = [("a", d) for d in range(10) if d != 4] + [("b", d) for d in range(7)]
    assert [tuple(r) for r in anomaly.missing_runs(spark.createDataFrame(rows, "w string, d int"), "w", "d").collect()] == [("a", 4)]


def test_findings_make_incidents(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 8, n)
    rows = [
        (1, "workflow_failed", "crit", day(14), ["a"], "one"), (2, "sla_delay", "warn", day(15), ["a", "b"], "two"), (3, "volume_drop", "warn", day(16), ["b"], "three"),
        (4, "sla_delay", "warn", day(20), ["a"], "four"), (5, "volume_drop", "warn", day(14), ["z"], "five"), (6, "behavior_drop", "warn", day(25), ["q"], "six"), (7, "behavior_drop", "warn", day(25), ["r"], "seven"),
    ]
    df = spark.createDataFrame(rows, "fid long, rule string, severity string, day date, entities array<string>, summary string").withColumn("at", F.col("day").cast("timestamp_ntz"))
    got = anomaly.group_findings(df, same_rule=["behavior_drop"])
    assert {r["fid"]: r["component"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}
    inc = {r["key"]: r for r in anomaly.incidents(got).collect()}
    assert set(inc) == {"INC-0814", "INC-0814b", "INC-0825"}
    assert inc["INC-0814"]["priority"] == "P2" and inc["INC-0814"]["title"] == "one" and inc["INC-0814"]["n_findings"] == 3
    linked = anomaly.group_findings(df, adjacent=spark.createDataFrame([("a", "z")], "src string, dst string"))
    assert {r["component"] for r in linked.where("fid IN (1, 5)").collect()} == {1}


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7), (None, 3)]
    group = {}

    def top(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((top(a), top(b)))
            group[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: top(x) for x in group}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_flow_and_walks(spark):
    e = spark.createDataFrame([("dag:d", "writes", "table:t", "s"), ("dag:x", "reads", "table:t", "s"), ("dag:x", "builds", "index:i", "s"), ("alias:a", "alias_of", "index:i", "s"), ("dag:d", "owned_by", "team:q", "s"), ("dag:d", "writes", "table:t", "r")], "src string, rel string, dst string, source string")
    f = graph.flow(graph.distinct_edges(e))
    starts = spark.createDataFrame([("dag:d",)], "id string")
    down = [(r["id"], r["distance"], r["via"]) for r in graph.walk(f, starts, 4).orderBy("distance").collect()]
    assert down == [("table:t", 1, "dag:d"), ("dag:x", 2, "table:t"), ("index:i", 3, "dag:x"), ("alias:a", 4, "index:i")]
    up = graph.walk(f, spark.createDataFrame([("alias:a",)], "id string"), 2, up=True)
    assert {(r["id"], r["distance"]) for r in up.collect()} == {("index:i", 1), ("dag:x", 2)}
    assert graph.walk(f, starts, 2).count() <= graph.walk(f, starts, 3).count()
    assert graph.stubs(e, spark.createDataFrame([("dag:d",)], "id string")).count() == 5


def test_versions_round_trip(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]
    v = spark.createDataFrame(rows, "k string, version int, content string")
    undone = history.undo(v, v, "k", "content")
    assert {(r["k"], r["version"], r["content"], r["deleted"]) for r in undone.collect()} == {("a", 3, "x", False), ("b", 2, None, True)}
    now = history.current(v.withColumn("deleted", F.lit(False)).unionByName(undone), "k").collect()
    assert [(r["k"], r["content"]) for r in now] == [("a", "x")]
    assert {(r["k"], r["version"]) for r in history.keep_last(v, "k", 1).collect()} == {("a", 2), ("b", 1)}


def test_upsert_is_idempotent(spark):
    docs = spark.createDataFrame([("a", "h1"), ("b", "h2")], "k string, hash string")
    none = spark.createDataFrame([], "k string, hash string, version int")
    first = history.upsert(none, docs, "k")
    assert {r["action"] for r in first.collect()} == {"created"}
    again = history.upsert(first.select("k", "hash", "version"), docs, "k")
    assert {(r["action"], r["version"]) for r in again.collect()} == {("unchanged", 1)}


def test_blocked_content_is_substituted(spark):
    items = spark.createDataFrame([("a", "bad", 3), ("b", "ok", 1), ("c", "bad", 1)], "k string, hash string, at int")
    store = spark.createDataFrame([("a", "old", 1), ("a", "mid", 2), ("a", "bad", 3), ("c", "bad", 1)], "k string, hash string, at int")
    got = history.substitute_blocked(items, store, spark.createDataFrame([("bad",)], "hash string"), "k", "hash", ["at"])
    assert {(r["k"], r["hash"], r["substituted"]) for r in got.collect()} == {("a", "mid", True), ("b", "ok", False)}


def test_snapshot_counts_add_up(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, hash string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, hash string")
    assert {r["k"]: r["status"] for r in history.snapshot_diff(a, b, ["k"]).collect()} == {1: "gone", 2: "changed", 3: "unchanged", 4: "new"}


def test_fusion_prefers_what_both_lists_have(spark):
    lists = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 1), (1, "c", 2)], "qid long, id string, rank int")
    assert [r["id"] for r in search.fuse(lists).orderBy("rank").collect()] == ["b", "a", "c"]


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "y", 3)], "qid long, id string, rank int")
    rel = spark.createDataFrame([(1, "a"), (1, "z"), (2, "y"), (3, "q")], "qid long, id string")
    got = {r["qid"]: (r["recall"], r["rr"], r["zero"]) for r in search.evaluate(hits, rel).collect()}
    assert got == {1: (0.5, 1.0, False), 2: (1.0, pytest.approx(1 / 3, abs=1e-6), False), 3: (0.0, 0.0, True)}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(tx.ident_tokens(F.lit("see mart.daily-sales, a_b and x"))) == ["see", "see", "mart_daily_sales", "mart", "daily", "sales", "a_b", "a", "b", "and", "and", "x", "x"]
    assert sorted(one(tx.ident_terms(F.lit("see mart.daily-sales, a_b and x")))) == sorted(one(tx.ident_tokens(F.lit("see mart.daily-sales, a_b and x"))))
    assert one(tx.bigrams(F.lit("가나다 라 ab"), "[가-힣]")) == ["가나", "나다", "라"]
    assert one(tx.plain(F.lit("---\na: b\n---\n# T\n[x](y) `c` | d"))) == "T x c d"
    assert [tuple(s) for s in one(tx.sections(F.lit("intro\n## A\nbody\n## B\n")))] == [("", "intro\n"), ("A", "## A\nbody\n"), ("B", "## B\n")]
    assert one(tx.highlight(F.lit("a <Foo> foobar"), ["foo", "foobar"])) == "a &lt;<b>Foo</b>&gt; <b>foobar</b>"
    assert one(tx.holds_name(F.lit("run daily_sales_v2 now"), F.lit("daily_sales"))) is True
    assert one(tx.holds_name(F.lit("run my_daily_sales"), F.lit("daily_sales"))) is False
    assert one(tx.line_of(F.lit("a\nb\nc"), "c")) == 3 and one(tx.line_of(F.lit("a"), "z")) is None
    assert one(tx.duration_text(F.lit(3720))) == "1 h 2 min" and one(tx.safe_name(F.lit("/x/a b?.md"))) == "a_b_.md"
    assert one(F.call_function("rlike", F.lit("orders-v3"), tx.glob_regex(F.lit("orders-v?")))) is True


def test_dictionary_match_bounds(spark):
    d = spark.createDataFrame([(1, "Use daily_sales, not daily_salesX."), (2, "nothing")], "id long, t string")
    n = spark.createDataFrame([("e", "daily_sales"), ("f", "sales")], "entity string, name string")
    assert [(r["id"], r["entity"], r["at"]) for r in search.dictionary_match(d, n, "id", "t").collect()] == [(1, "e", 5)]


def test_incident_reports(spark):
    b = spark.createDataFrame([("INC-1", "# x (2024-01-02)\n[03:10] kim: disk full\n[03:12] lee: $ df\n see RB-7 or RB-OPS-7")], "key string, text string")
    lines = incidents.chat_lines(b, "key", "text").collect()
    assert [(r["at"], r["who"], r["text"]) for r in lines] == [("03:10", "kim", "disk full"), ("03:12", "lee", "$ df")]
    r = incidents.read_off(b, "key", "text").first()
    assert r["refs"] == ["RB-OPS-7"]
    clues = spark.createDataFrame([("a", 600)], "key string, at int")
    ev = spark.sql("SELECT 'a' AS key, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 'a', timestamp'2024-01-01 00:11:00'")
    assert str(incidents.nearest_event(clues, ev, "key", "at").first()["nearest"]) == "2024-01-01 00:11:00"
    t = incidents.merge_timeline([spark.createDataFrame([("a", 1, "sure")], "k string, at int, what string"), spark.createDataFrame([("a", 1, "maybe"), ("a", 2, "more")], "k string, at int, what string")], "k", "at")
    assert {(x["at"], x["what"]) for x in t.collect()} == {(1, "sure"), (2, "more")}


def test_health_and_questions(spark):
    d = spark.range(1).select(health.map_diff(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"), F.lit("c"), F.lit("1"))).alias("d")).first()["d"]
    assert (d["added"], d["removed"], d["changed"]) == (["c"], ["a"], ["b"])
    q = spark.createDataFrame([("who owns it",), ("a b c d e",), ("daily_sales",), (None,)], "q string")
    assert [r["n"] for r in q.select(asking.looks_natural("q").alias("n")).collect()] == [True, True, False, False]


def test_pairs_by_key_gives_every_pair_once_for_hot_keys(spark):
    uses = [(m, "hot") for m in range(90)] + [(m, f"k{m % 7}") for m in range(40)] + [(3, "hot"), (None, "hot"), (5, None)]
    got = graph.pairs_by_key(spark.createDataFrame(uses, "m long, k string").where("m IS NOT NULL"), "m", "k", block=8).collect()
    members: dict = {}
    for m, k in uses:
        if m is not None and k is not None:
            members.setdefault(k, set()).add(m)
    want = sorted((k, a, b) for k, ms in members.items() for a in ms for b in ms if a < b)
    assert sorted((r.k, r.a, r.b) for r in got) == want
    empty = spark.createDataFrame([], "m long, k string")
    assert graph.shared_asset_links(empty, "m", "k").collect() == []


def test_promoted_puts_an_exact_title_first_that_is_no_hit(spark):
    docs = spark.createDataFrame([(1, "Alpha", "en"), (2, "beta", "en"), (3, "alpha", "de"), (4, None, "en")], "id long, title string, lang string")
    hits = spark.createDataFrame([(7, 2, 1), (7, 3, 2), (7, 4, 3)], "qid long, id long, rank int")
    asked = spark.createDataFrame([(7, "ALPHA")], "qid long, query string")
    got = sorted(map(tuple, search.promoted(hits, docs, asked, 5, {"lang": "en"}).collect()), key=lambda r: r[2])
    assert got == [(7, 1, 1, True), (7, 2, 2, False), (7, 4, 3, False)]


def test_read_off_takes_quoted_commands_references_and_amounts(spark):
    rows = [("A", "ran `airflow dags list` and `ls`, see INC-12, RB-HDFS-3 and SOP-ETL-1"), ("A", "80 % full, 3.5GB left after 20 tries, INC-12")]
    got = incidents.read_off(spark.createDataFrame(rows, "i string, t string"), "i", "t").first()
    assert got["commands"] == ["airflow dags list"] and got["refs"] == ["INC-12", "RB-HDFS-3", "SOP-ETL-1"] and got["numbers"] == ["3.5GB", "80 %"]


def test_snippet_leaves_markup_out_and_starts_before_the_longest_word(spark):
    text = "## Head\n```\ncode needle\n```\n!!! note\n" + "x" * 50 + " the **needle** " + "y" * 100
    plain = "Head note".replace(" note", "") + " " + "x" * 50 + " the needle " + "y" * 100
    at = plain.index("needle") - 30
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    got = {r[0]: r[1] for r in rows.select("id", tx.snippet("t", "a needle in")).collect()}
    assert got == {1: "…" + plain[at : at + 90] + "…", 2: None, 3: ""}


def test_nearest_vectors_and_groups_match_all_pairs(spark):
    """Copies tie to the smaller id; null, odd and short vectors are compared as before; groups
    count as their pairs do, and no pair that was not a hit is made."""
    rng = random.Random(3)
    rows = [(i, [float(rng.choice([-1, 0, 1, 2])) for _ in range(4)], i % 3 if i % 7 else None) for i in range(400)]
    rows += [(500, None, 1), (501, [1.0, None, 2.0, 0.0], 1), (502, [1.0, 2.0], 2), (503, [0.0] * 4, 2), (700, [1.0, 2.0], 2)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))) + 1e-9
    pairs = search._scored(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("_v")), asked.withColumnRenamed("q", "_q"), norm)
    want = search.top(pairs, ["qid"], [F.desc("score"), F.asc("id")], 12).withColumn("score", F.round("score", 6))
    for block in (1000, 2):
        got = search.cosine_top(e.repartition(3), asked, 12, block=block)
        assert sorted(map(tuple, got.select("qid", "rank", "id", "score").collect()), key=str) == sorted(map(tuple, want.select("qid", "rank", "id", "score").collect()), key=str)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    labels, of = e.select(F.col("vec_id").alias("id"), "label"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    one = search.evaluate_groups(want, labels, of)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, search.evaluate(want, labels.join(of, "label").where("qid <> id")).collect()))
