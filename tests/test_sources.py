"""Readers, parsers, converters, sinks and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewright.sources import convert, readers, scripts, sinks
from tidewright.streaming import rollup


def test_sql_tables():
    sql = "WITH a AS (SELECT * FROM s.t1), b AS (SELECT * FROM a JOIN `s`.`t2` x ON 1=1) INSERT OVERWRITE TABLE m.out PARTITION (dt='{{ ds }}') SELECT * FROM b, (SELECT 1 FROM t3) q LEFT JOIN m.out o ON 'from no' = '' -- from c\n"
    assert scripts.sql_tables(sql) == (["s.t1", "s.t2", "t3"], ["m.out"])
    assert scripts.sql_tables(None) == ([], []) and scripts.sql_tables("select 1") == ([], [])


def test_table_definitions():
    t = scripts.table_definitions("create table `d`.`t` (a ARRAY<STRUCT<x:INT,y:INT>> COMMENT 'it, is', b DECIMAL(12,2)) PARTITIONED BY (dt STRING) COMMENT 'note'")[0]
    assert (t["name"], t["comment"], t["partitions"]) == ("d.t", "note", ["dt"])
    assert [(c["name"], c["type"], c["comment"]) for c in t["columns"]] == [("a", "ARRAY<STRUCT<x:INT,y:INT>>", "it, is"), ("b", "DECIMAL(12,2)", None)]


def test_dag_script():
    d = scripts.dag_script('"""Doc."""\nwith DAG("d", schedule="@daily", default_args={"owner": "me", "retries": 3}):\n    a = Op(task_id="one", sql="insert into x select * from y")\n    b = Op(task_id="two")\n    c = Op(task_id="three")\n    a >> [b, c]\n    d = b << c\n')
    assert (d["dag_id"], d["owner"], d["retries"], d["description"]) == ("d", "me", 3, "Doc.")
    assert d["deps"] == [["one", "two"], ["one", "three"]] and d["tasks"][0]["writes"] == ["x"]
    assert scripts.dag_script("x = 1") is None and scripts.dag_script("def (") is None


def test_json_readers(spark):
    f = lambda s: spark.createDataFrame([("p/a.json", s)], "path string, text string")
    ix, al = readers.search_indices(f('{"cluster": "c", "indices": [{"index": "i-1", "health": "green", "docs_count": 5, "creation_date": "2024-01-01T00:00:00+09:00", "mappings": {"a": "long"}}], "aliases": {"i": "i-1"}}'))
    assert ix.first()["mapping"] == {"a": "long"} and tuple(al.first()) == ("i", "i-1")
    t = readers.tickets(f('{"key": "INC-1", "fields": {"summary": "s", "status": {"name": "Done"}, "labels": ["x"], "comment": {"comments": [{"body": "b"}]}}}')).first()
    assert (t["key"], t["status"], t["comments"][0]["body"]) == ("INC-1", "Done", "b")
    m = readers.metric_points(f('{"data": {"result": [{"metric": {"id": "m"}, "values": [[1704067200, "1.5"], [1704070800, null]]}]}}')).orderBy("ts").collect()
    assert [(r["metric_id"], r["v"]) for r in m] == [("m", 1.5), ("m", None)]


def test_bundles_and_files(spark, tmp_path):
    (tmp_path / "INC-1").mkdir()
    (tmp_path / "INC-1" / "a.md").write_text("x\ny")
    (tmp_path / "INC-1" / "b.json").write_text("{}")
    got = readers.bundles(readers.text_files(spark, str(tmp_path))).first()
    assert got["key"] == "INC-1" and got["files"] == {"a.md": "x\ny", "b.json": "{}"}


def test_fallback_to_the_last_snapshot(spark):
    old = spark.createDataFrame([("s", "k", "v1", 1), ("s", "k", "v2", 2), ("s", "gone", "v", 1), ("s", "gone", None, 2)], "source string, key string, payload string, seen_at int")
    snap = readers.last_snapshot(old, "s")
    assert [r["payload"] for r in snap.collect()] == ["v2"]
    out = readers.build(spark, {"s": {"kind": "tickets", "path": "/nowhere/at/all"}}, lambda name: snap)
    assert out["s"][1] is False
    with pytest.raises(Exception, match="(?i)path"):
        readers.build(spark, {"s": {"kind": "tickets", "path": "/nowhere/at/all"}})


def test_html_and_confluence():
    r = convert.from_html("<html><head><title>T</title><script>x</script></head><body><nav>n</nav><h1>H</h1><p>a <b>b</b> <a href='u'>l</a></p><ul><li>one<ul><li>two</li></ul></li></ul><pre>c  d\n e</pre><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>x|y</td></tr></table><blockquote><p>q</p></blockquote></body></html>")
    md = r["markdown"]
    assert r["title"] == "T" and "# H" in md and "a **b** [l](u)" in md and "- one" in md and "c  d\n e" in md and "| k | v |\n|---|---|\n| 1 | x\\|y |" in md and "> q" in md and "n\n" not in md.split("# H")[0]
    c = convert.from_confluence('<p>see <ac:link><ri:page ri:content-title="Page"/></ac:link></p><ac:structured-macro ac:name="info"><ac:rich-text-body><p>careful</p></ac:rich-text-body></ac:structured-macro><ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sql</ac:parameter><ac:plain-text-body><![CDATA[select a < b]]></ac:plain-text-body></ac:structured-macro><ac:structured-macro ac:name="jira"></ac:structured-macro>')
    assert "see Page" in c["markdown"] and "> [!INFO]" in c["markdown"] and "> careful" in c["markdown"] and "```\nselect a < b\n```" in c["markdown"] and c["warnings"] == ["unsupported macro: jira"]


def test_plain_text():
    r = convert.from_text("Guide\n\nSteps:\n- a\n* b\n\nhost: x\nport: 1\n\n    ls -l\n")
    assert r["title"] == "Guide" and "## Steps" in r["markdown"] and "- a\n- b" in r["markdown"] and "| host | x |" in r["markdown"] and "```\nls -l\n```" in r["markdown"]
    assert convert.decode("가".encode("cp949")) == "가" and convert.decode(b"\xef\xbb\xbfa") == "a"
    with pytest.raises(ValueError):
        convert.decode(b"x" * 5, most=4)


def test_converted_column(spark):
    df = spark.createDataFrame([("a.md", "# T\nx"), ("b.html", "<h1>H</h1>"), (None, None)], "n string, t string")
    got = [r["c"]["title"] for r in df.select(convert.converted(F.col("n"), F.col("t")).alias("c")).collect()]
    assert got == ["T", "H", None]


def test_sinks(spark, tmp_path):
    p = str(tmp_path)
    e = spark.createDataFrame([("dag:a", "reads", "table:t", "s"), ("index:i", "x", "y", "s")], "src string, rel string, dst string, source string")
    sinks.overwrite_edges(e, f"{p}/edges")
    sinks.overwrite_edges(e.where("src LIKE 'dag:%'").withColumn("rel", F.lit("writes")), f"{p}/edges")
    assert {(r["src"], r["rel"]) for r in spark.read.parquet(f"{p}/edges").collect()} == {("dag:a", "writes"), ("index:i", "x")}
    for v in ("v1", "v2"):
        sinks.publish(e.withColumn("v", F.lit(v)), f"{p}/ix", v, f"{p}/pointer")
        assert sinks.published(spark, f"{p}/pointer").first()["v"] == v
    d = spark.createDataFrame([("a", "created", 1), ("b", "unchanged", 1)], "k string, action string, version int")
    sinks.append_versions(d, f"{p}/versions", "run1")
    assert spark.read.parquet(f"{p}/versions").count() == 1
    page = spark.range(1).select(sinks.front_matter({"id": F.lit('a"b'), "x": F.lit(None)}, sinks.page(F.lit("T"), {"S": F.array(F.lit(1)), "E": F.array()})).alias("p")).first()["p"]
    assert page == '---\nid: "a\\"b"\n---\n# T\n\n## S\n- 1\n'


def test_streams(spark, tmp_path, sf):
    p = str(tmp_path)
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{p}/in")
    stream = rollup.event_stream(spark, f"{p}/in", events.schema, files_per_trigger=1)
    rollup.run_complete(rollup.metric_rollup(stream, "ts", "event_type", "value"), f"{p}/out", f"{p}/c1")
    batch = rollup.metric_rollup(events, "ts", "event_type", "value")
    key = lambda df: sorted((r["metric"], r["start"], r["n"], round(r["v"], 4)) for r in df.collect())
    assert key(spark.read.parquet(f"{p}/out")) == key(batch)
    items = events.select(F.col("user_id").alias("key"), F.col("event_type").alias("hash"))
    items.write.parquet(f"{p}/items")
    for _ in range(2):
        s = rollup.event_stream(spark, f"{p}/items", items.schema, files_per_trigger=1)
        rollup.run_batches(s, rollup.capture_versions(f"{p}/store", ["key"]), f"{p}/c2")
    assert spark.read.parquet(f"{p}/store").count() == items.distinct().count()


def test_table_names_are_lower_cased_and_lose_their_catalogue():
    assert scripts.sql_tables("INSERT INTO Cat.DB.Out SELECT * FROM Raw.Orders JOIN raw.orders") == (["raw.orders"], ["db.out"])
    assert scripts.table_definitions("CREATE TABLE `Cat`.`Mart`.Daily (a INT)")[0]["name"] == "mart.daily"


def test_text_files_are_text_whatever_they_look_like():
    assert "<p>" in convert.convert("notes.TXT", "<p>kept</p>")["markdown"]
