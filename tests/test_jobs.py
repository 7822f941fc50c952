"""Jobs, their log, and replay."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewright.operators import jobs
from tidewright.session import scratch

KIND = "id long, body string, hash string"


def boom():
    raise ValueError("no such source\nmore")


def test_soft_and_hard_steps(spark):
    log = jobs.Log(spark, scratch(spark, "log"), datetime(2024, 1, 2, 3, 4, 5))
    ok = jobs.Step("collect", "a", lambda: {"n": 2})
    done = jobs.run(log, "full-sync", [ok, jobs.Step("collect", "b", boom, soft=True), ok], note="x")
    assert done["status"] == "partial" and done["stats"] == {"n": 4} and done["run_id"].startswith("run-20240102-0304")
    with pytest.raises(ValueError, match="no such source"):
        jobs.run(log, "full-sync", [ok, jobs.Step("store", "c", boom), ok])
    same = jobs.Log(spark, log.path, datetime(2024, 1, 2, 3, 4, 5))
    assert jobs.run(same, "full-sync", [])["status"] == "success"
    steps = sorted((r["run_id"], r["seq"], r["status"], r["message"]) for r in log.steps().collect())
    assert [s[1:] for s in steps if s[0] == done["run_id"]] == [(1, "success", ""), (2, "failed", "ValueError: no such source"), (3, "success", "")]
    assert len(steps) == 5
    runs = {r["run_id"]: (r["status"], r["job"]) for r in log.runs().collect()}
    assert len(runs) == 3 and sorted(s for s, _ in runs.values()) == ["failed", "partial", "success"]


def test_a_held_lock_keeps_others_out(spark):
    log = jobs.Log(spark, scratch(spark, "log"))
    with log.locked():
        with pytest.raises(TimeoutError), log.locked(timeout=0.5):
            pass
    with log.locked(timeout=0.5):
        pass


def docs(spark, **bodies):
    df = spark.createDataFrame([(int(k[1:]), v) for k, v in bodies.items()] or [], "id long, body string")
    return df.withColumn("hash", F.sha2("body", 256))


def test_storing_again_changes_nothing(spark):
    store = jobs.Store(spark, scratch(spark, "store"), KIND)
    assert store.put(docs(spark, d1="a", d2="b"), "id", "2024-01-01") == {"created": 2, "updated": 0, "unchanged": 0}
    assert store.put(docs(spark, d1="a", d2="B", d3="c"), "id", "2024-01-02") == {"created": 1, "updated": 1, "unchanged": 1}
    for _ in range(2):  # the same moment once more replaces its part
        store.put(docs(spark, d1="a", d2="B", d3="c"), "id", "2024-01-02")
    got = sorted((r["id"], r["version"], r["body"], r["at"]) for r in store.versions().collect())
    assert got == [(1, 1, "a", "2024-01-01"), (2, 1, "b", "2024-01-01"), (2, 2, "B", "2024-01-02"), (3, 1, "c", "2024-01-02")]


def test_replay_gives_the_versions_of_a_live_run(spark):
    rows = [(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02"), (4, "2024-01-05")]
    table = spark.createDataFrame(rows, "n long, day string")
    moments = ["2024-01-01", "2024-01-03", "2024-01-02", "2024-01-09"]

    def made(df):
        one = df.agg(F.lit(1).cast("long").alias("id"), F.sum("n").cast("string").alias("body")).where("body IS NOT NULL")
        return one.withColumn("hash", F.sha2("body", 256))

    live = jobs.Store(spark, scratch(spark, "live"), KIND)
    for m in sorted(moments):
        live.put(made(spark.createDataFrame([r for r in rows if r[1] <= m], table.schema)), "id", m)
    store = jobs.Store(spark, scratch(spark, "store"), KIND)
    log = jobs.Log(spark, scratch(spark, "log"))
    done = jobs.replay(log, "history", moments, lambda m: [jobs.Step("store", "d", lambda: store.put(made(jobs.as_of(table, "day", m)), "id", m))])
    order = lambda s: sorted((r["id"], r["version"], r["body"], r["at"]) for r in s.versions().collect())
    assert order(store) == order(live) == [(1, 1, "1", "2024-01-01"), (1, 2, "6", "2024-01-02"), (1, 3, "10", "2024-01-09")]
    assert [d["run_id"][4:12] for d in done] == ["20240101", "20240102", "20240103", "20240109"]
