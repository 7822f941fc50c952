"""Sources as DataFrames: one reader per kind, explicit schemas, whole files as (path, text)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.history import content_hash


def text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, text): whole files below a path of any store that Spark reads."""
    r = spark.read.option("recursiveFileLookup", "true")
    df = (r.option("pathGlobFilter", glob) if glob else r).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def raw_items(df: DataFrame, source: str, kind: str, key: Column, payload: Column, origin: Column) -> DataFrame:
    """(source, kind, key, payload, origin, hash): what every connector yields; the hash is of
    the payload alone, so that when it was fetched does not count."""
    return df.select(F.lit(source).alias("source"), F.lit(kind).alias("kind"), key.cast("string").alias("key"), payload.cast("string").alias("payload"), origin.alias("origin")).withColumn("hash", content_hash("payload"))


SCHEDULER = "fetched_at string, dags array<struct<dag_id string, is_paused boolean, owners array<string>, timetable_description string, tags array<struct<name string>>>>, dag_runs map<string, array<struct<state string, start_date string, end_date string>>>"
SEARCH = "cluster string, engine string, fetched_at string, cluster_health string, indices array<struct<`index` string, health string, docs_count bigint, store_size string, creation_date string, mappings map<string,string>>>, aliases map<string,string>"
TICKET = "`key` string, fields struct<summary string, status struct<name string>, priority struct<name string>, created string, resolutiondate string, labels array<string>, assignee struct<displayName string>, description string, customfield_root_cause string, customfield_resolution string, comment struct<comments array<struct<created string, author struct<displayName string>, body string>>>>"
SERIES = "data struct<result array<struct<metric map<string,string>, `values` array<array<string>>>>>"


def scheduler_dags(files: DataFrame) -> DataFrame:
    """(dag_id, is_paused, owners, schedule, tags, runs): DAGs of scheduler snapshots with their
    runs, newest first; runs is empty where there are none."""
    s = files.select(F.from_json("text", SCHEDULER).alias("s")).select(F.explode("s.dags").alias("d"), F.col("s.dag_runs").alias("r"))
    runs = F.coalesce(F.element_at("r", F.col("d.dag_id")), F.array().cast("array<struct<state string, start_date string, end_date string>>"))
    return s.select("d.dag_id", "d.is_paused", "d.owners", F.col("d.timetable_description").alias("schedule"), F.col("d.tags.name").alias("tags"), runs.alias("runs"))


def search_indices(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Indices (cluster, index, health, docs, created, mapping) and aliases (alias, index) of
    search-engine snapshots."""
    s = files.select(F.from_json("text", SEARCH).alias("s")).select("s.*")
    ix = s.select("cluster", F.explode("indices").alias("i")).select("cluster", "i.index", "i.health", F.col("i.docs_count").alias("docs"), F.to_timestamp("i.creation_date").alias("created"), F.col("i.mappings").alias("mapping"))
    return ix, s.select(F.explode("aliases").alias("alias", "index"))


def tickets(files: DataFrame) -> DataFrame:
    """One row per incident ticket, fields flat, comments as an array."""
    t = files.select(F.from_json("text", TICKET).alias("t")).select("t.key", "t.fields")
    f = lambda p: F.col(f"fields.{p}")
    return t.select("key", f("summary").alias("summary"), f("status.name").alias("status"), f("priority.name").alias("priority"), F.to_timestamp(f("created")).alias("created"), F.to_timestamp(f("resolutiondate")).alias("resolved"), f("labels").alias("labels"), f("assignee.displayName").alias("assignee"), f("description").alias("description"), f("customfield_root_cause").alias("root_cause"), f("customfield_resolution").alias("resolution"), f("comment.comments").alias("comments"))


def bundles(files: DataFrame) -> DataFrame:
    """(key, files): a folder's files by name, as a map from name to text."""
    name, folder = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    entries = F.array_sort(F.collect_list(F.struct(name.alias("name"), "text")))
    return files.groupBy(folder.alias("key")).agg(F.map_from_entries(entries).alias("files"))


def metric_points(files: DataFrame) -> DataFrame:
    """(metric_id, ts, v): points of range queries; null values are kept."""
    r = files.select(F.explode(F.from_json("text", SERIES)["data"]["result"]).alias("r"))
    p = r.select(F.col("r.metric")["id"].alias("metric_id"), F.explode("r.values").alias("p"))
    return p.select("metric_id", F.timestamp_seconds(F.get("p", F.lit(0)).cast("double")).alias("ts"), F.get("p", F.lit(1)).try_cast("double").alias("v"))


def csv_rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of CSV files with a header: the named columns as strings (empty: null), and _file,
    _line (the header is line 1) and _raw. A file without a column gives nulls for it. A byte
    order mark is dropped; quoted line breaks are not expected."""
    text = F.regexp_replace("text", "^﻿", "")
    lines = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("_file"), F.split(text, r"\r?\n").alias("_l"))
    cells = lambda c: F.transform(F.split(c, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    rows = lines.select("_file", cells(F.get("_l", F.lit(0))).alias("_h"), F.posexplode("_l").alias("_p", "_raw")).where("_p > 0 AND trim(_raw) <> ''").withColumn("_c", cells(F.col("_raw")))
    value = lambda name: F.nullif(F.get("_c", (F.array_position("_h", name) - 1).cast("int")), F.lit(""))
    return rows.select(*(F.when(F.array_contains("_h", c), value(c)).alias(c) for c in columns), "_file", (F.col("_p") + 1).cast("long").alias("_line"), "_raw")


def last_snapshot(raw_versions: DataFrame, source: str) -> DataFrame:
    """The latest item of each key of a source, as of its last good load: what a failed reader
    falls back to. Keys that have gone since carry a tombstone payload of null and are left out."""
    rows = raw_versions.where(F.col("source") == source)
    rest = [c for c in rows.columns if c not in ("source", "key")]
    last = rows.groupBy("source", "key").agg(F.max_by(F.struct(*rest), "seen_at").alias("_r")).select("source", "key", "_r.*")
    return last.where("payload IS NOT NULL").select(*raw_versions.columns)


def as_of(rows: DataFrame, at: str, moment: Column) -> DataFrame:
    """Time travel: rows up to a moment."""
    return rows.where(F.col(at) <= moment)


#: Kinds of sources and the readers of their (path, text) files.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"scheduler": scheduler_dags, "search": lambda f: search_indices(f)[0], "tickets": tickets, "bundles": bundles, "metrics": metric_points}


def build(spark: SparkSession, sources: Mapping[str, Mapping[str, str]], fallback: Callable[[str], DataFrame | None] = lambda name: None) -> dict[str, tuple[DataFrame, bool]]:
    """name -> (rows, fresh) for sources {name: {kind, path, glob}}.

    A source whose path cannot be read gives its fallback rows, not fresh; without a fallback
    the error stands. A kind that is not known is an error."""
    from pyspark.errors import AnalysisException

    out = {}
    for name, s in sources.items():
        read = READERS[s["kind"]]
        try:
            out[name] = (read(text_files(spark, s["path"], s.get("glob"))), True)
        except AnalysisException:
            if (old := fallback(name)) is None:
                raise
            out[name] = (old, False)
    return out
