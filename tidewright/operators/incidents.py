"""Incident reports: evidence, what can be read off it, claim checks, similar incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import NUMBER
from tidewright.operators.graph import pairs_by_key

#: Commands in back quotes, references to incidents and to runbooks, numbers with their unit
#: (fixed patterns).
COMMAND, REFERENCE = r"`([^`]{6,})`", r"INC-\d+|RB-[A-Z]+-\d+|SOP-[A-Z]+-\d+"
AMOUNT = r"(\d+(?:\.\d+)?)\s*(%|GB|시간|분|억|만|h)"
#: A line of a chat export.
CHAT = r"(?m)^\[([0-9]{2}:[0-9]{2})\] ([^:\n]+): ([^\n]*)"


def number_evidence(parts: DataFrame, incident: str, order: Sequence[str | Column]) -> DataFrame:
    """Evidence rows with id E1, E2, ... within their incident."""
    n = F.row_number().over(Window.partitionBy(incident).orderBy(*order))
    return parts.withColumn("evidence_id", F.concat(F.lit("E"), n.cast("string")))


def chat_lines(bundles: DataFrame, incident: str, text: str) -> DataFrame:
    """(incident, seq, at, who, text): the messages of chat exports."""
    lines = F.regexp_extract_all(F.col(text), F.lit(CHAT), F.lit(0))
    part = lambda k: F.regexp_extract("_line", CHAT, k)
    return bundles.select(incident, F.posexplode(lines).alias("seq", "_line")).select(incident, "seq", part(1).alias("at"), part(2).alias("who"), part(3).alias("text"))


def read_off(evidence: DataFrame, incident: str, text: str) -> DataFrame:
    """Per incident: commands, references and numbers with a unit in its evidence; distinct and
    sorted."""
    found = lambda p, group=0: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(group))))))
    return evidence.groupBy(incident).agg(found(COMMAND, 1).alias("commands"), found(REFERENCE).alias("refs"), found(AMOUNT).alias("numbers"))


def acknowledged(turns: DataFrame, incident: str, at: str, detected: Column, answered: Column) -> DataFrame:
    """Per incident: first_detected, first_answered after it, and the gap between them."""
    first = turns.groupBy(incident).agg(F.min(F.when(detected, F.col(at))).alias("first_detected"))
    later = turns.join(first, incident).where(answered & (F.col(at) > F.col("first_detected")))
    ack = later.groupBy(incident).agg(F.min(at).alias("first_answered"))
    return first.join(ack, incident, "left").withColumn("gap", F.col("first_answered") - F.col("first_detected"))


def check_claims(claims: DataFrame, evidence: DataFrame, claim_id: str = "claim_id", text: str = "text", cites: str = "cites", evidence_id: str = "evidence_id", body: str = "body") -> DataFrame:
    """claims with status: dropped if nothing is cited, a cited id does not exist, or a number
    of the claim is in no cited text; warn if an identifier of it is not; else ok."""
    known = evidence.select(F.col(evidence_id).alias("_e"), F.col(body).alias("_b"))
    cited = claims.select(claim_id, F.explode(cites).alias("_e")).join(known, "_e", "left")
    got = cited.groupBy(claim_id).agg(F.concat_ws("\n", F.array_sort(F.collect_list("_b"))).alias("_text"), F.bool_or(F.col("_b").isNull()).alias("_unknown"))
    rows = claims.join(got, claim_id, "left")
    inside = lambda p: F.forall(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)), lambda x: F.contains("_text", x))
    status = F.when(F.col("_text").isNull() | F.col("_unknown"), "dropped").when(~inside(NUMBER), "dropped").when(~inside(r"\b[a-z0-9]+(?:_[a-z0-9]+)+\b"), "warn").otherwise("ok")
    return rows.withColumn("status", status).drop("_text", "_unknown")


def check_citations(answers: DataFrame, text: str, n_sources: str) -> DataFrame:
    """answers with cited_ok: at least one [S#], each of them from 1 to the number of sources."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\[S([0-9]+)\]"), F.lit(1))
    ok = F.forall(found, lambda x: (x.cast("int") >= 1) & (x.cast("int") <= F.col(n_sources)))
    return answers.withColumn("cited_ok", (F.size(found) > 0) & ok)


def nearest_event(clues: DataFrame, events: DataFrame, incident: str, at: str) -> DataFrame:
    """clues (second of day in `at`) with the incident's event nearest by time of day; ties to
    the earlier one. Events of an incident are packed into its row: no pairs are shuffled."""
    packed = events.groupBy(incident).agg(F.array_sort(F.collect_list(F.struct("ts"))).alias("_ev"))
    sod = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    best = F.array_min(F.transform("_ev", lambda e: F.struct(F.abs(sod(e["ts"]) - F.col(at)).alias("d"), e["ts"].alias("ts"))))
    return clues.join(packed, incident, "left").withColumn("nearest", best["ts"]).drop("_ev")


def merge_timeline(parts: Sequence[DataFrame], incident: str, at: str) -> DataFrame:
    """Timelines in order of trust: of rows at the same time the most trusted stays."""
    rows = parts[0].withColumn("_p", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("_p", F.lit(k)))
    rest = [c for c in parts[0].columns if c not in (incident, at)]
    return rows.groupBy(incident, at).agg(F.min_by(F.struct(*rest), F.struct("_p", *rest)).alias("_r")).select(incident, at, "_r.*")


def similar(incidents: DataFrame, incident: str, entities: str, least: int = 2, refs: DataFrame | None = None) -> DataFrame:
    """(a, b, n_shared, referenced), a < b: incidents that share `least` entities or name one
    another. Only incidents with an entity in common are compared; an entity of very many is
    spread over tasks."""
    e = incidents.where(F.col(incident).isNotNull()).select(F.col(incident).alias("a"), F.explode(F.array_distinct(entities)).alias("e"))
    shared = pairs_by_key(e, "a", "e").groupBy("a", "b").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= least).withColumn("referenced", F.lit(False))
    if refs is not None:
        named = refs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct().select("a", "b", F.lit(0).cast("long").alias("n_shared"), F.lit(True).alias("referenced"))
        shared = shared.unionByName(named).groupBy("a", "b").agg(F.max("n_shared").alias("n_shared"), F.bool_or("referenced").alias("referenced"))
    return shared
