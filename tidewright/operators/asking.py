"""Questions in natural language, answered by rules: intents, context bundles, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Question words that make a query a question (a fixed list).
QUESTION = r"(?i)\?|^(?:who|what|when|where|why|which|how|is|are|was|did|does)\b"


def looks_natural(query: str | Column, least_words: int = 5) -> Column:
    """Is a query a question, or of at least so many words?"""
    q = F.col(query) if isinstance(query, str) else query
    return F.coalesce(q.rlike(QUESTION) | (F.size(F.filter(F.split(F.btrim(q), r"\s+"), lambda w: w != "")) >= least_words), F.lit(False))


def intent(query: str | Column, keywords: Mapping[str, Sequence[str]], default: str = "search") -> Column:
    """The first intent one of whose keywords is in the query, whatever the case."""
    q = F.lower(F.col(query) if isinstance(query, str) else query)
    out = None
    for name, words in keywords.items():
        hit = F.lit(False)
        for w in words:
            hit |= F.contains(q, F.lit(w.lower()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out.otherwise(default), F.lit(default))


def context_bundle(entities: DataFrame, down: DataFrame, up: DataFrame, incidents: DataFrame, runbooks: DataFrame, key: str = "id") -> DataFrame:
    """entities with what flows from and to them, and their incidents and runbooks: sorted
    arrays, empty where there are none. down and up: (id, other, distance); the other two:
    (id, ids). Each side is gathered per entity before its join."""
    def near(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("distance", "other"))).alias(name))

    out = entities.join(near(down, "downstream"), key, "left").join(near(up, "upstream"), key, "left")
    out = out.join(incidents.select(key, F.col("ids").alias("incidents")), key, "left").join(runbooks.select(key, F.col("ids").alias("runbooks")), key, "left")
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("downstream", "upstream", "incidents", "runbooks")}
    return out.withColumns(empty)


def rule_answer(asked: DataFrame, bundles: DataFrame, key: str = "id") -> DataFrame:
    """asked (qid, intent, id) with an answer for owner, status and impact questions, else null."""
    rows = asked.join(bundles, key, "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    answer = (
        F.when(F.col("title").isNull(), F.lit(None))
        .when(F.col("intent") == "owner", F.concat("title", F.lit(" is owned by "), F.coalesce("team", F.lit("nobody")), F.lit(" [S1]")))
        .when(F.col("intent") == "status", F.concat("title", F.lit(" is "), F.coalesce("status", F.lit("unknown")), F.lit(" [S1]")))
        .when(F.col("intent") == "impact", F.concat("title", F.lit(" affects "), n("downstream"), F.lit(" entities [S1]")))
    )
    return rows.select("qid", "intent", key, answer.alias("answer"))
