"""Corpus pipeline: five stages from documents to a training mix.

Each stage works on what its predecessor kept; its result is written as Parquet in the shared
folder and read again. The first four return the columns of documents; the last returns the
blocks of the mix with the ids of the documents they are from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontam, line_dedup, mixing, queries, rule_ensemble, simhash
from tidewright.llm.common import SPACES, fresh
from tidewright.session import delete_at_exit, ensure_checkpoint_dir, remove, table


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble takes for good ones: a score of one half or more.

    Null and empty texts are scored like any other, and go if their score is low; texts are
    scored whole; repeated rows share their fate; an empty table gives an empty one; columns
    beside the text are untouched, whatever their names."""
    model, out = queries.quality_model(docs, spark, sf_dir), fresh(docs, "score")[0]
    return rule_ensemble.score(docs, model, out=out).where(F.col(out) >= 0.5).select(*_own(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks and runs of lines that an earlier place has; those that lose all of
    their words go.

    Null and empty texts stay as they are; texts are compared whole; of rows that repeat id and
    text each stays, for they count as one document; an empty table gives an empty one; a column
    that is named like the operator's own keeps its values."""
    taken = [c for c in docs.columns if c.lower() == "clean"]
    inner = docs.withColumnsRenamed(dict(zip(taken, fresh(docs, *taken), strict=True)))
    done = line_dedup.remove_repeats(inner)
    changed = F.col("clean.n_chunks") > 0
    done = done.where(~changed | (F.btrim("clean.text", F.lit(SPACES)) != ""))
    new = {"text": F.col("clean.text"), "n_chars": F.when(changed, F.char_length("clean.text").cast("long")).otherwise(F.col("n_chars"))}
    return done.select(*(new.get(old, F.col(f"`{own}`")).alias(old) for old, own in zip(docs.columns, inner.columns, strict=True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id: five-word shingles
    with a similarity of 0.8 or more.

    Texts without words (null, empty) are one group; texts are read whole; of rows that repeat
    id and text one stays; rows without an id come last; an empty table gives an empty one;
    other columns are untouched."""
    return simhash.first_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those that are half of them go.

    Null and empty texts stay; texts are read whole; repeated rows share their fate; an empty
    table gives an empty one; other columns are untouched."""
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"), n_chars="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in blocks: 150 % of all words, sources weighted.

    Null and empty texts have no words; null sources are one source; ids are of any type and may
    be null; of rows that repeat id and text each counts; an empty table gives no block; other
    columns are not read."""
    return mixing.mix_blocks(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", repeated_lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: Models, automata and fingerprints are not SQL. Tests hold each operator against brute force, and run()
#: and its stages against what they have to keep, on tables with nulls, repeats and clashing columns too.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents.

    A stage's table is removed once the last one is written; that one when the application ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    delete_at_exit(spark, folder)
    for k, (name, _) in enumerate(STAGES[:-1]):
        remove(spark, f"{folder}/{k}-{name}")
    return docs
