"""A written inverted index of several fields, and searches that read it.

The index is a Parquet table of postings (field, term, id, tf, len), in folders by the hash of the
term, with a table of document frequencies laid out alike and one row of statistics per field. A
search joins its terms by folder and term: only the folders of its terms are read, and no text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.search import top
from tidewright.session import cut

K1, B = 1.2, 0.75
#: Most rows of asked terms that are sent to every executor.
FEW_TERMS = 100_000
#: Folders that terms are dealt to.
FOLDERS = 16


def _folder(term: str | Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


@dataclass(frozen=True)
class Index:
    """Where an index is, and over how many folders its terms are dealt."""

    path: str
    folders: int
    id_type: str

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        kinds = {"postings": f"id {self.id_type}, field string, len int, term string, tf int, folder int", "terms": "field string, term string, df long, folder int", "fields": "field string, n_docs long, avg_len double"}
        return spark.read.schema(kinds[name]).parquet(f"{self.path}/{name}")

    def hits(self, asked: DataFrame) -> DataFrame:
        """Postings (id, tf, len) of the terms asked for, with asked's columns, df, n_docs and avg_len.

        asked: stated terms, (field, term) and any more. Their statistics are looked up and written
        first. Only the folders of terms that are found are read; if these are FEW_TERMS at most, they
        go to the scan of the postings; more are joined by a shuffle."""
        spark = asked.sparkSession
        asked = asked.withColumn("folder", _folder("term", self.folders))
        known = cut(self._read(spark, "terms").join(asked, ["folder", "field", "term"]).join(self._read(spark, "fields"), "field"))
        folders = [r["folder"] for r in known.select("folder").distinct().collect()]  # no more than self.folders
        if known.count() <= FEW_TERMS:
            known = F.broadcast(known)
        return self._read(spark, "postings").where(F.col("folder").isin(folders)).join(known, ["folder", "field", "term"]).drop("folder")


def write_index(docs: DataFrame, doc_id: str, fields: Mapping[str, Column], path: str, folders: int = FOLDERS, runs: Sequence[str] = ()) -> Index:
    """Write the index of docs under path. fields: name -> array of tokens (null: none); of those
    named in runs the array holds runs of letters, which are cut into two-character pieces (a run of
    one stays as it is).

    len is the number of a field's tokens in a document, averages are over documents that have the
    field; every document is indexed, whole. A document's tokens are counted and its postings
    written where it is, by folders: no posting is shuffled, and texts are read once. A row without a
    term, in a folder of its own, keeps each document's len for the averages."""
    rows = docs.select(F.col(doc_id).alias("id"), *(F.coalesce(c, F.array().cast("array<string>")).alias(f"f{k}") for k, c in enumerate(fields.values())))
    kind = docs.schema[doc_id].dataType.simpleString()
    counted = rows.mapInArrow(_counted(list(fields), set(runs)), f"id {kind}, field string, len int, term string, tf int")
    dealt = counted.withColumn("folder", F.when(F.col("term").isNull(), -1).otherwise(_folder("term", folders)))
    dealt.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    index = Index(path, folders, kind)
    postings = index._read(docs.sparkSession, "postings")
    postings.where("folder = -1").groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")).write.mode("overwrite").parquet(f"{path}/fields")
    df = postings.where("folder >= 0").groupBy("folder", "field", "term").agg(F.count("*").alias("df"))
    df.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/terms")
    return index


def _counted(fields: list[str], runs: set[str], most: int = 2_000_000):
    """For mapInArrow: documents (id, an array of tokens per field) to postings, by term within some
    `most` bytes of documents. It is whole in itself: executors may not have this library."""

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def pieces(tokens, row):
            """Two-character pieces as numbers, and the row of each."""
            chars = np.frombuffer("\0".join(tokens.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            after, before = np.append(chars[1:], 0), np.append(0, chars[:-1])
            keep = (chars != 0) & ((after != 0) | (before == 0))
            return (chars << 21 | after)[keep], row[np.cumsum(chars == 0)[keep]]

        for batch in batches:
            step = max(1, int(most * batch.num_rows / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, n = part.column(0), part.num_rows
                for k, field in enumerate(fields, 1):
                    tokens = part.column(k).flatten()
                    if not len(tokens):
                        continue
                    row = np.repeat(np.arange(n), pc.list_value_length(part.column(k)).to_numpy(zero_copy_only=False))
                    if field in runs:
                        code, row = pieces(tokens, row)
                    else:
                        coded = tokens.dictionary_encode()
                        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                    lens = np.bincount(row, minlength=n)
                    key, tf = np.unique(code << 20 | row, return_counts=True)
                    own, row = key >> 20, key & (1 << 20) - 1
                    if field in runs:
                        own, place = np.unique(own, return_inverse=True)
                        names = pa.array([chr(c >> 21) + (chr(c & 0x1FFFFF) if c & 0x1FFFFF else "") for c in own.tolist()], pa.string())
                        terms = names.take(pa.array(place))
                    else:
                        terms = coded.dictionary.take(pa.array(own))
                    held = np.flatnonzero(lens)
                    rows = np.concatenate([row, held])
                    terms = pa.concat_arrays([terms.cast(pa.string()), pa.nulls(len(held), pa.string())])
                    tf = np.concatenate([tf, np.zeros(len(held), tf.dtype)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array([field]).take(pa.array(np.zeros(len(rows), np.int64))), pa.array(lens[rows].astype(np.int32)), terms, pa.array(tf)], names=["id", "field", "len", "term", "tf"])

    return count


def _scores(hits: DataFrame) -> DataFrame:
    """hits (qid, id, field, boost, tf, len, df, n_docs, avg_len) with each one's BM25 times its boost."""
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    return hits.withColumn("score", F.col("boost") * idf * F.col("tf") * (K1 + 1) / norm)


def search(index: Index, terms: DataFrame, most: Mapping[str, float], best: Mapping[str, float] = {}, least: float = 0.6, limit: int = 50, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank): documents that match any clause of a question, best first.

    terms: (qid, field, term), a question's terms as each field's analyser gives them. Clause one
    adds up the scores of all fields of `most` (field -> boost). Clause two takes the best field of
    `best` among those where a document has at least the share `least` of the question's terms,
    rounded down, and one at least. Scores of both add up. allowed: (id) of the documents that
    filters let pass; they apply before ranks are cut. Ties go to the smaller id; ranks are by
    the score at full precision, but for the last digits that depend on the order of addition."""
    asked = terms.select("qid", "field", "term").distinct()
    boosts = {**most, **best}
    need = asked.groupBy("qid", "field").agg(F.greatest(F.lit(1), F.floor(F.count("*") * least)).alias("need"))
    boost = F.coalesce(*(F.when(F.col("field") == f, F.lit(float(b))) for f, b in boosts.items()))
    hits = index.hits(asked.join(need, ["qid", "field"]).withColumn("boost", boost).where("boost IS NOT NULL"))
    if allowed is not None:
        hits = hits.join(allowed.select("id").distinct(), "id", "left_semi")
    per = _scores(hits).groupBy("qid", "id", "field", "need").agg(F.sum("score").alias("score"), F.count("*").alias("matched"))
    late = F.col("field").isin(*best)
    first = F.sum(F.when(~late, F.col("score")))
    second = F.max(F.when(late & (F.col("matched") >= F.col("need")), F.col("score")))
    scored = per.groupBy("qid", "id").agg(first.alias("first"), second.alias("second")).where("first IS NOT NULL OR second IS NOT NULL")
    scored = scored.select("qid", "id", (F.coalesce("first", F.lit(0.0)) + F.coalesce("second", F.lit(0.0))).alias("score"))
    return top(scored, ["qid"], [F.desc(F.round("score", 9)), F.asc("id")], limit).withColumn("score", F.round("score", 6))


def question_terms(questions: DataFrame, analysers: Mapping[str, Column], qid: str = "qid") -> DataFrame:
    """(qid, field, term): the terms of each question for each field. analysers: field -> array of
    tokens of the question's text."""
    rows: Sequence[Column] = [F.struct(F.lit(f).alias("field"), c.alias("tokens")) for f, c in analysers.items()]
    return questions.select(F.col(qid).alias("qid"), F.explode(F.array(*rows)).alias("f")).select("qid", "f.field", F.explode("f.tokens").alias("term")).distinct()
