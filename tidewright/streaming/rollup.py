"""Structured Streaming forms of the roll-ups, and change capture by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.history import new_versions


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A stream of Parquet files."""
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)


def metric_rollup(events: DataFrame, at: str, kind: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(metric, start, n, v) per window; on a stream, rows later than `late` are dropped and
    state is bounded by it. Works on tables as well."""
    ts = events.withColumn(at, F.col(at).cast("timestamp"))
    ts = ts.withWatermark(at, late) if events.isStreaming else ts
    w = F.window(at, width)
    return ts.groupBy(w.alias("w"), F.col(kind).alias("metric")).agg(F.count("*").alias("n"), F.sum(value).alias("v")).select("metric", F.col("w.start").alias("start"), "n", "v")


def sessions(events: DataFrame, at: str, who: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(who, start, stop, n): bursts of activity with no pause of `gap`."""
    ts = events.withColumn(at, F.col(at).cast("timestamp"))
    ts = ts.withWatermark(at, late) if events.isStreaming else ts
    s = F.session_window(at, gap)
    return ts.groupBy(s.alias("s"), F.col(who)).agg(F.count("*").alias("n")).select(who, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the checkpoint makes a rerun go on from there, once."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and keep the whole result table: every batch replaces it."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.outputMode("complete").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """foreachBatch over what is there."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def capture_versions(store: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler that appends contents the store does not have yet. Each batch has
    a folder of its own that a replay of the batch replaces, so replays add nothing."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        from pyspark.errors import AnalysisException

        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(store).where(F.col("batch") < batch_id)
        except AnalysisException:
            stored = batch.limit(0).withColumn("batch", F.lit(0))
        new_versions(stored, batch, keys).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return handle
