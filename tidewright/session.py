"""Session-level helpers shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Contexts whose checkpoint folder is marked for deletion.
_MARKED: list = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, name: str = "tidewright") -> SparkSession:
    """A single-JVM session for tests and the local benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; only Spark touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark reaches."""
    fs, at = _path(spark, path)
    fs.delete(at, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends."""
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; a private folder only in a single local process
    (tests). The application's own folder in it goes when the application ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if re.fullmatch(r"local(\[.*\])?", sc.master) is None:
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tidewright-")
        sc.setCheckpointDir(shared)
    if sc not in _MARKED:
        _MARKED.append(sc)
        delete_at_exit(spark, sc.getCheckpointDir())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared checkpoint folder; it goes when the application ends."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there, so that its lineage
    ends and an executor that is lost later costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
