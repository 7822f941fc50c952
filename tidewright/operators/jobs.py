"""Jobs of hard and soft steps with an append-only log, and the replay of history through them.

The log has two Parquet tables in a folder that all share: steps, a row per step as it ends, and
runs, a row as a run starts and one as it ends. Nothing in it is changed later; what a run's state
is, is read off its last row. One run at a time holds the lock of its log."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import history

STEPS = "run_id string, seq int, stage string, target string, status string, started timestamp, ms double, stats map<string, long>, message string"
RUNS = "run_id string, job string, trigger string, actor string, status string, at timestamp, note string"


@dataclass(frozen=True)
class Step:
    """A piece of work that returns counts. A soft one may fail, and the run goes on as partial."""

    stage: str
    target: str
    work: Callable[[], Mapping[str, int]]
    soft: bool = False


@dataclass
class Log:
    """A log's folder; `at` sets the clock to a moment of the past, from which it goes on."""

    spark: SparkSession
    path: str
    at: datetime | None = None
    _began: float = field(default_factory=time.monotonic)

    def now(self) -> datetime:
        if self.at is None:
            return datetime.now(UTC).replace(tzinfo=None)
        return self.at + timedelta(seconds=time.monotonic() - self._began)

    def _append(self, name: str, kind: str, row: tuple) -> None:
        self.spark.createDataFrame([row], kind).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str, kind: str) -> DataFrame:
        fs, at = self._file(name)
        if not fs.exists(at):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}")

    def _file(self, name: str) -> tuple:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def steps(self) -> DataFrame:
        return self._read("steps", STEPS)

    def runs(self) -> DataFrame:
        """One row per run: its last state, and when it started."""
        rows = self._read("runs", RUNS).groupBy("run_id").agg(F.max_by(F.struct("job", "trigger", "actor", "status", "at", "note"), F.struct("at", F.col("status") != "running")).alias("r"), F.min("at").alias("started"))
        return rows.select("run_id", "started", "r.*")

    @contextmanager
    def locked(self, timeout: float = 30.0):
        """Hold the log's lock: a file that only one can create."""
        fs, at = self._file("lock")
        end = time.monotonic() + timeout
        while True:
            try:
                fs.create(at, False).close()
                break
            except Exception as taken:
                if "exist" not in str(taken).lower() or time.monotonic() > end:
                    raise TimeoutError(f"{self.path} is locked") if "exist" in str(taken).lower() else taken from None
                time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(at, False)


def run(log: Log, job: str, steps: Sequence[Step], trigger: str = "manual", actor: str | None = None, note: str = "") -> dict:
    """Run the steps in order and log each: run_id, status (success, partial) and the sum of counts.

    A soft step that fails is logged with its error, and the run ends as partial; a hard one ends
    the run as failed, and its error is raised once that is logged. Runs that start in one second
    get different ids."""
    with log.locked():
        started = log.now()
        base = f"run-{started:%Y%m%d-%H%M%S}-{job.split('-')[0]}"
        taken = {r["run_id"] for r in log.runs().where(F.col("run_id").startswith(base)).select("run_id").collect()}
        run_id = next(x for n in range(1, len(taken) + 2) if (x := base if n == 1 else f"{base}-{n}") not in taken)
        log._append("runs", RUNS, (run_id, job, trigger, actor, "running", started, note))
        status, totals = "success", {}
        for seq, step in enumerate(steps, 1):
            began, clock = log.now(), time.perf_counter()
            try:
                stats, state, message = dict(step.work()), "success", ""
            except Exception as ex:
                stats, state, message = {}, "failed", f"{type(ex).__name__}: {re.split(chr(10), str(ex), maxsplit=1)[0]}"
                error = ex
            log._append("steps", STEPS, (run_id, seq, step.stage, step.target, state, began, (time.perf_counter() - clock) * 1000, stats, message))
            for k, v in stats.items():
                totals[k] = totals.get(k, 0) + v
            if state == "failed":
                if not step.soft:
                    log._append("runs", RUNS, (run_id, job, trigger, actor, "failed", log.now(), message))
                    raise error
                status = "partial"
        log._append("runs", RUNS, (run_id, job, trigger, actor, status, log.now(), note))
        return {"run_id": run_id, "status": status, "stats": totals}


@dataclass(frozen=True)
class Store:
    """Versions (key, version, hash and what else documents have, at) in a folder, one
    part per store of documents. A part is written whole under its moment, so that to store the same
    again after a failure replaces it."""

    spark: SparkSession
    path: str
    kind: str

    def versions(self, before: str | None = None) -> DataFrame:
        """All versions, or those of parts before a moment."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return self.spark.createDataFrame([], f"{self.kind}, version int, at string")
        rows = self.spark.read.schema(f"{self.kind}, version int, at string").parquet(self.path)
        return rows if before is None else rows.where(F.col("at") < before)

    def put(self, docs: DataFrame, key: str, moment: str) -> dict[str, int]:
        """Append the documents that are new or changed since the last version before the moment;
        counts of created, updated and unchanged."""
        was = self.versions(moment)
        out = history.upsert(was.select(key, "hash", "version"), docs, key).withColumn("version", F.col("version").cast("int"))
        part = f"{self.path}/at={moment}"
        kept = out.where("action <> 'unchanged'")
        kept.drop("action").write.mode("overwrite").parquet(part)
        counts = {r["action"]: r["n"] for r in out.groupBy("action").agg(F.count("*").alias("n")).collect()}
        return {a: counts.get(a, 0) for a in ("created", "updated", "unchanged")}


def as_of(df: DataFrame, at: str, moment: str) -> DataFrame:
    """The rows of an append-only table that were there at a moment."""
    return df.where(F.col(at) <= F.lit(moment).cast(df.schema[at].dataType))


def replay(log: Log, job: str, moments: Sequence[str], steps_at: Callable[[str], Sequence[Step]]) -> list[dict]:
    """Run a job once per moment, in order of time, each with the steps that steps_at gives for
    tables as they were then, and with its clock set to then."""
    done = []
    for moment in sorted(moments):
        then = Log(log.spark, log.path, datetime.fromisoformat(moment))
        done.append(run(then, job, steps_at(moment), trigger="replay"))
    return done
