"""Queries run where executors have no copy of the library: workers start in another folder."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from tidewright.session import local_session
spark = local_session(4, 4)
try:
    spark.range(1).selectExpr("id").mapInPandas(lambda it: __import__("tidewright"), "id long").collect()
except Exception as gone:
    assert "tidewright" in str(gone)
else:
    raise AssertionError("workers see the library")
for name, query in e.queries().items():
    if name.startswith("op") and name[2].isdigit():
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
spark.read.parquet("/root/testdata/sf0.001/documents.parquet").createOrReplaceTempView("d")
import corpus_pipeline
print("ran pipeline", corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0)
"""


def test_workers_without_the_library(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == 14
