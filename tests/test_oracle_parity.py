"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tidewright.plans import catalog

#: Queries that SQL does not express; each has a test of its own.
NO_SQL = {"html_convert", "version_diffs"}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_equals_sql(spark, db, sf, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    if name in NO_SQL:
        assert name not in catalog.oracle_sql() and got
        return
    cur = db.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()])
    assert got == want


def test_names_are_unique_and_sql_has_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) >= 70


def test_entry_works_without_the_training_subpackage(tmp_path):
    """A copy of the repository without it still imports and has its own queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidewright", tmp_path / "tidewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'metric_slo_eval' in q and 'op1_token_counts' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
