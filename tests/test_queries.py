"""Every query with an oracle, against DuckDB on the same files."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from gridloom.plans import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def rows(frame, columns):
    def plain(v):
        if pd.isna(v):
            return "null"
        return repr(round(float(v), 6)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_duckdb(spark, duck, name):
    got, want = queries.queries()[name](spark, DIR).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(queries.queries().keys() - queries.oracle_sql().keys()))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= entry.oracle_sql().keys()


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    keep = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "repo", ignore=keep)
    code = (
        "import __spark_entry__ as e; from pyspark.sql import SparkSession; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q);"
        "assert e.oracle_sql().keys() <= q.keys(); s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert e.entry(s).count() > 0"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr[-3000:]
