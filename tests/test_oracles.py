"""Every registered query against its SQL counterpart in DuckDB, on the smallest data."""

from __future__ import annotations

import glob
import math
import os
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

from appwatch.plans.registry import ORACLES, QUERIES

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None else str(v)


def test_every_query_has_a_counterpart():
    """The training-data queries, where they are present, have tests of their own."""
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_without_the_training_data_parts(tmp_path):
    """The entry still imports, and has all other queries, where these folders and the pipeline are gone."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "appwatch"), tmp_path / "appwatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    check = "import __spark_entry__ as e, appwatch; print(appwatch.__file__, *sorted(e.queries()), sep='\\n')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", check], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    where, *names = done.stdout.split()
    assert where.startswith(str(tmp_path)) and set(names) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, small, duck):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = Counter(tuple(_value(r[c]) for c in columns) for r in got.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    sql_types = {d[0]: str(d[1]) for d in result.description}
    at = [names.index(c) for c in columns]
    want = Counter(tuple(_value(r[i]) for i in at) for r in result.fetchall())
    assert rows == want
    for field in got.schema:
        expected = TYPES[field.dataType.simpleString()]
        if sql_types[field.name] not in ("HUGEINT", '"NULL"'):
            assert sql_types[field.name] == expected, field.name


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
