"""Every registered query against its SQL equivalent, and the plans' shape."""

from __future__ import annotations

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(one(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in entry.oracle_sql():
        assert rows
        return
    found = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(found.fetchall(), columns)


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_scans_are_pruned(spark):
    plan = entry.queries()["l1_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<label:int>" in plan and "PushedFilters: [" in plan
    plan = entry.queries()["event_log_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "user_id" not in plan


def test_the_rest_needs_no_training_data_package(tmp_path):
    """Without the optional folders the entry module still offers all other queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py", "corvane"):
        os.symlink(f"{root}/{name}", tmp_path / name) if name.endswith(".py") else None
    os.makedirs(tmp_path / "corvane")
    for name in os.listdir(f"{root}/corvane"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/corvane/{name}", tmp_path / "corvane" / name)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert 'ari' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=60)
