"""Every query with an SQL counterpart against DuckDB on the smallest tables, and rules the package keeps."""

import os
import re
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import normal_form  # noqa: E402
from tidemark.plans import oracle  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for name in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_matches_sql(spark, sf, con, name):
    a = normal_form(entry.queries()[name](spark, sf).toPandas())
    b = normal_form(con.execute(entry.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    assert len(a)
    assert ((a == b) | (a.isna() & b.isna())).all().all()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 9


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_package_never_collects_or_cuts_lineage_locally():
    banned = re.compile(r"\.toPandas\(|\.collect\(\)|localCheckpoint\(|\.crossJoin\(|\.rdd\b|F\.broadcast\(")
    for folder, _, files in os.walk(os.path.join(ROOT, "tidemark")):
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert not banned.search(text.read()), f


def test_one_exchange_serves_windows_of_a_chunk(spark):
    from helpers import long_panel
    from tidemark.operators import features as X
    panel = long_panel(spark, {"a": range(50)})
    plan = X.lag_features(panel.withColumn("dt", __import__("pyspark").sql.functions.current_date()), ["series_id", "col"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
