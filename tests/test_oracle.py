"""Every registered query against its DuckDB oracle on sf0.001 (the driver
checks sf0.01; the smaller tables add edge cases: tables with fewer rows
than seeds, nations without suppliers)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import TABLES, _digest  # noqa: E402
from conftest import SF001  # noqa: E402
from tablefill.plans.catalog import REGISTRY  # noqa: E402
from tablefill.plans.oracle import ORACLE  # noqa: E402

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert _digest(s_rows, df.columns)[0] == _digest(o_rows, o_cols)[0]


def test_every_query_has_an_oracle():
    assert set(REGISTRY) == set(ORACLE) <= set(QUERIES)
    assert set(ORACLE) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["run_id", "metric", "score", "queries"]
