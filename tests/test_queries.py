"""Every registered query runs on the smallest tables and matches its SQL oracle."""

import duckdb
import pytest

import __spark_entry__ as E
from fianchetto.plans.catalog import QUERIES
from tests.conftest import SMALL

TABLES = ["orders", "lineitem", "events", "embeddings"]
CORE = sorted(k for k in E.oracle_sql() if k in QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def _norm(rows):
    return sorted(tuple("None" if v is None else repr(v) if isinstance(v, float) else str(v) for v in r)
                  for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    cols = df.columns
    got = [tuple(r[c] for c in sorted(cols)) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    exp = [tuple(r[dcols.index(c)] for c in sorted(cols)) for r in res.fetchall()]
    assert _norm(got) == _norm(exp)


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) > 0


def test_every_core_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql())
