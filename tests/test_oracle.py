"""Every SQL-checkable query against its DuckDB oracle on sf0.001, plus the
entry() smoke check and the contract between the two registries."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def canon(pdf):
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()[:19].replace("T", " ")
        if hasattr(v, "item"):
            return v.item()
        return v

    rows = [tuple(norm(r[c]) for c in cols) for _, r in pdf.iterrows()]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_registries_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 20


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "score_avocat" in df.columns


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.sql(E.oracle_sql()[name]).df()
    gc, gr = canon(got)
    wc, wr = canon(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
