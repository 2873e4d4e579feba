"""Driver contract: entry() smoke, every query runs on sf0.001, and every
oracle query agrees with DuckDB on the same Parquet files."""

import hashlib
import json
import math

import pytest

import __spark_entry__ as E
from revlens.plans.catalog import QUERIES
from revlens.plans.oracle import ORACLE
from revlens.sources.tables import TABLES


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "segment" in df.columns


def test_the_contract_lists_every_query():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_query_has_unique_aliased_columns(spark, sf_small):
    for name in sorted(QUERIES):
        if name in ORACLE:
            continue
        df = QUERIES[name](spark, sf_small)
        assert len(set(df.columns)) == len(df.columns), name
        df.limit(5).collect()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T", " ")
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck(sf_small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_agrees(spark, sf_small, duck, name):
    df = QUERIES[name](spark, sf_small)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _digest(df.columns, srows) == _digest(ocols, orows)
