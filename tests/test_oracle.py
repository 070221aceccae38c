"""Differential test: every registered query equals its DuckDB oracle (sf0.001)."""

import math
from collections import Counter

import duckdb
import pytest

from conftest import SF_SMALL

VIEWS = ["nation", "customer", "supplier", "part", "orders", "lineitem", "region"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{SF_SMALL}/{v}.parquet')")
    return con


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE"}


def _names():
    from haulage.oracle import all_statements
    return sorted(all_statements())


def test_every_query_has_an_oracle():
    from haulage.oracle import all_statements
    from haulage.plans.registry import all_queries
    assert set(all_queries()) == set(all_statements())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    so = sorted(range(len(cols)), key=lambda i: cols[i])
    do = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = Counter(tuple(_norm(r[i]) for i in so) for r in srows)
    b = Counter(tuple(_norm(r[i]) for i in do) for r in drows)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
    rel = duck.sql(E.oracle_sql()[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    assert spark_types == duck_types


def test_entry_smoke(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert len(rows) == 1
    assert rows[0]["total_logistics_cost"] > 0
