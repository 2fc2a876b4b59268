"""Every registered relational query against its SQL in an independent engine."""

import math
from collections import Counter
from pathlib import Path

import pytest

from querent.plans import registry

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, other, name):
    df = registry.queries()[name](spark, str(FOLDER))
    found = other.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(map(plain, r)) for r in found.fetchall())
    assert Counter(tuple(plain(r[n]) for n in names) for r in df.collect()) == want


def test_flagship(spark):
    assert registry.flagship(spark, str(FOLDER)).columns == ["segment", "orders", "total"]


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = registry.queries()["filter_ge"](spark, str(FOLDER))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThanOrEqual(p_size,25)]" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
    plan = registry.queries()["exists_correlated"](spark, str(FOLDER))._jdf.queryExecution().toString()
    assert "LeftSemi" in plan
