"""Registered queries against their SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexispark.plans.inputs import shared_inputs

SF = "/root/testdata/sf0.001"
TABLES = "documents conversations events".split()
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def inputs(spark):
    """Derived tables are made once for all queries."""
    with shared_inputs():
        yield


def plain(x):
    return round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x


def ordered(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(df.select(*columns).collect())
    result = duck.execute(entry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == columns
    want = ordered([[r[at[c]] for c in columns] for r in result.fetchall()])
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) and b is not None else a == b for a, b in zip(g, w, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
