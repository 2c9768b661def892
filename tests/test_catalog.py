import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell.plans import catalog

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return float(v) if type(v).__name__ == "Decimal" else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, table", [("arithmetic", "lineitem"), ("order_nulls", "customer")])
def test_whole_tables(spark, name, table):
    assert catalog.queries()[name](spark, LARGER).count() == spark.read.parquet(f"{LARGER}/{table}.parquet").count()


def test_full_join_of_all_customers(spark):
    joined = catalog.queries()["join_full"](spark, LARGER)
    assert joined.filter("ca is not null").count() == spark.read.parquet(f"{LARGER}/customer.parquet").count()


def test_order_of_nulls(spark):
    got = [r.s for r in catalog.queries()["order_nulls"](spark, LARGER).collect()]
    assert None in got and got == sorted(got, key=lambda s: (s is None, s or ""))
