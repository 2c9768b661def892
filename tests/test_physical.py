"""The physical plans that Catalyst picks for the catalogue's queries, and that all of them agree."""

import re

import pytest

from tidewell.plans import catalog
from tidewell.plans.pipeline import Engine

SF = "/root/testdata/sf0.001"
JOIN = "SELECT {hint} o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark):
    for name in ("orders", "customer", "lineitem", "part"):
        spark.read.parquet(f"{SF}/{name}.parquet").createOrReplaceTempView(name)
    return Engine(spark)


@pytest.mark.parametrize("hint, node", [("BROADCAST(customer)", "BroadcastHashJoin"), ("MERGE(customer)", "SortMergeJoin"), ("SHUFFLE_HASH(customer)", "ShuffledHashJoin")])
def test_equi_joins(spark, tables, hint, node):
    found = spark.sql(JOIN.format(hint=f"/*+ {hint} */"))
    assert node in plan(found)
    assert sorted(found.collect()) == sorted(spark.sql(JOIN.format(hint="")).collect())


def test_large_sides_are_not_broadcast(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert "Broadcast" not in plan(tables.sql(JOIN.format(hint="")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_theta_join(tables):
    found = tables.sql("SELECT count(*) AS n FROM part a JOIN part b ON a.p_size < b.p_size AND a.p_retailprice > b.p_retailprice")
    assert re.search("BroadcastNestedLoopJoin|CartesianProduct", plan(found)) and found.first().n > 0


def test_aggregates_combine_before_the_shuffle(tables):
    found = plan(tables.sql("SELECT l_returnflag, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY l_returnflag"))
    assert "partial_sum" in found and "partial_count" in found
    assert found.index("functions=[sum(") < found.index("Exchange") < found.index("partial_sum")
    distinct = plan(tables.sql("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag"))
    assert "partial_count(distinct" in distinct


def test_collected_values_use_an_object_aggregate(tables):
    assert "ObjectHashAggregate" in plan(tables.sql("SELECT o_custkey, array_agg(o_orderkey) AS keys FROM orders GROUP BY o_custkey"))


def test_filters_and_columns_reach_the_scan(spark):
    found = plan(Engine(spark).sql(f"SELECT l_orderkey FROM '{SF}/lineitem.parquet' WHERE l_returnflag = 'R'"))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in found
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in found


def test_a_search_computes_each_distance_once(spark):
    for name in ("knn_l2", "knn_table_function"):
        found = plan(catalog.queries()[name](spark, SF))
        assert found.count("zip_with") == 1 and "TakeOrderedAndProject" in found
