"""Shapes of physical plans: shuffles, scans, pushdown, no pairwise joins."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from arealis import operators as ops
from arealis.sources import load
from tests.plans import plan_of

ROOT = "/root/testdata/sf0.001"


def count(plan, name):
    """Number of operators of one kind in a formatted plan's tree."""
    tree = plan.split("\n\n")[0]
    return len(re.findall(rf"[-:] (?:\* )?{name}\b", tree))


@pytest.fixture(scope="module")
def lines(spark):
    return load(spark, ROOT, "lineitem")


def test_moving_average_is_one_shuffle(spark):
    events = load(spark, ROOT, "events")
    plan = plan_of(ops.moving_average(events, "user_id", "ts", "value", 7, large_keys=None))
    assert count(plan, "Exchange") == 1 and count(plan, "Sort") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def test_small_series_need_no_cut(spark):
    events = load(spark, ROOT, "events")
    plan = plan_of(ops.moving_average(events, "user_id", "ts", "value", 7))
    assert count(plan, "Exchange") == 1 and "_block" not in plan.split("\n\n")[0]


def test_documents_are_one_scan_and_one_shuffle(spark):
    events = load(spark, ROOT, "events")
    plan = plan_of(ops.moving_average_docs(events, "user_id", "ts", "value", 7, large_keys=None))
    assert count(plan, "Exchange") == 1 and count(plan, "Scan parquet") == 1


def test_requested_keys_reach_the_scan_through_the_window(spark):
    events = load(spark, ROOT, "events")
    docs = ops.moving_average_docs(events, "user_id", "ts", "value", 7, large_keys=None)
    plan = plan_of(ops.for_keys(docs, [3, 5, 3], "user_id"))
    assert "In(user_id, [3,5])" in plan


@pytest.mark.parametrize("features", [["l_quantity"], ["l_quantity", "l_discount", "l_tax"]])
def test_all_models_are_one_shuffle_of_partial_sums(lines, features):
    plan = plan_of(ops.linear_regression_by_key(lines, "l_suppkey", features, "l_extendedprice"))
    assert count(plan, "Exchange") == 1 and count(plan, "HashAggregate") == 2


def test_fit_and_test_are_one_scan(lines):
    plan = plan_of(
        ops.linear_regression_with_test(lines, "l_suppkey", ["l_quantity"], "l_extendedprice", id_cols=["l_orderkey"])
    )
    assert count(plan, "Exchange") == 1 and count(plan, "Scan parquet") == 1


def test_test_rows_are_reduced_before_they_meet_the_models(spark, lines):
    train, test = ops.train_test_split(lines, ["l_orderkey"], 80)
    models = ops.linear_regression_by_key(train, "l_suppkey", ["l_quantity"], "l_extendedprice")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(ops.linear_metrics_by_key(test, models, "l_suppkey", ["l_quantity"], "l_extendedprice"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the join uses the partitioning of the two aggregations
    assert count(plan, "Exchange") == 2 and count(plan, "SortMergeJoin") == 1


def test_compound_reads_each_leaf_once_in_one_shuffle(spark):
    orders = load(spark, ROOT, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    left = ops.Leaf(orders, ["o_orderkey"])
    right = ops.Leaf(orders.withColumnRenamed("o_totalprice", "price"), ["price", "o_orderkey"])
    for tree in ((left, "full", right), ((left, "inner", right), "inner", left)):
        plan = plan_of(ops.compound(tree, "k"))
        assert count(plan, "Exchange") == 1 and count(plan, "Scan parquet") == 2 and "Join" not in plan.split("\n\n")[0]


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_no_query_joins_every_pair(spark, name):
    plan = plan_of(contract.queries()[name](spark, "/root/testdata/sf0.01" if name == "bucket_auto" else ROOT))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
