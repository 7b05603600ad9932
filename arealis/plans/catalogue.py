"""Catalogue queries: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis import operators as ops
from arealis.functions import int_range, normalize_key, parse_date, slice_from, window_means
from arealis.operators.grouping import MAX_ARRAY
from arealis.sources import explode_json_objects, from_json_rows, load, stats_table, to_json_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- inputs

LINE_ID = ("l_orderkey", "l_linenumber", "l_partkey")
LINE_FEATURES = ("l_quantity", "l_discount")


def daily_values(spark: SparkSession, root: str) -> DataFrame:
    """One row per user and day: user_id, day, total, n."""
    return (
        load(spark, root, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    )


def order_totals(spark: SparkSession, root: str) -> DataFrame:
    """One row per customer with orders: c_custkey, order_total, order_count."""
    return (
        load(spark, root, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.sum("o_totalprice").alias("order_total"), F.count(F.lit(1)).alias("order_count"))
    )


def customer_stats(spark: SparkSession, root: str) -> DataFrame:
    """Numeric features of each customer; null totals for those without orders."""
    return load(spark, root, "customer").join(order_totals(spark, root), "c_custkey", "left")


CUSTOMER_FEATURES = ("c_acctbal", "order_total", "order_count")


def line_split(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return ops.train_test_split(load(spark, root, "lineitem"), LINE_ID, 80)


# ---------------------------------------------------------------- counts and stages


@query
def count_tables(spark, root):
    return ops.count_tables(spark, root, ["orders", "customer", "events", "orders", "nation"])


@query
def scan_statistics_table(spark, root):
    customers, suppliers = load(spark, root, "customer"), load(spark, root, "supplier")
    tables = {"county_stats": customers, "state_stats": suppliers}
    return stats_table("County", tables).groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("avg_balance")
    )


@query
def match_project(spark, root):
    orders = load(spark, root, "orders")
    return (
        ops.match(orders, {"o_orderstatus": "F"})
        .transform(ops.project, include=["o_orderkey", "o_custkey", "o_totalprice"])
        .transform(ops.add_fields, source=F.lit("orders"), half_price=F.round(F.col("o_totalprice") / 2, 4))
        .transform(ops.rename, {"o_totalprice": "price"})
    )


@query
def match_operators(spark, root):
    lines = load(spark, root, "lineitem")
    spec = {
        "l_quantity": {"$gte": 5, "$lt": 45},
        "l_returnflag": {"$in": ["A", "R"]},
        "l_linestatus": {"$ne": "X"},
        "l_suppkey": {"$nin": [1, 2, 3]},
        "$or": [{"l_discount": {"$gt": 0.05}}, {"l_tax": {"$lte": 0.02}}, {"l_returnflag": {"$regex": "^R"}}],
    }
    return ops.match(lines, spec).transform(
        ops.project, exclude=["l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    )


@query
def match_arrays(spark, root):
    """Customers by their orders as an array, and a text without regard to case."""
    made = load(spark, root, "orders").groupBy("o_custkey").agg(
        F.collect_list(F.struct("o_orderkey", "o_totalprice", "o_orderdate")).alias("orders"),
        F.collect_set("o_orderstatus").alias("states"),
        F.max("o_orderpriority").alias("priority"),
    )
    spec = {
        "o_custkey": {"$mod": [3, 1]},
        "orders": {"$not": {"$size": 2}, "$elemMatch": {"o_totalprice": {"$gt": 150_000}, "o_orderdate": {"$lt": dt.date(1999, 1, 1)}}},
        "states": {"$all": ["F", "O"], "$elemMatch": {"$in": ["P", "O"], "$ne": "P"}},
        "priority": {"$regex": "^[1-4].*(low|not|high)", "$options": "i"},
    }
    return ops.match(made, spec).select("o_custkey", "priority", F.size("orders").cast("bigint").alias("n"))


@query
def reader_options(spark, root):
    """A scan of two columns by a given schema, with options of the reader."""
    orders = load(
        spark, root, "orders", schema="o_orderkey bigint, o_totalprice double", options={"mergeSchema": "false", "recursiveFileLookup": "true"}
    )
    return orders.where("o_totalprice > 100000")


@query
def match_dates(spark, root):
    """Dates compared in the column's own type, absence, and a negated group."""
    orders = load(spark, root, "orders").withColumn(
        "big", F.when(F.col("o_totalprice") > 300_000, F.col("o_totalprice"))
    )
    spec = {
        "o_orderdate": {"$gte": dt.datetime(1994, 2, 1), "$lt": dt.date(1999, 7, 1)},
        "big": {"$exists": True, "$not": {"$gt": 450_000.0}},
        "$nor": [{"o_orderstatus": "P"}, {"o_orderpriority": {"$regex": "LOW$"}}],
        "$and": [{"o_custkey": {"$ne": 7}}, {"o_custkey": {"$gt": 3}}],
    }
    return ops.match(orders, spec).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "big")


@query
def drop_incomplete(spark, root):
    return ops.select_features(customer_stats(spark, root), "c_custkey", ["c_acctbal", "order_count"]).transform(
        ops.drop_incomplete, ["order_count"]
    )


@query
def group_accumulators(spark, root):
    return ops.group(
        load(spark, root, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {
            "sum_quantity": F.round(ops.total("l_quantity"), 4),
            "avg_price": F.round(ops.mean("l_extendedprice"), 4),
            "min_price": ops.least("l_extendedprice"),
            "max_price": ops.greatest("l_extendedprice"),
            "std_pop": F.round(ops.std_pop("l_quantity"), 6),
            "std_samp": F.round(ops.std_samp("l_quantity"), 6),
            "n": ops.rows(),
        },
    )


@query
def group_first_last(spark, root):
    order = ["o_orderdate", "o_orderkey"]
    return ops.group(
        load(spark, root, "orders"),
        "o_custkey",
        {"first_price": ops.first("o_totalprice", order), "last_status": ops.last("o_orderstatus", order)},
    )


@query
def group_push(spark, root):
    """Orders of each customer as an ordered array, unrolled to check every place."""
    pushed = ops.group(
        load(spark, root, "orders"),
        "o_custkey",
        {"n": ops.rows(), "orders": ops.push(["o_orderkey", "o_totalprice"], ["o_orderdate", "o_orderkey"])},
    )
    return ops.unwind(pushed, "orders", index="place").select(
        "o_custkey", "part", "n", F.col("place").cast("bigint").alias("place"), "orders.o_orderkey", "orders.o_totalprice"
    )


@query
def group_push_cut(spark, root):
    """Line items of each supplier's return flag: three keys hold everything, in arrays of 100 elements."""
    pushed = ops.group(
        load(spark, root, "lineitem"),
        "l_returnflag",
        {
            "n": ops.rows(),
            "lines": ops.push(["l_orderkey", "l_linenumber"], ["l_shipdate", "l_orderkey", "l_linenumber"], max_array=100),
            "prices": ops.push("l_extendedprice", ["l_shipdate", "l_orderkey", "l_linenumber"], max_array=100),
        },
        rows_per_task=1_500,
    )
    both = pushed.select("l_returnflag", "part", "n", F.explode(F.arrays_zip("lines", "prices")).alias("e"))
    return both.select(
        "l_returnflag", "part", "n", "e.lines.l_orderkey", "e.lines.l_linenumber", F.col("e.prices").alias("l_extendedprice")
    )


@query
def group_add_to_set(spark, root):
    sets = ops.group(load(spark, root, "lineitem"), "l_suppkey", {"flags": ops.add_to_set("l_returnflag")})
    return sets.select("l_suppkey", F.array_join("flags", ",").alias("flags"))


@query
def sort_limit(spark, root):
    spec = {"o_totalprice": -1, "o_orderkey": 1}
    return ops.sort(load(spark, root, "orders"), spec).offset(10).limit(50).select("o_orderkey", "o_totalprice")


@query
def sort_by_count(spark, root):
    return ops.sort_by_count(load(spark, root, "lineitem"), "l_suppkey")


@query
def count_matching(spark, root):
    return ops.match(load(spark, root, "lineitem"), {"l_quantity": {"$gt": 25}}).transform(ops.count_rows, "n")


@query
def unwind(spark, root):
    vectors = load(spark, root, "embeddings")
    return ops.unwind(vectors, "embedding", index="place").select(
        "vec_id", F.col("place").cast("bigint").alias("place"), F.col("embedding").cast("double").alias("component")
    )


@query
def lookup(spark, root, max_array=MAX_ARRAY):
    """Orders of every customer; the arrays are reduced to their size and sum, over all arrays of a customer."""
    orders = load(spark, root, "orders")
    return ops.lookup(
        load(spark, root, "customer").select("c_custkey", "c_nationkey"),
        orders,
        "c_custkey",
        "o_custkey",
        "orders",
        fields=["o_orderkey"],
        order=["o_orderkey"],
        max_array=max_array,
        sums={
            "n_orders": lambda found: F.size(found).cast("bigint"),
            "sum_keys": lambda found: F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, o: acc + o["o_orderkey"]),
        },
    )


@query
def union_with(spark, root):
    customers = load(spark, root, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = load(spark, root, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return ops.union_with(customers, suppliers)


@query
def replace_root(spark, root):
    nested = load(spark, root, "part").select(
        F.struct("p_partkey", F.upper("p_name").alias("p_name"), "p_size").alias("doc"), "p_brand"
    )
    return ops.replace_root(nested, "doc")


@query
def bucket(spark, root):
    return ops.bucket(
        load(spark, root, "orders"),
        "o_totalprice",
        [1_000, 50_000, 100_000, 200_000, 400_000],
        default="other",
        aggs={"n": F.count(F.lit(1)), "avg_price": F.round(F.avg("o_totalprice"), 4)},
    )


@query
def bucket_auto(spark, root):
    # ranges of at most 2,000 values are accumulated in parallel
    return ops.bucket_auto(load(spark, root, "orders"), "o_totalprice", 8, rows_per_task=2_000)


@query
def bucket_auto_nulls(spark, root):
    """One value in seven is missing."""
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price")
    return ops.bucket_auto(load(spark, root, "orders").select(price), "price", 5, rows_per_task=2_000)


@query
def bucket_auto_ties(spark, root):
    """Fifty different values only, so that buckets hold many equal ones."""
    return ops.bucket_auto(load(spark, root, "lineitem"), "l_quantity", 7)


@query
def sample_rows(spark, root):
    orders = load(spark, root, "orders").select("o_orderkey", "o_totalprice")
    return ops.sample_n(orders, 100, seed=7, id_cols=["o_orderkey"])


@query
def sample_rows_random(spark, root):
    """Drawn by the whole row."""
    return ops.sample_n(load(spark, root, "orders").select("o_orderkey", "o_custkey"), 100, seed=7)


# ---------------------------------------------------------------- series


@query
def moving_average(spark, root):
    # one row per user and day: a series is as long as the calendar, not the table
    series = daily_values(spark, root)
    return ops.moving_average(series, "user_id", "day", "total", 7, large_keys=None).select(
        "user_id", "day", F.round("avg", 6).alias("avg")
    )


@query
def moving_average_large_keys(spark, root):
    """Five keys hold all events, so they are computed in ranges of their order."""
    events = load(spark, root, "events")
    averaged = ops.moving_average(
        events, "event_type", "ts", "value", 25, tie_breakers=["event_id"], rows_per_task=1_000
    )
    return averaged.select("event_type", "ts", F.round("avg", 6).alias("avg"))


@query
def moving_average_docs(spark, root):
    """One document per user, unrolled to check every place."""
    docs = ops.moving_average_docs(daily_values(spark, root), "user_id", "day", "total", 7, large_keys=None)
    return ops.unwind(docs, "movingAverages", keep_empty=True, index="place").select(
        "user_id",
        "part",
        "numDays",
        "startDate",
        F.col("place").cast("bigint").alias("place"),
        F.col("movingAverages.date").alias("date"),
        F.round("movingAverages.avg", 6).alias("avg"),
    )


@query
def moving_average_docs_cut(spark, root):
    """Averages over the events of each type, in documents of 200 windows; no task holds a type."""
    events = load(spark, root, "events")
    docs = ops.moving_average_docs(
        events, "event_type", "ts", "value", 25, tie_breakers=["event_id"], rows_per_task=1_000, max_array=200
    )
    return ops.unwind(docs, "movingAverages", keep_empty=True, index="place").select(
        "event_type",
        "part",
        "numDays",
        "startDate",
        F.col("place").cast("bigint").alias("place"),
        F.col("movingAverages.date").alias("date"),
        F.round("movingAverages.avg", 6).alias("avg"),
    )


@query
def requested_keys(spark, root):
    """Every nation asked for, one twice, and two that do not exist."""
    per_nation = (
        load(spark, root, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    )
    return ops.for_keys(per_nation, [99, 3, *range(25), 3, -1], "c_nationkey")


@query
def requested_keys_table(spark, root):
    """All customers asked for from a table, from the last to the first, every third one again, and as many that do not exist."""
    customers = load(spark, root, "customer").select("c_custkey")
    asked = customers.select((-F.col("c_custkey")).alias("ord"), F.col("c_custkey").alias("o_custkey"))
    again = asked.where("o_custkey % 3 = 0").withColumn("ord", F.col("o_custkey"))
    absent = asked.select((F.col("ord") - 10_000_000).alias("ord"), (F.col("o_custkey") + 10_000_000).alias("o_custkey"))
    spent = load(spark, root, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent")
    )
    return ops.for_keys(spent, asked.union(again).union(absent), "o_custkey")


@query
def array_window_means(spark, root):
    """The array form of the moving average, on arrays that are already stored as such."""
    values = load(spark, root, "embeddings").withColumn("means", window_means(F.col("embedding"), 8))
    middle = slice_from(F.col("embedding"), 10, 3)
    return values.select(
        "vec_id",
        F.size("means").cast("bigint").alias("n_windows"),
        F.size(int_range(F.size("embedding") - 7)).cast("bigint").alias("n_range"),
        F.round(F.get("means", F.lit(0)), 6).alias("first_mean"),
        F.round(F.get("means", F.size("means") - 1), 6).alias("last_mean"),
        F.round(F.get(middle, F.lit(2)).cast("double"), 6).alias("thirteenth"),
    )


@query
def range_average(spark, root):
    return ops.range_average(
        load(spark, root, "orders"), "o_orderstatus", "F", "o_orderdate", "1995-01-25", "1997-02-04", "o_totalprice"
    ).select(F.round("avg", 4).alias("avg"))


@query
def date_range(spark, root):
    """The dates arrive as zoned texts and are parsed first."""
    texts = load(spark, root, "events").withColumn(
        "stamp", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC"))
    )
    dated = texts.withColumn("day", parse_date("stamp"))
    return ops.date_range(dated, "day", "2024-01-03", "2024-01-10").groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query
def time_bucket_agg(spark, root):
    return ops.time_bucket_agg(
        load(spark, root, "orders"),
        "o_orderdate",
        "year",
        intervals=[("1993-01-01", "1999-01-01")],
        where={"o_orderstatus": "F"},
        aggs={"mean_price": F.round(F.avg("o_totalprice"), 4), "n": F.count(F.lit(1))},
    )


@query
def time_bucket_dimensions(spark, root):
    return ops.time_bucket_agg(
        load(spark, root, "lineitem"),
        "l_shipdate",
        "month",
        dims=["l_returnflag", "l_linestatus"],
        intervals=[("1993-01-01", "1995-01-01"), ("1996-06-01", "2000-01-01")],
        aggs={"quantity": F.sum("l_quantity"), "n": F.count(F.lit(1))},
    )


@query
def time_bucket_hours(spark, root):
    hourly = ops.time_bucket_agg(
        load(spark, root, "events"), "ts", "hour", aggs={"total": F.round(F.sum("value"), 6), "n": F.count(F.lit(1))}
    )
    return hourly.withColumn("bucket", F.col("bucket").cast("string"))


@query
def time_bucket_filled(spark, root):
    """Weeks of each flag, also those that have no lines of the size asked for."""
    weekly = ops.time_bucket_filled(
        load(spark, root, "lineitem"),
        "l_shipdate",
        "week",
        dims=["l_returnflag"],
        intervals=[("1995-01-10", "1996-03-01"), ("1997-06-01", "1997-06-20")],
        where={"l_quantity": 7},
        aggs={"n": F.count(F.lit(1)), "quantity": F.sum("l_quantity"), "mean_price": F.round(F.avg("l_extendedprice"), 4)},
        empty={"n": 0, "quantity": 0},
    )
    return weekly.withColumn("bucket", F.col("bucket").cast("date"))


@query
def top_n_per_bucket(spark, root):
    return ops.top_n_per_bucket(
        load(spark, root, "events"), "ts", "day", "user_id", F.count(F.lit(1)), 3, metric_name="n"
    ).withColumn("rank", F.col("rank").cast("bigint"))


# ---------------------------------------------------------------- compound


def _customers(spark, root):
    return ops.Leaf(load(spark, root, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), unique=True)


def _latest_orders(spark, root):
    """Customers' orders, the last by date counts; c_acctbal conflicts with the customer's."""
    orders = load(spark, root, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        "o_orderkey",
        "o_orderstatus",
        F.nullif(F.col("o_totalprice"), F.lit(0.0)).alias("c_acctbal"),
        "o_orderdate",
    )
    return ops.Leaf(orders, order_by=["o_orderdate", "o_orderkey"])


def _totals(spark, root):
    totals = order_totals(spark, root).withColumn("order_total", F.round("order_total", 4))
    return ops.Leaf(totals, unique=True)


def _suppliers(spark, root):
    """Suppliers on the nation key; several per nation, the last by key counts."""
    return ops.Leaf(
        load(spark, root, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_name", "s_acctbal"),
        order_by=["s_suppkey"],
    )


def _rich_customers(spark, root):
    """Customers on the nation key, keyless where the balance is negative."""
    return ops.Leaf(
        load(spark, root, "customer").select(
            F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("nation"),
            "c_custkey",
            F.when(F.col("c_acctbal") < 5000, F.col("c_acctbal")).alias("s_acctbal"),
        ),
        order_by=["c_custkey"],
    )


@query
def compound_inner(spark, root):
    joined = ops.compound((_customers(spark, root), "inner", _latest_orders(spark, root)), "c_custkey")
    return joined.withColumn("o_orderdate", F.to_date("o_orderdate"))


@query
def compound_left(spark, root):
    return ops.compound((_rich_customers(spark, root), "left", _suppliers(spark, root)), "nation")


@query
def compound_right(spark, root):
    return ops.compound((_suppliers(spark, root), "right", _rich_customers(spark, root)), "nation")


@query
def compound_full(spark, root):
    return ops.compound((_suppliers(spark, root), "full", _rich_customers(spark, root)), "nation")


@query
def compound_nested(spark, root):
    """Compound first, query second, and the other way round inside it."""
    tree = ((_customers(spark, root), "inner", _latest_orders(spark, root)), "inner", _totals(spark, root))
    return ops.compound(tree, "c_custkey").drop("o_orderdate")


@query
def compound_nested_second(spark, root):
    tree = (_totals(spark, root), "left", (_latest_orders(spark, root), "full", _customers(spark, root)))
    return ops.compound(tree, "c_custkey").drop("o_orderdate")


@query
def compound_single(spark, root):
    return ops.compound(_rich_customers(spark, root), "nation")


@query
def compound_quoted_keys(spark, root):
    """Text keys, quoted on one side; quotes are removed before the join."""
    nations = load(spark, root, "nation").select(
        F.concat(F.lit('"'), "n_name", F.lit('"')).alias("name"), "n_nationkey"
    )
    regions = (
        load(spark, root, "customer")
        .join(load(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(normalize_key("n_name").alias("name"))
        .agg(F.count(F.lit(1)).alias("n_customers"))
    )
    return ops.compound((ops.Leaf(nations, unique=True), "inner", ops.Leaf(regions, unique=True)), "name", normalize=True)


# ---------------------------------------------------------------- features and models


@query
def minmax_bounds(spark, root):
    return ops.minmax_bounds(load(spark, root, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query
def minmax_scale(spark, root):
    scaled = ops.minmax_scale(load(spark, root, "lineitem"), ["l_quantity", "l_extendedprice"])
    return scaled.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round("l_quantity", 6).alias("quantity"),
        F.round("l_extendedprice", 6).alias("price"),
    )


@query
def prepare_features(spark, root):
    prepared = ops.prepare_features(customer_stats(spark, root), "c_custkey", CUSTOMER_FEATURES)
    return prepared.select(
        "c_custkey", *[F.round(F.get("features", F.lit(i)), 6).alias(f) for i, f in enumerate(CUSTOMER_FEATURES)]
    )


@query
def train_test_split(spark, root):
    train, test = line_split(spark, root)
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("side", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query
def linear_regression_by_key(spark, root):
    train, _ = line_split(spark, root)
    models = ops.linear_regression_by_key(train, "l_suppkey", ["l_quantity"], "l_extendedprice")
    return models.select(
        "l_suppkey",
        "total_iterations",
        F.round("rmse", 4).alias("rmse"),
        F.round("r2", 6).alias("r2"),
        F.round("intercept", 4).alias("intercept"),
        F.round(F.get("coefficients", F.lit(0)), 6).alias("slope"),
    )


@query
def linear_regression_two_features(spark, root):
    train, _ = line_split(spark, root)
    models = ops.linear_regression_by_key(train, "l_suppkey", LINE_FEATURES, "l_extendedprice")
    return models.select(
        "l_suppkey",
        F.round("rmse", 4).alias("rmse"),
        F.round("r2", 6).alias("r2"),
        F.round("intercept", 4).alias("intercept"),
        F.round(F.get("coefficients", F.lit(0)), 4).alias("slope_quantity"),
        F.round(F.get("coefficients", F.lit(1)), 4).alias("slope_discount"),
    )


@query
def linear_regression_iterative(spark, root):
    """Elastic net on two features, by coordinate descent, for all suppliers."""
    models = ops.linear_regression_by_key(
        load(spark, root, "lineitem"),
        "l_suppkey",
        LINE_FEATURES,
        "l_extendedprice",
        params=ops.LinearParams(elastic_net=0.4, reg=5.0, max_iter=99, tol=1e-10),
    )
    return models.select(
        "l_suppkey",
        F.round("rmse", 3).alias("rmse"),
        F.round("r2", 6).alias("r2"),
        F.round("intercept", 3).alias("intercept"),
        F.round(F.get("coefficients", F.lit(0)), 4).alias("slope_quantity"),
        F.round(F.get("coefficients", F.lit(1)), 3).alias("slope_discount"),
    )


@query
def linear_regression_elastic_net(spark, root):
    """One feature: the soft threshold is the solution."""
    models = ops.linear_regression_by_key(
        load(spark, root, "lineitem"),
        "l_suppkey",
        ["l_discount"],
        "l_extendedprice",
        params=ops.LinearParams(elastic_net=0.5, reg=10.0, solver="l-bfgs", standardization=False),
    )
    return models.select(
        "l_suppkey",
        "total_iterations",
        F.round("rmse", 4).alias("rmse"),
        F.round("intercept", 4).alias("intercept"),
        F.round(F.get("coefficients", F.lit(0)), 4).alias("slope"),
    )


@query
def linear_regression_through_origin(spark, root):
    """No intercept: fitted per flag, the three flags covering the whole table."""
    models = ops.linear_regression_by_key(
        load(spark, root, "lineitem"),
        "l_returnflag",
        ["l_quantity"],
        "l_extendedprice",
        keys=["R", "A", "N", "none"],
        params=ops.LinearParams(fit_intercept=False, reg=0.0, solver="normal"),
    )
    return models.select(
        "l_returnflag",
        F.round("rmse", 4).alias("rmse"),
        F.round("r2", 6).alias("r2"),
        "intercept",
        F.round(F.get("coefficients", F.lit(0)), 6).alias("slope"),
    )


@query
def score_by_key(spark, root):
    train, test = line_split(spark, root)
    models = ops.linear_regression_by_key(train, "l_suppkey", ["l_quantity"], "l_extendedprice")
    scored = ops.score_by_key(test, models, "l_suppkey", ["l_quantity"])
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 4).alias("prediction"))


@query
def regression_metrics_by_key(spark, root):
    train, test = line_split(spark, root)
    models = ops.linear_regression_by_key(train, "l_suppkey", ["l_quantity"], "l_extendedprice")
    scored = ops.score_by_key(test, models, "l_suppkey", ["l_quantity"])
    return ops.regression_metrics(scored, "l_extendedprice", "prediction", "l_suppkey").select(
        "l_suppkey", "n", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2")
    )


@query
def linear_metrics_by_key(spark, root):
    """The same figures from moments, without scoring single rows."""
    train, test = line_split(spark, root)
    models = ops.linear_regression_by_key(train, "l_suppkey", ["l_quantity"], "l_extendedprice")
    metrics = ops.linear_metrics_by_key(test, models, "l_suppkey", ["l_quantity"], "l_extendedprice")
    return metrics.select("l_suppkey", "n", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query
def linear_regression_with_test(spark, root):
    """Fit and held-out metrics of all suppliers from one scan."""
    models = ops.linear_regression_with_test(
        load(spark, root, "lineitem"), "l_suppkey", ["l_quantity"], "l_extendedprice", id_cols=LINE_ID
    )
    return models.select(
        "l_suppkey",
        F.round("rmse", 4).alias("rmse"),
        F.round(F.get("coefficients", F.lit(0)), 6).alias("slope"),
        "test_n",
        F.round("test_rmse", 4).alias("test_rmse"),
        F.round("test_r2", 6).alias("test_r2"),
    )


@query
def random_forest_by_key(spark, root):
    """A forest for every return flag."""
    return ops.random_forest_by_key(
        load(spark, root, "lineitem"),
        "l_returnflag",
        ["l_quantity", "l_discount", "l_tax"],
        "l_extendedprice",
        id_cols=LINE_ID,
        params=ops.ForestParams(num_trees=8, max_depth=3, feature_subset="onethird", subsampling_rate=0.7, min_instances_per_node=5),
    )


@query
def random_forest_all_suppliers(spark, root):
    """A forest for every supplier, all grown together: the rows they were measured on."""
    return ops.random_forest_by_key(
        load(spark, root, "lineitem"),
        "l_suppkey",
        LINE_FEATURES,
        "l_extendedprice",
        id_cols=LINE_ID,
        params=ops.ForestParams(num_trees=3, max_depth=2, train_split=0.7),
    ).select("l_suppkey", "test_n", F.col("rmse").isNotNull().alias("measured"))


@query
def random_forest_stump(spark, root):
    """One tree of one split on all training rows, which SQL can find too."""
    quality = ops.random_forest_by_key(
        load(spark, root, "lineitem"),
        "l_suppkey",
        ["l_quantity"],
        "l_extendedprice",
        id_cols=LINE_ID,
        params=ops.ForestParams(num_trees=1, max_depth=1, max_bins=64, min_instances_per_node=3),
    )
    return quality.select("l_suppkey", "test_n", F.round("rmse", 3).alias("rmse"), F.round("r2", 5).alias("r2"))


@query
def gbt_by_key(spark, root):
    """Boosted trees for every return flag."""
    return ops.gbt_by_key(
        load(spark, root, "lineitem"),
        "l_returnflag",
        LINE_FEATURES,
        "l_extendedprice",
        id_cols=LINE_ID,
        params=ops.BoostParams(max_iter=4, max_depth=2, step_size=0.25, min_instances_per_node=10),
    )


@query
def gbt_held_out(spark, root):
    """The rows that the boosted trees of each return flag were measured on."""
    quality = ops.gbt_by_key(
        load(spark, root, "lineitem"),
        "l_returnflag",
        LINE_FEATURES,
        "l_extendedprice",
        ["R", "N", "none", "A"],
        id_cols=LINE_ID,
        params=ops.BoostParams(max_iter=2, max_depth=1, train_split=0.6),
    )
    return quality.select("l_returnflag", "test_n")


@query
def kmeans(spark, root):
    return ops.kmeans(customer_stats(spark, root), "c_custkey", CUSTOMER_FEATURES, 10).predictions


@query
def kmeans_centers(spark, root):
    return ops.kmeans(customer_stats(spark, root), "c_custkey", CUSTOMER_FEATURES, 10).components


@query
def kmeans_embeddings(spark, root):
    """64 features, taken from an array column."""
    vectors = load(spark, root, "embeddings")
    features = [f"f{i}" for i in range(64)]
    wide = vectors.select("vec_id", *[F.get("embedding", F.lit(i)).alias(f) for i, f in enumerate(features)])
    return ops.kmeans(wide, "vec_id", features, 10).predictions


@query
def bisecting_kmeans(spark, root):
    return ops.bisecting_kmeans(customer_stats(spark, root), "c_custkey", CUSTOMER_FEATURES, 10).predictions


@query
def gaussian_mixture(spark, root):
    return ops.gaussian_mixture(customer_stats(spark, root), "c_custkey", CUSTOMER_FEATURES, 4, max_iter=20).predictions


@query
def gaussian_components(spark, root):
    return ops.gaussian_mixture(customer_stats(spark, root), "c_custkey", CUSTOMER_FEATURES, 4, max_iter=20).components


@query
def lda(spark, root):
    return ops.lda(customer_stats(spark, root), "c_custkey", CUSTOMER_FEATURES, 3, max_iter=10).predictions


@query
def power_iteration(spark, root):
    """Suppliers and parts linked by the quantity sold; parts have odd vertex numbers."""
    links = load(spark, root, "lineitem").select(
        (F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), "l_quantity"
    )
    return ops.power_iteration(links, "src", "dst", "l_quantity", 3, max_iter=5)


@query
def kmeans_entities(spark, root):
    """Every complete customer has one cluster of ten."""
    predictions = ops.kmeans(customer_stats(spark, root), "c_custkey", CUSTOMER_FEATURES, 10).predictions
    return predictions.select("c_custkey", F.col("prediction").between(0, 9).alias("in_range"))


@query
def kmeans_invariants(spark, root):
    """One row: everybody is with the nearest centre, and ten centres fit better than one."""
    customers = customer_stats(spark, root)
    found = ops.kmeans(customers, "c_custkey", CUSTOMER_FEATURES, 10)
    centers = [r["center"] for r in found.components.orderBy("cluster").collect()]
    scaled = ops.prepare_features(customers, "c_custkey", CUSTOMER_FEATURES).join(found.predictions, "c_custkey")
    away = F.array(*[sum((F.get("features", F.lit(i)) - v) ** 2 for i, v in enumerate(c)) for c in centers])
    spread = sum(F.var_pop(F.get("features", F.lit(i))) for i in range(len(CUSTOMER_FEATURES)))
    own = F.get("away", F.col("prediction"))
    return scaled.withColumn("away", away).agg(
        F.count(F.lit(1)).alias("entities"),
        F.countDistinct("prediction").alias("clusters"),
        F.count_if(own > F.array_min("away") + 1e-9).alias("misplaced"),
        (F.avg(own) < spread / 3).alias("closer"),
        (F.sum(own) <= found.summary["training_cost"] + 1e-6).alias("no_worse_than_reported"),
    )


@query
def bisecting_invariants(spark, root):
    found = ops.bisecting_kmeans(customer_stats(spark, root), "c_custkey", CUSTOMER_FEATURES, 10)
    return found.predictions.agg(
        F.count(F.lit(1)).alias("entities"), F.countDistinct("c_custkey").alias("keys"), F.countDistinct("prediction").alias("clusters")
    )


@query
def mixture_invariants(spark, root):
    """One row: weights add up, covariances are symmetric, everybody has a component."""
    found = ops.gaussian_mixture(customer_stats(spark, root), "c_custkey", CUSTOMER_FEATURES, 4, max_iter=20)
    cell = lambda i, j: F.get(F.get("covariance", F.lit(i)), F.lit(j))
    p = len(CUSTOMER_FEATURES)
    uneven = sum(F.abs(cell(i, j) - cell(j, i)) for i in range(p) for j in range(i)) + F.when(cell(0, 0) < 0, 1.0).otherwise(0.0)
    shapes = found.components.agg(
        F.count(F.lit(1)).alias("components"), F.round(F.sum("weight"), 6).alias("weights"), (F.max(uneven) < 1e-12).alias("symmetric")
    ).first()
    return found.predictions.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(~F.col("prediction").between(0, 3)).alias("misplaced"),
        F.lit(shapes["components"]).cast("bigint").alias("components"),
        F.lit(shapes["weights"]).alias("weights"),
        F.lit(shapes["symmetric"]).alias("symmetric"),
    )


@query
def lda_invariants(spark, root):
    """One row: the topic shares of every customer add up, and the largest is the prediction."""
    found = ops.lda(customer_stats(spark, root), "c_custkey", CUSTOMER_FEATURES, 3, max_iter=10)
    total = F.aggregate("topic_distribution", F.lit(0.0), lambda acc, v: acc + v)
    own = F.get("topic_distribution", F.col("prediction"))
    return found.predictions.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.abs(total - 1) > 1e-9).alias("uneven"),
        F.count_if(own < F.array_max("topic_distribution")).alias("misplaced"),
    )


@query
def power_iteration_vertices(spark, root):
    """Every vertex of the graph has one cluster of three."""
    links = load(spark, root, "lineitem").select(
        (F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), "l_quantity"
    )
    found = ops.power_iteration(links, "src", "dst", "l_quantity", 3, max_iter=5)
    return found.select("id", F.col("cluster").between(0, 2).alias("in_range"))


@query
def points_within(spark, root):
    """The first two embedding components, taken as a point, inside a five-cornered polygon."""
    points = load(spark, root, "embeddings").select(
        "vec_id",
        F.get("embedding", F.lit(0)).cast("double").alias("lon"),
        F.get("embedding", F.lit(1)).cast("double").alias("lat"),
    )
    polygon = [(-0.2, -0.1), (0.2, -0.2), (0.05, 0.0), (0.15, 0.25), (-0.15, 0.15)]
    return ops.points_within(points, "lon", "lat", polygon).select("vec_id")


# ---------------------------------------------------------------- JSON


@query
def json_rows(spark, root):
    orders = load(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return to_json_rows(orders)


@query
def json_rows_with_defaults(spark, root):
    rows = customer_stats(spark, root).select("c_custkey", "c_name", "order_count")
    return to_json_rows(rows, drop_nulls=False, defaults={"order_count": 0})


@query
def json_documents(spark, root):
    texts = load(spark, root, "events").select("event_id", "event_type", "props")
    return from_json_rows(texts, "props", "k bigint, missing string")


@query
def explode_json_objects_array(spark, root):
    """Each body is an array of two objects and a number, which is skipped."""
    bodies = load(spark, root, "events").select(
        "event_id", F.concat(F.lit("["), "props", F.lit(","), F.col("event_id"), F.lit(","), "props", F.lit("]")).alias("body")
    )
    rows = explode_json_objects(bodies, "body")
    return rows.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.variant_get("value", "$.k", "bigint")).alias("sum_k")
    )


@query
def explode_json_objects_single(spark, root):
    rows = explode_json_objects(load(spark, root, "events").select("event_id", "props"), "props")
    return rows.select("event_id", F.variant_get("value", "$.k", "bigint").alias("k"))
