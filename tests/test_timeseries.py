import datetime as dt

import pytest
from pyspark.sql import functions as F

from arealis import operators as ops
from arealis.functions.dates import bucket_series, bucket_start
from arealis.operators.skew import order_number
from tests.plans import plan_of


@pytest.fixture(scope="module")
def readings(spark):
    rows = [
        ("a", "2020-01-24 23:59:59", 1.0),
        ("a", "2020-01-25 00:00:00", 2.0),
        ("a", "2020-02-04 18:00:00", 4.0),
        ("a", "2020-02-05 00:00:00", 100.0),
        ("b", "2020-01-30 00:00:00", 50.0),
        ("a", "2020-01-26 10:47:00", None),
    ]
    df = spark.createDataFrame(rows, "k string, s string, v double")
    return df.select("k", F.col("s").cast("timestamp_ntz").alias("t"), "v")


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "string"])
def test_range_average_includes_the_whole_last_day(readings, kind):
    df = readings.withColumn("t", F.col("t").cast(kind))
    got = ops.range_average(df, "k", "a", "t", "2020-01-25", dt.date(2020, 2, 4), "v").collect()
    assert [r["avg"] for r in got] == [3.0]


def test_range_average_on_dates(readings):
    df = readings.withColumn("t", F.to_date("t"))
    assert ops.range_average(df, "k", "a", "t", "2020-01-25", "2020-02-05", "v").first()["avg"] == pytest.approx(106 / 3)


def test_range_average_of_nothing_is_one_null_row(readings):
    assert [r["avg"] for r in ops.range_average(readings, "k", "zz", "t", "2020-01-01", "2020-12-31", "v").collect()] == [None]


def test_time_buckets(readings):
    got = ops.time_bucket_agg(
        readings,
        "t",
        "month",
        aggs={"m": F.avg("v"), "n": F.count(F.lit(1))},
        intervals=[("2020-01-25", "2020-03-01")],
        where={"k": "a"},
    )
    assert sorted(tuple(r) for r in got.collect()) == [
        (dt.date(2020, 1, 1), 2.0, 2),
        (dt.date(2020, 2, 1), 52.0, 2),
    ]


def test_yearly_buckets_of_twenty_years(spark):
    """Twenty years of one key among several give twenty rows."""
    df = spark.range(0, 40 * 365).select(
        F.expr("timestamp'1970-01-01' + make_interval(0, 0, 0, id)").alias("t"),
        F.when(F.col("id") % 2 == 0, "G49").otherwise("G50").alias("k"),
        F.col("id").cast("double").alias("v"),
    )
    rows = ops.time_bucket_agg(
        df, "t", "year", intervals=[("1979-01-01", "1999-01-01")], where={"k": "G49"},
        aggs={"mean": F.avg("v"), "n": F.count(F.lit(1))},
    ).collect()
    assert len(rows) == 20 and all(r["n"] in (182, 183) for r in rows)


@pytest.mark.parametrize(
    "grain, want",
    [
        ("all", dt.date(1970, 1, 1)),
        ("none", dt.datetime(2020, 2, 29, 10, 47, 31)),
        ("second", dt.datetime(2020, 2, 29, 10, 47, 31)),
        ("minute", dt.datetime(2020, 2, 29, 10, 47)),
        ("five_minute", dt.datetime(2020, 2, 29, 10, 45)),
        ("ten_minute", dt.datetime(2020, 2, 29, 10, 40)),
        ("fifteen_minute", dt.datetime(2020, 2, 29, 10, 45)),
        ("thirty_minute", dt.datetime(2020, 2, 29, 10, 30)),
        ("hour", dt.datetime(2020, 2, 29, 10)),
        ("day", dt.date(2020, 2, 29)),
        ("week", dt.date(2020, 2, 24)),
        ("month", dt.date(2020, 2, 1)),
        ("quarter", dt.date(2020, 1, 1)),
        ("year", dt.date(2020, 1, 1)),
    ],
)
def test_granularities(spark, grain, want):
    df = spark.sql("select timestamp_ntz'2020-02-29 10:47:31' as t")
    got = ops.time_bucket_agg(df, "t", grain, aggs={"n": F.count(F.lit(1))}).select(F.col("bucket").cast("string")).first()[0]
    assert got == str(want)


def test_wall_clock_times_do_not_depend_on_the_zone(spark):
    """02:30 does not exist on this day in New York, but may well be a stored wall-clock time."""
    texts = ["2024-03-10 01:59:00", "2024-03-10 02:30:00", "2024-03-10 03:00:00", "2024-03-10 03:10:00.5"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        numbers = [r[0] for r in df.orderBy("t").select(order_number(df, "t")).collect()]
        hours = ops.time_bucket_agg(df, "t", "hour", aggs={"n": F.count(F.lit(1))})
        got = sorted((str(r["bucket"]), r["n"]) for r in hours.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert numbers == sorted(numbers) and len(set(numbers)) == 4
    assert got == [("2024-03-10 01:00:00", 1), ("2024-03-10 02:00:00", 1), ("2024-03-10 03:00:00", 2)]


def test_unknown_granularity(readings):
    with pytest.raises(ValueError):
        ops.time_bucket_agg(readings, "t", "fortnight", aggs={"n": F.count(F.lit(1))})


def test_filters_reach_the_files(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    df = ops.time_bucket_agg(
        orders, "o_orderdate", "year", intervals=[("1993-01-01", "1994-01-01")], where={"o_orderstatus": "F"},
        aggs={"n": F.count(F.lit(1))},
    )
    plan = plan_of(df)
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert all(f in pushed for f in ("GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate", "EqualTo(o_orderstatus,F)"))
    assert "o_totalprice" not in plan


def test_top_n_per_bucket(spark):
    rows = [("d", u, i) for i, u in enumerate("aaabbccc")] + [("e", "b", 1)]
    df = spark.createDataFrame(rows, "g string, u string, i int").withColumn(
        "t", F.when(F.col("g") == "d", F.lit("2020-01-01")).otherwise("2020-01-02").cast("timestamp")
    )
    got = ops.top_n_per_bucket(df, "t", "day", "u", F.count(F.lit(1)), 2, metric_name="n").collect()
    assert sorted((str(r["bucket"]), r["rank"], r["u"], r["n"]) for r in got) == [
        ("2020-01-01", 1, "a", 3),
        ("2020-01-01", 2, "c", 3),
        ("2020-01-02", 1, "b", 1),
    ]
    with pytest.raises(ValueError):
        ops.top_n_per_bucket(df, "t", "day", "u", F.count(F.lit(1)), 0)


def test_counts(spark):
    a, b = spark.range(3), spark.range(5)
    same_name = ops.count_frames([("x", a), ("x", b)]).orderBy("ord").collect()
    assert [r["n"] for r in same_name] == [a.count(), b.count()]
    got = ops.count_frames([("a", a), ("b", b), ("a", a)]).orderBy("ord").collect()
    assert [(r["ord"], r["name"], r["n"]) for r in got] == [(0, "a", 3), (1, "b", 5), (2, "a", 3)]
    with pytest.raises(ValueError):
        ops.count_frames([])


def starts(spark, kind, grain, intervals):
    df = spark.createDataFrame([], f"t {kind}")
    return [r[0] for r in spark.range(1).select(F.explode(bucket_series(df, "t", grain, intervals)).alias("b")).collect()]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "string"])
def test_series_hold_the_buckets_of_all_their_instants(spark, kind):
    """Every bucket is the bucket of some instant in the intervals, and none is missing."""
    for grain, minutes, low, high in [
        ("minute", 1, "2024-02-28 23:50:00", "2024-02-29 00:07:00"), ("five_minute", 1, "2024-02-28 23:52:00", "2024-02-29 00:10:00"),
        ("thirty_minute", 10, "2024-02-28 22:10:00", "2024-02-29 03:00:00"), ("hour", 20, "2024-02-28 22:40:00", "2024-03-01 00:20:00"),
        ("day", 720, "2024-02-27 00:00:00", "2024-03-02 00:00:00"), ("week", 1440, "2024-02-07 00:00:00", "2024-03-04 00:00:00"),
        ("month", 1440, "2023-11-30 00:00:00", "2024-03-01 00:00:00"), ("quarter", 1440, "2023-11-30 00:00:00", "2024-04-02 00:00:00"),
        ("year", 14400, "2022-11-30 00:00:00", "2024-01-01 00:00:00"), ("all", 1440, "2022-11-30 00:00:00", "2024-01-01 00:00:00"),
    ]:
        if kind == "date" and minutes < 1440:
            continue
        first, last = dt.datetime.fromisoformat(low), dt.datetime.fromisoformat(high)
        instants = []
        while first + len(instants) * dt.timedelta(minutes=minutes) < last:
            instants.append((str(first + len(instants) * dt.timedelta(minutes=minutes)),))
        rows = spark.createDataFrame(instants, "s string").select(F.col("s").cast(kind).alias("t"))
        want = sorted({r[0] for r in rows.select(bucket_start(rows, "t", grain)).collect()})
        assert starts(spark, kind, grain, [(low, high)]) == want, (kind, grain)


def test_intervals_that_overlap_or_are_empty(spark):
    got = starts(spark, "timestamp_ntz", "day", [("2024-01-01", "2024-01-03"), ("2024-01-02", "2024-01-04"), ("2024-02-01", "2024-02-01")])
    assert got == [dt.date(2024, 1, d) for d in (1, 2, 3)]


def test_empty_buckets_are_filled(spark):
    rows = [("a", "2024-01-05 10:00:00", 2.0), ("a", "2024-03-01 00:00:00", None), (None, "2024-02-29 23:59:59", 5.0), ("b", "2025-01-01 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "k string, s string, v double").select("k", F.col("s").cast("timestamp_ntz").alias("t"), "v")
    how = dict(aggs={"n": F.count("v"), "total": F.sum("v"), "mean": F.avg("v")}, empty={"n": 0, "total": 0})
    interval = [("2024-01-01", "2024-04-01")]
    got = {(r["k"], r["bucket"].month): (r["n"], r["total"], r["mean"]) for r in ops.time_bucket_filled(df, "t", "month", dims=["k"], intervals=interval, **how).collect()}
    assert got == {
        ("a", 1): (1, 2.0, 2.0), ("a", 2): (0, 0.0, None), ("a", 3): (0, None, None),
        (None, 1): (0, 0.0, None), (None, 2): (1, 5.0, 5.0), (None, 3): (0, 0.0, None),
    }
    plain = ops.time_bucket_filled(df, "t", "month", intervals=interval, where={"k": "nobody"}, **how).orderBy("bucket").collect()
    assert [(r["bucket"].month, r["n"], r["total"], r["mean"]) for r in plain] == [(m, 0, 0.0, None) for m in (1, 2, 3)]
    with pytest.raises(ValueError):
        ops.time_bucket_filled(df, "t", "none", intervals=interval, **how)
