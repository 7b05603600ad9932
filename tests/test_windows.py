import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arealis.operators import for_keys, moving_average, moving_average_docs, number_rows
from arealis.operators.positions import _cuts
from arealis.operators.skew import order_number

SCHEMA = "k string, d date, id int, v double"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def expected(rows, days):
    """Brute force: (key, date, average) of every full window."""
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        series = sorted(
            (r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1], r[2])
        )
        for i in range(days - 1, len(series)):
            values = [r[3] for r in series[i - days + 1 : i + 1] if r[3] is not None]
            out.append((key, series[i][1], round(sum(values) / len(values), 9) if values else None))
    return sorted(out, key=repr)


def actual(df):
    rows = [(r[0], r[1], None if r[2] is None else round(r[2], 9)) for r in df.collect()]
    return sorted(rows, key=repr)


def test_window_counts_rows_not_days(spark):
    rows = [("a", day(i * 10), i, float(i)) for i in range(3)] + [("b", day(i), i, 2.0 * i) for i in range(7)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert actual(moving_average(df, "k", "d", "v", 7)) == [("b", day(6), 6.0)]
    assert actual(moving_average(df, "k", "d", "v", 3)) == expected(rows, 3)


def test_nulls_keep_their_place(spark):
    rows = [("a", day(0), 0, None), ("a", day(1), 1, None), ("a", day(2), 2, 6.0), ("a", day(3), 3, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert actual(moving_average(df, "k", "d", "v", 2)) == [
        ("a", day(1), None),
        ("a", day(2), 6.0),
        ("a", day(3), 6.0),
    ]


def test_rows_without_key_form_no_series(spark):
    df = spark.createDataFrame([(None, day(0), 0, 1.0), ("a", day(0), 0, 3.0)], SCHEMA)
    assert actual(moving_average(df, "k", "d", "v", 1)) == [("a", day(0), 3.0)]


def test_days_must_be_positive(spark):
    df = spark.createDataFrame([("a", day(0), 0, 1.0)], SCHEMA)
    for operator in (moving_average, moving_average_docs):
        with pytest.raises(ValueError):
            operator(df, "k", "d", "v", 0)


def test_text_values_are_not_numbers(spark):
    df = spark.createDataFrame([("a", day(0), "1"), ("a", day(1), "x"), ("a", day(2), "3")], "k string, d date, v string")
    assert actual(moving_average(df, "k", "d", "v", 3)) == [("a", day(2), 2.0)]


@pytest.mark.parametrize("days", [1, 2, 5, 40, 200])
@pytest.mark.parametrize("rows_per_task", [3, 25, 100])
def test_cut_keys_equal_uncut(spark, days, rows_per_task):
    rng = random.Random(days * 1000 + rows_per_task)
    # one key with most rows, bursts on some dates, gaps, ties, nulls
    rows = [
        (
            rng.choice(["hot", "hot", "hot", "b", "c"]),
            None if rng.random() < 0.02 else day(int(rng.paretovariate(0.7)) % 400),
            i,
            None if rng.random() < 0.1 else rng.uniform(-5, 5),
        )
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert number_rows(df, ["k"], ["d", "id", "v"], rows_per_task=rows_per_task)[1]
    cut = moving_average(df, "k", "d", "v", days, tie_breakers=["id"], rows_per_task=rows_per_task)
    assert actual(cut) == expected(rows, days)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(st.tuples(st.integers(0, 4), st.integers(-2, 2)), min_size=2, max_size=40),
    days=st.integers(1, 8),
    rows_per_task=st.integers(1, 12),
)
def test_any_cut_is_exact(spark, data, days, rows_per_task):
    """Few dates and few values, so that most rows are tied or equal."""
    rows = [("a", day(d), v, float(v)) for d, v in data] + [("b", day(0), 0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = moving_average(df, "k", "d", "v", days, tie_breakers=["id"], rows_per_task=rows_per_task)
    assert actual(cut) == expected(rows, days)


ONE_DAY = [("hot", "2024-05-01", i, float(i % 10)) for i in range(300)] + [("hot", "2024-05-01", 5, 5.0)] * 200
ISO_TEXT = [("k", f"2024-{1 + i // 28 % 12:02}-{1 + i % 28:02}", i, float(i % 7)) for i in range(500)]
MANY = [(f"key{i % 60}", f"2024-01-{1 + i % 30:02}", i, float(i)) for i in range(1800)]


@pytest.mark.parametrize("rows", [ONE_DAY, ISO_TEXT, MANY], ids=["one day", "text dates", "many large keys"])
@pytest.mark.parametrize("days", [1, 7, 90])
def test_ranges_cut_ties_texts_and_any_number_of_keys(spark, rows, days):
    df = spark.createDataFrame(rows, "k string, d string, id int, v double").repartition(4)
    cut = moving_average(df, "k", "d", "v", days, tie_breakers=["id"], rows_per_task=20)
    assert actual(cut) == expected(rows, days)


def test_ranges_are_even(spark):
    """The layout, not the result: no range holds much more than the rows asked for, copies counted once."""
    df = spark.createDataFrame(ONE_DAY + ISO_TEXT + MANY, "k string, d string, id int, v double").drop("id")
    rows = df.groupBy(*df.columns).count()
    placed, cut = number_rows(df, ["k"], ["d", "v"], rows_per_task=100)
    assert cut and placed.count() == rows.count()
    assert placed.agg(F.sum("_copies")).first()[0] == df.count()
    plan = placed._jdf.queryExecution().toString()
    assert "_range" in plan
    whole, cut = number_rows(df, ["k"], ["d", "v"])
    assert not cut
    first = whole.groupBy(*df.columns).agg(F.min("_at").alias("_at"), F.count("*").alias("_copies"))
    assert sorted(map(repr, first.collect())) == sorted(map(repr, placed.select(first.columns).collect()))


def test_many_ranges(spark):
    """The product of a range's number and the sample's size is more than an int holds."""
    n = 50_000
    df = spark.range(n).select(F.lit("k").alias("k"), "id")
    cuts = _cuts(df, F.struct("id"), n, n).first()["cuts"]
    assert [c["id"] for c in cuts] == list(range(1, n))
    placed, cut = number_rows(df, ["k"], ["id"], rows_per_task=1)
    assert cut and placed.where("_at <> id OR _copies <> 1").count() == 0 and placed.count() == n
    assert placed.agg(F.max("_at")).first()[0] == n - 1


def test_places_of_null_keys_nulls_and_empty_tables(spark):
    rows = [(None, None, 1.0), (None, "a", None), ("x", None, None), ("x", "b", 2.0), ("x", "a", 3.0)] * 3
    df = spark.createDataFrame(rows, "k string, d string, v double")
    got = {(r["k"], r["d"], r["v"]): (r["_at"], r["_copies"]) for r in number_rows(df, ["k"], ["d", "v"], rows_per_task=2)[0].collect()}
    assert got == {
        (None, None, 1.0): (0, 3), (None, "a", None): (3, 3),
        ("x", None, None): (0, 3), ("x", "a", 3.0): (3, 3), ("x", "b", 2.0): (6, 3),
    }
    assert number_rows(df.limit(0), ["k"], ["d", "v"], rows_per_task=1)[0].collect() == []
    for wrong in ({"large_keys": "some"}, {"rows_per_task": 0}):
        with pytest.raises(ValueError):
            number_rows(df, ["k"], ["d"], **wrong)


def test_order_numbers_grow_with_the_value(spark):
    texts = ["", "A", "a", "aa", "aaaaaaz", "b", "é", "日本"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.orderBy("t").select(order_number(df, "t")).collect()]
    assert got == sorted(got) and len(set(got)) >= 7


def docs(df):
    return sorted(
        (r["k"], r["part"], r["numDays"], r["startDate"], [(m["date"], m["avg"]) for m in r["movingAverages"]])
        for r in df.collect()
    )


def test_documents(spark):
    rows = [("a", day(i), i, float(i)) for i in range(3)] + [("b", day(i), i, float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = docs(moving_average_docs(df, "k", "d", "v", 7))
    assert got == [("a", 0, 7, day(0), []), ("b", 0, 7, day(0), [(day(6), 3.0)])]


@pytest.mark.parametrize("rows_per_task", [None, 15])
def test_long_documents_continue_in_parts(spark, rows_per_task):
    rows = [("a", day(i), i, float(i)) for i in range(60)] + [("b", day(0), 0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = {"rows_per_task": rows_per_task} if rows_per_task else {"large_keys": None}
    got = docs(moving_average_docs(df, "k", "d", "v", 3, max_array=10, **cut))
    assert [len(entry[4]) for entry in got if entry[0] == "a"] == [10] * 5 + [8]
    assert [entry[1] for entry in got if entry[0] == "a"] == list(range(6))
    whole = [m for entry in got if entry[0] == "a" for m in entry[4]]
    assert whole == [(day(i), i - 1.0) for i in range(2, 60)]
    assert {entry[3] for entry in got} == {day(0)}
    assert [entry for entry in got if entry[0] == "b"] == [("b", 0, 3, day(0), [])]


def test_requested_documents(spark):
    rows = [("a", day(i), i, float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    answers = for_keys(moving_average_docs(df, "k", "d", "v", 7), ["zz", "a", "a"], "k").orderBy("ord").collect()
    assert [(r["ord"], r["k"], r["startDate"]) for r in answers] == [(0, "zz", None), (1, "a", day(0)), (2, "a", day(0))]
    assert len(answers[1]["movingAverages"]) == 2
