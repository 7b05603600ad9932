import random

import pytest
from pyspark.sql import functions as F

from arealis import operators as ops


def test_accumulators(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("b", 3, None), (None, 4, 5.0)], "k string, o int, v double")
    got = {
        r["k"]: r
        for r in ops.group(
            df,
            "k",
            {
                "s": ops.total("v"),
                "m": ops.mean("v"),
                "lo": ops.least("v"),
                "hi": ops.greatest("v"),
                "n": ops.rows(),
                "f": ops.first("o", ["o"]),
                "l": ops.last("o", ["o"]),
            },
        ).collect()
    }
    assert set(got) == {"a", "b", None}
    assert (got["a"]["s"], got["a"]["n"], got["a"]["f"], got["a"]["l"]) == (2.0, 2, 1, 2)
    # the sum of nothing is 0, its mean is null
    assert got["b"]["s"] == 0 and got["b"]["m"] is None


def test_first_needs_an_order(spark):
    for make in (ops.first, ops.last):
        with pytest.raises(ValueError):
            make("v", [])


def pushed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r["k"]), r["part"])):
        out.setdefault(r["k"], []).extend(r["vs"])
    return out


@pytest.mark.parametrize("rows_per_task", [None, 20])
@pytest.mark.parametrize("max_array", [7, 100_000])
def test_push_is_whole_and_ordered(spark, rows_per_task, max_array):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.randrange(1000), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(3)
    cut = {"rows_per_task": rows_per_task} if rows_per_task else {"large_keys": None}
    got = pushed(ops.group(df, "k", {"n": ops.rows(), "vs": ops.push(["v"], ["o", "v"], max_array=max_array)}, **cut))
    want = {}
    for k, o, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(k, []).append(v)
    assert {k: [e["v"] for e in vs] for k, vs in got.items()} == want


def test_push_of_one_field_leaves_nulls_out(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 1, None)], "k string, o int, v int")
    got = pushed(ops.group(df, "k", {"vs": ops.push("v", ["o"])}))
    assert got == {"a": [5], "b": []}


def test_two_pushes_and_a_set(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 3, "x")], "k string, o int, v string")
    row = ops.group(df, "k", {"vs": ops.push("v", ["o"]), "set": ops.add_to_set("v"), "n": ops.rows()}).collect()
    assert [(r["k"], r["part"], r["vs"], r["set"], r["n"]) for r in row] == [("a", 0, ["y", "x", "x"], ["x", "y"], 3)]


def test_two_pushes_with_a_cut_key(spark):
    rows = [("a", i, i % 3) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = ops.group(
        df, "k", {"vs": ops.push("v", ["o"], max_array=4), "set": ops.add_to_set("v"), "n": ops.rows()}, rows_per_task=10
    ).orderBy("part")
    rows_out = got.collect()
    assert [v for r in rows_out for v in r["vs"]] == [i % 3 for i in range(50)]
    assert sorted(v for r in rows_out for v in r["set"]) == [0, 1, 2]
    assert {r["n"] for r in rows_out} == {50}


def test_sort_by_count(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert [tuple(r) for r in ops.sort_by_count(df, "k").collect()] == [("b", 2), ("a", 1)]


def test_column_accumulators_take_columns(spark):
    df = spark.range(10).withColumn("k", F.lit(1))
    assert ops.group(df, "k", {"s": ops.total(F.col("id") * 2)}).first()["s"] == 90


COPIES = [("hot", 1, 7)] * 90 + [("hot", 2, None)] * 25 + [("b", i, i) for i in range(6)] + [(None, 3, 1)] * 14 + [("e", 1, None)]


@pytest.mark.parametrize("max_array", [1, 4, 50])
def test_cut_and_uncut_groups_are_the_same_rows(spark, max_array):
    df = spark.createDataFrame(COPIES, "k string, o int, v int").repartition(5)
    pushes = {
        "n": ops.rows(),
        "vs": ops.push("v", ["o"], max_array=max_array),
        "docs": ops.push(["v", "o"], ["o"], max_array=max_array),
        "set": ops.add_to_set("o", max_array=max_array),
    }
    key = lambda r: (str(r["k"]), r["part"])
    runs = [sorted(ops.group(df, "k", pushes, rows_per_task=n).collect(), key=key) for n in (1, 3, 10, 64, 1000)]
    assert all(run == runs[0] for run in runs)
    whole = {}
    for r in runs[0]:
        whole.setdefault(r["k"], ([], [], []))
        for column, values in zip(whole[r["k"]], (r["vs"], r["docs"], r["set"])):
            column += values
    rank = lambda r: (r[1], r[2] is not None, r[2])
    for k, (vs, docs, found) in whole.items():
        rows = sorted((r for r in COPIES if r[0] == k), key=rank)
        assert vs == [r[2] for r in rows if r[2] is not None]
        assert [(d["o"], d["v"]) for d in docs] == [(r[1], r[2]) for r in rows]
        assert found == sorted({r[1] for r in rows})


def test_two_pushes_line_up(spark):
    """Element i of either array is in part i div max_array, so the same part holds the same rows."""
    df = spark.createDataFrame([("a", i % 50, i) for i in range(500)], "k string, o int, v int").repartition(7)
    both = {"x": ops.push(["o", "v"], ["o", "v"], max_array=9), "y": ops.push(["v"], ["o", "v"], max_array=9)}
    for r in ops.group(df, "k", both, rows_per_task=40).collect():
        assert [e["v"] for e in r["x"]] == [e["v"] for e in r["y"]] and len(r["x"]) == min(9, 500 - 9 * r["part"])


@pytest.mark.parametrize("rows_per_task", [400, 100_000])
def test_parts_of_a_group_are_spread(spark, rows_per_task):
    """The parts of one group do not meet in one task, neither with its count nor with a second array."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    df = spark.range(2000).select(F.lit("a").alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    both = {"n": ops.rows(), "x": ops.push(["o"], ["o"], max_array=10), "y": ops.push("v", ["o"], max_array=10)}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = ops.group(df, "k", both, rows_per_task=rows_per_task).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r["part"] for r in got) == list(range(200)) and {r["n"] for r in got} == {2000}
    per_task = [sum(r["task"] == t for r in got) for t in {r["task"] for r in got}]
    assert len(per_task) == 4 and max(per_task) < 100


def test_only_parts_with_elements_are_there(spark):
    """A set has fewer parts than its group's rows could fill; 25,000 parts are more than one block of them."""
    df = spark.range(25_000).select(F.lit("a").alias("k"), (F.col("id") % 3).alias("v"), "id")
    df = df.union(spark.createDataFrame([("b", None, 1), (None, 5, 2), (None, 5, 3)], "k string, v long, id long"))
    sets = ops.group(df, "k", {"set": ops.add_to_set("v", max_array=1)}).collect()
    assert sorted(map(tuple, sets), key=str) == [("a", 0, [0]), ("a", 1, [1]), ("a", 2, [2]), ("b", 0, []), (None, 0, [5])]
    ids = ops.group(df.where("k = 'a'"), "k", {"ids": ops.push("id", ["id"], max_array=1)})
    assert ids.where("part = ids[0] AND size(ids) = 1").count() == ids.count() == 25_000
