import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from arealis import operators as ops
from arealis.functions import split_percentile
from arealis.functions.split import MODULUS, row_hash
from arealis.operators import clustering, moments, trees
from arealis.operators.features import as_vector
from arealis.operators.keyed import spread_by_size

# ---------------------------------------------------------------- features


def test_minmax_scaling(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 10.0, 5.0), (3, 4.0, 5.0), (4, None, 5.0)], "k int, a double, b double")
    got = {r["k"]: (r["a"], r["b"]) for r in ops.minmax_scale(df, ["a", "b"]).collect()}
    assert got == {1: (0.0, 0.5), 2: (1.0, 0.5), 3: (0.4, 0.5), 4: (None, 0.5)}
    prepared = {r["k"]: r["features"] for r in ops.prepare_features(df, "k", ["a", "b"]).collect()}
    assert prepared == {1: [0.0, 0.5], 2: [1.0, 0.5], 3: [0.4, 0.5]}


def test_scaling_equals_the_library_scaler(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.gauss(0, 9), rng.gauss(5, 1), 3.0) for _ in range(50)], "a double, b double, c double")
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df)
    scaled = MinMaxScaler(inputCol="v", outputCol="s").fit(vectors).transform(vectors)
    want = np.array([r[0] for r in scaled.select(vector_to_array("s")).collect()])
    got = np.array([tuple(r) for r in ops.minmax_scale(df, ["a", "b", "c"]).collect()])
    assert np.allclose(want, got, atol=1e-12)


def test_scaling_nothing(spark):
    df = spark.createDataFrame([], "k int, a double")
    assert ops.minmax_scale(df, ["a"]).collect() == []


def test_assembling_a_null_is_an_error_unless_skipped(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "k int, a double")
    with pytest.raises(Exception, match="null while assembling"):
        ops.assemble(df, ["a"], keep=["k"]).collect()
    assert [r["k"] for r in ops.assemble(df, ["a"], keep=["k"], nulls="skip").collect()] == [1]


def test_split_is_even_repeatable_and_complete(spark):
    df = spark.range(20_000).withColumn("name", F.concat(F.lit("x"), "id"))
    for ids in (["id"], ["name"], ["id", "name"]):
        train, test = ops.train_test_split(df, ids, 80)
        assert train.count() + test.count() == 20_000
        assert abs(train.count() - 16_000) < 400
        again = df.repartition(7).where(split_percentile(df, ids) < 80)
        assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in train.collect())
    with pytest.raises(ValueError):
        ops.train_test_split(df, ["id"], 100)
    with pytest.raises(ValueError):
        ops.train_test_split(df, [], 50)


# ---------------------------------------------------------------- keys


def test_requested_keys(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    got = ops.for_keys(df, ["c", "q", "a", "c"], "k").orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(0, "c", 3), (1, "q", None), (2, "a", 1), (3, "c", 3)]


def test_long_key_lists_are_joined(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    assert ops.restrict_keys(df, "k", list(range(0, 6000, 2))).count() == 2500
    assert ops.restrict_keys(df, "k", [3, 3, 9999]).count() == 1
    # no length is too long
    assert ops.restrict_keys(df, "k", range(4000, 200_000)).count() == 1000
    assert ops.for_keys(df.withColumn("v", F.lit(1)), range(120_000), "k").agg(F.sum("v"), F.count("*")).first() == (5000, 120_000)


def test_keys_are_taken_in_the_type_of_the_column(spark):
    df = spark.createDataFrame([("1", 5), ("01", 6)], "k string, v int")
    for keys in ([1], [*range(1, 2000)], spark.range(1, 3).withColumnsRenamed({"id": "k"})):
        assert [r["v"] for r in ops.restrict_keys(df, "k", keys).collect()] == [5]


def test_requested_keys_from_a_table(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v int")
    sums = df.groupBy("k").agg(F.sum("v").alias("v"))
    asked = spark.createDataFrame([(7, "b"), (1, "q"), (3, "b"), (2, None), (0, "a")], "ord long, k string")
    got = ops.for_keys(sums, asked, "k").orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(0, "a", 1), (1, "q", None), (2, None, None), (3, "b", 5), (7, "b", 5)]
    assert ops.for_keys(sums, asked.limit(0), "k").collect() == []


def test_only_requested_keys_are_aggregated(spark):
    rows = spark.range(1000).selectExpr("id % 100 AS k", "id AS v")
    asked = spark.range(5).selectExpr("id AS ord", "id * 7 AS k")
    plan = ops.for_keys(rows.groupBy("k").agg(F.sum("v").alias("v")), asked, "k")._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan.index("Aggregate")
    assert "LeftSemi" in plan[aggregate:] and "LeftSemi" not in plan[:aggregate]


def test_layout_spreads_large_keys_only(spark):
    rows = [("hot", i) for i in range(900)] + [(k, i) for k in "abcdefghij" for i in range(10)]
    df = spark.createDataFrame(rows, "k string, id int")
    placed = spread_by_size(df, "k", ["hot", *"abcdefghij"], ["id"], partitions=10)
    where = placed.select("k", F.spark_partition_id().alias("p")).distinct().collect()
    per_key = {k: len([r for r in where if r["k"] == k]) for k in ["hot", *"abcdefghij"]}
    assert per_key["hot"] >= 9 and all(n == 1 for k, n in per_key.items() if k != "hot")
    sizes = [r["n"] for r in placed.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 200


def test_fit_by_key_keeps_the_order_of_keys(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    got = ops.fit_by_key(df, "k", ["b", "z", "a"], lambda key, part: (key, part.count()), parallelism=2)
    assert got == [("b", 2), ("z", 0), ("a", 1)]
    assert ops.fit_by_key(df, "k", [], lambda key, part: key) == []


def test_fit_errors_propagate(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")

    def fail(key, part):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        ops.fit_by_key(df, "k", ["a"], fail)


# ---------------------------------------------------------------- linear regression


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(3)
    rows = []
    for key, n in (("a", 60), ("b", 200), ("c", 15)):
        for i in range(n):
            x, z = rng.uniform(0, 10), rng.gauss(0, 3)
            rows.append((key, i, x, z, 3 * x - 2 * z + 7 + rng.gauss(0, 0.5)))
    return spark.createDataFrame(rows, "k string, id int, x double, z double, y double").cache()


@pytest.mark.parametrize("features", [["x"], ["x", "z"]])
@pytest.mark.parametrize("reg", [0.0, 0.5, 10.0])
@pytest.mark.parametrize("standardization", [True, False])
def test_closed_form_equals_the_library(spark, planted, features, reg, standardization):
    params = ops.LinearParams(reg=reg, standardization=standardization)
    got = {r["k"]: r for r in ops.linear_regression_by_key(planted, "k", features, "y", params=params).collect()}
    assert set(got) == {"a", "b", "c"}
    for key, row in got.items():
        part = ops.assemble(planted.where(F.col("k") == key), features, keep=["y"])
        model = LinearRegression(
            labelCol="y", solver="normal", regParam=reg, standardization=standardization
        ).fit(part)
        assert np.allclose(row["coefficients"], model.coefficients.toArray(), rtol=1e-9)
        assert math.isclose(row["intercept"], model.intercept, rel_tol=1e-9)
        assert math.isclose(row["rmse"], model.summary.rootMeanSquaredError, rel_tol=1e-7)
        assert math.isclose(row["r2"], model.summary.r2, rel_tol=1e-7)
        assert row["total_iterations"] == model.summary.totalIterations == 0
        assert row["objective_history"] == list(model.summary.objectiveHistory) == [0.0]


def spread_rows(seed, p, n, keys=("a", "b")):
    """Wide rows with a constant feature, a repeated feature, and other scales."""
    rng = np.random.default_rng(seed)
    out = []
    for key in keys:
        x = rng.standard_normal((n, p)) * 10.0 ** rng.integers(-3, 4, p) + rng.integers(-5, 5, p)
        x[:, 1] = 4.25
        x[:, 2] = -2 * x[:, 0]
        y = x @ (rng.standard_normal(p) / np.maximum(x.std(axis=0), 1e-9)) + rng.standard_normal(n)
        out += [(key, i, *map(float, row), float(v)) for i, (row, v) in enumerate(zip(x, y))]
    return out


@pytest.mark.parametrize("p", [5, 8, 9, 31, 32, 33, 40])
@pytest.mark.parametrize("reg", [0.0, 0.3])
def test_the_same_rules_at_any_width(spark, p, reg):
    names = [f"f{i}" for i in range(p)]
    rows = spread_rows(p, p, 150)
    df = spark.createDataFrame(rows, ["k", "id", *names, "y"]).repartition(5)
    params = ops.LinearParams(reg=reg)
    got = {r["k"]: r for r in ops.linear_regression_by_key(df, "k", names, "y", params=params).collect()}
    some = {r["k"]: r for r in ops.linear_regression_by_key(df, "k", names, "y", keys=["b", "a"], params=params).collect()}
    for key in ("a", "b"):
        data = np.array([r[2:] for r in rows if r[0] == key])
        x, y = data[:, :-1], data[:, -1]
        live = [j for j in range(p) if j != 1]
        z = (x - x.mean(axis=0))[:, live] / x.std(axis=0)[live]
        t = y - y.mean()
        # the shortest solution in standard units; the ridge is relative to the label's spread
        ridge = reg / y.std()
        w = np.linalg.lstsq(z.T @ z / len(y) + ridge * np.eye(p - 1), z.T @ t / len(y), rcond=1e-12)[0]
        want = np.zeros(p)
        want[live] = w / x.std(axis=0)[live]
        row = got[key]
        assert row["coefficients"][1] == 0.0
        assert np.allclose(np.array(row["coefficients"]) * x.std(axis=0), want * x.std(axis=0), atol=1e-7)
        error = y - row["intercept"] - x @ row["coefficients"]
        assert row["rmse"] == pytest.approx(np.sqrt(np.mean(error**2)), rel=1e-6)
        assert row["r2"] == pytest.approx(1 - np.mean(error**2) / y.var(), rel=1e-6)
        assert some[key]["coefficients"] == pytest.approx(row["coefficients"], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("p", [3, 12])
def test_wide_moments_equal_columns(spark, p):
    """Partial vectors or aggregate columns: the same figures, for large, small and one-row groups, with and without sides."""
    rng = random.Random(p)
    names = [f"f{i}" for i in range(p)]
    rows = [(rng.choice(["hot"] * 8 + list("abcdefg")), i, *[rng.gauss(3, 1) for _ in names], rng.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame([*rows, ("one", 1, *[1.0] * p, 2.0)], ["k", "id", *names, "y"]).repartition(6)
    split = df.withColumn("side", F.col("id") % 4 > 0)
    columns = [*moments._columns(names, "y", "", F.col("side")), *moments._columns(names, "y", "test_", ~F.col("side"))]
    want = {r["k"]: r for r in split.groupBy("k").agg(*columns).collect()}
    got = {(r["k"], r["_side"]): r for r in moments._merged(split, "k", names, "y", "side").collect()}
    assert set(got) == {(k, s) for k in want for s in (True, False) if want[k]["n" if s else "test_n"]}
    for (k, side), row in got.items():
        prefix = "" if side else "test_"
        for name in moments.NAMES:
            assert np.allclose(row[name], want[k][prefix + name], rtol=1e-9, atol=1e-12)


def test_moments_of_far_away_values_keep_their_digits(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 12))
    names = [f"f{i}" for i in range(12)]
    rows = [("a", *(1e8 + v).tolist(), float(1e9 + v[0] - 2 * v[11])) for v in x]
    df = spark.createDataFrame(rows, ["k", *names, "y"]).repartition(4)
    row = ops.linear_regression_by_key(df, "k", names, "y", params=ops.LinearParams(reg=0.0)).first()
    assert row["coefficients"] == pytest.approx([1.0, *[0.0] * 10, -2.0], abs=1e-5)


def test_exact_line(spark):
    df = spark.createDataFrame([("a", float(x), 2.0 * x + 1) for x in range(10)], "k string, x double, y double")
    row = ops.linear_regression_by_key(df, "k", ["x"], "y", params=ops.LinearParams(reg=0.0)).first()
    assert row["coefficients"] == pytest.approx([2.0]) and row["intercept"] == pytest.approx(1.0)
    assert row["rmse"] == pytest.approx(0.0, abs=1e-6) and row["r2"] == pytest.approx(1.0)


@pytest.mark.parametrize("extra", [[], ["z"], [f"z{i}" for i in range(9)]])
@pytest.mark.parametrize("reg", [0.0, 0.5])
def test_constant_features_and_labels_have_a_model(spark, extra, reg):
    rows = [("one", 1.0, 1.5)] + [("flat_x", 0.1, float(i)) for i in range(5)] + [("flat_y", float(i), 0.3) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(3)
    df = df.withColumns({name: F.lit(7.7) for name in extra})
    params = ops.LinearParams(reg=reg)
    got = {r["k"]: r for r in ops.linear_regression_by_key(df, "k", ["x", *extra], "y", params=params).collect()}
    for key, mean, spread in (("one", 1.5, 0.0), ("flat_x", 2.0, math.sqrt(2)), ("flat_y", 0.3, 0.0)):
        assert got[key]["coefficients"] == [0.0] * (1 + len(extra))
        assert got[key]["intercept"] == pytest.approx(mean) and got[key]["rmse"] == pytest.approx(spread, abs=1e-12)
    assert got["flat_x"]["r2"] == pytest.approx(0.0) and got["flat_y"]["r2"] is None and got["one"]["r2"] is None


def test_collinear_features_share_the_slope(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i, 3.0 * i + 1) for i in range(9)], "k string, x double, z double, y double")
    row = ops.linear_regression_by_key(df, "k", ["x", "z"], "y", params=ops.LinearParams(reg=0.0)).first()
    assert row["coefficients"] == pytest.approx([1.5, 0.75]) and row["rmse"] == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("features", [["x"], ["x", "z"]])
@pytest.mark.parametrize("reg", [0.0, 0.5])
@pytest.mark.parametrize("standardization", [True, False])
def test_through_the_origin_equals_the_library(spark, planted, features, reg, standardization):
    how = dict(reg=reg, standardization=standardization, fit_intercept=False)
    got = {r["k"]: r for r in ops.linear_regression_by_key(planted, "k", features, "y", params=ops.LinearParams(**how)).collect()}
    for key in "abc":
        part = ops.assemble(planted.where(F.col("k") == key), features, keep=["y"])
        model = LinearRegression(
            labelCol="y", solver="normal", regParam=reg, standardization=standardization, fitIntercept=False
        ).fit(part)
        assert np.allclose(got[key]["coefficients"], model.coefficients.toArray(), rtol=1e-7)
        assert got[key]["intercept"] == 0.0
        assert got[key]["rmse"] == pytest.approx(model.summary.rootMeanSquaredError, rel=1e-7)
        assert got[key]["r2"] == pytest.approx(model.summary.r2, rel=1e-7)


@pytest.mark.parametrize("solver", ["normal", "l-bfgs"])
@pytest.mark.parametrize("features", [["x"], ["x", "z"]])
@pytest.mark.parametrize("standardization", [True, False])
def test_elastic_net_equals_the_library(spark, planted, solver, features, standardization):
    how = dict(reg=2.0, elastic_net=0.6, standardization=standardization, solver=solver, max_iter=99, tol=1e-12)
    got = {r["k"]: r for r in ops.linear_regression_by_key(planted, "k", features, "y", params=ops.LinearParams(**how)).collect()}
    for key in "abc":
        part = ops.assemble(planted.where(F.col("k") == key), features, keep=["y"])
        model = LinearRegression(
            labelCol="y", solver=solver, regParam=2.0, elasticNetParam=0.6, standardization=standardization, maxIter=500, tol=1e-12
        ).fit(part)
        assert np.allclose(got[key]["coefficients"], model.coefficients.toArray(), rtol=1e-4, atol=1e-6)
        assert got[key]["intercept"] == pytest.approx(model.intercept, rel=1e-4)


def test_elastic_net_of_many_features_meets_its_conditions(spark):
    """At the optimum the gradient is balanced by the penalty, and stays within it where the coefficient is 0."""
    names = [f"f{i}" for i in range(14)]
    rows = spread_rows(2, 14, 200)
    df = spark.createDataFrame(rows, ["k", "id", *names, "y"]).repartition(3)
    params = ops.LinearParams(reg=0.2, elastic_net=0.7, max_iter=99, tol=0.0)
    zeros = 0
    for row in ops.linear_regression_by_key(df, "k", names, "y", params=params).collect():
        data = np.array([r[2:] for r in rows if r[0] == row["k"]])
        x, y = data[:, :-1], data[:, -1]
        live = x.std(axis=0) > 1e-9
        z, t = (x - x.mean(axis=0))[:, live] / x.std(axis=0)[live], (y - y.mean()) / y.std()
        w = (np.array(row["coefficients"]) * x.std(axis=0) / y.std())[live]
        strength = 0.2 / y.std()
        gradient = z.T @ (t - z @ w) / len(y) - strength * 0.3 * w
        assert np.abs(gradient[w != 0] - strength * 0.7 * np.sign(w[w != 0])).max() < 1e-3
        assert np.abs(gradient[w == 0]).max(initial=0) <= strength * 0.7 + 1e-9
        history = row["objective_history"]
        assert len(history) == row["total_iterations"] + 1 and all(a >= b - 1e-12 for a, b in zip(history, history[1:]))
        zeros += (w == 0).sum()
    assert zeros


def test_requested_keys_are_all_answered(spark, planted):
    got = ops.linear_regression_by_key(planted, "k", ["x"], "y", keys=["c", "nope", "a"]).collect()
    assert {r["k"]: r["coefficients"] is None for r in got} == {"c": False, "nope": True, "a": False}


def test_nulls_in_the_data(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", None, 1.0), ("a", 3.0, 7.0)], "k string, x double, y double")
    with pytest.raises(Exception, match="null in x, y"):
        ops.linear_regression_by_key(df, "k", ["x"], "y").collect()
    params = ops.LinearParams(reg=0.0)
    row = ops.linear_regression_by_key(df, "k", ["x"], "y", params=params, nulls="skip").first()
    assert row["coefficients"] == pytest.approx([2.0])


def test_columns_are_checked(planted):
    for key, features, label in (("k", ["x", "y"], "y"), ("k", [], "y"), ("x", ["x"], "y"), ("y", ["x"], "y")):
        with pytest.raises(ValueError):
            ops.linear_regression_by_key(planted, key, features, label)


@pytest.mark.parametrize(
    "params",
    [
        ops.LinearParams(elastic_net=0.5, reg=0.1, solver="l-bfgs"),
        ops.LinearParams(loss="huber", reg=0.1),
        ops.LinearParams(fit_intercept=False),
        ops.LinearParams(solver="l-bfgs"),
    ],
)
def test_iterative_fits(spark, planted, params):
    got = {
        r["k"]: r
        for r in ops.linear_regression_by_key(planted, "k", ["x", "z"], "y", keys=["a", "b", "nope"], params=params).collect()
    }
    assert got["nope"]["coefficients"] is None
    for key in ("a", "b"):
        slope, other = got[key]["coefficients"]
        assert 2 < slope < 5 and -3 < other < -1
        assert got[key]["rmse"] > 0 and len(got[key]["objective_history"]) >= 1
    if not params.fit_intercept:
        assert got["a"]["intercept"] == 0.0
    if params.loss == "huber":
        with pytest.raises(ValueError):
            ops.linear_regression_by_key(planted, "k", ["x"], "y", params=params)
    else:
        assert ops.linear_regression_by_key(planted, "k", ["x"], "y", params=params).count() == 3


@pytest.mark.parametrize(
    "good, bad",
    [
        ({"aggregation_depth": 2}, {"aggregation_depth": 1}),
        ({"aggregation_depth": 10}, {"aggregation_depth": 11}),
        ({"max_iter": 0}, {"max_iter": -1}),
        ({"max_iter": 99}, {"max_iter": 100}),
        ({"elastic_net": 0.0}, {"elastic_net": -0.01}),
        ({"elastic_net": 1.0}, {"elastic_net": 1.01}),
        ({"epsilon": 1.01}, {"epsilon": 1.0}),
        ({"epsilon": 10.0}, {"epsilon": 10.01}),
        ({"reg": 0.0}, {"reg": -0.01}),
        ({"reg": 10.0}, {"reg": 10.01}),
        ({"tol": 0.0}, {"tol": -1e-9}),
        ({"tol": 10.0}, {"tol": 10.1}),
        ({"loss": "huber"}, {"loss": "squared"}),
        ({"solver": "normal"}, {"solver": "sgd"}),
    ],
)
def test_linear_bounds(good, bad):
    ops.LinearParams(**good).validate()
    with pytest.raises(ValueError):
        ops.LinearParams(**bad).validate()


TREE_BOUNDS = [
    ({"min_instances_per_node": 1}, {"min_instances_per_node": 0}),
    ({"min_instances_per_node": 10_000}, {"min_instances_per_node": 10_001}),
    ({"max_depth": 0}, {"max_depth": -1}),
    ({"max_depth": 15}, {"max_depth": 16}),
    ({"max_bins": 2}, {"max_bins": 1}),
    ({"max_bins": 100}, {"max_bins": 101}),
    ({"min_info_gain": 1.0}, {"min_info_gain": 1.1}),
    ({"min_weight_fraction_per_node": 0.0}, {"min_weight_fraction_per_node": 0.5}),
    ({"subsampling_rate": 1.0}, {"subsampling_rate": 0.0}),
    ({"train_split": 0.5}, {"train_split": 1.0}),
    ({"feature_subset": "onethird"}, {"feature_subset": "some"}),
    ({"impurity": "variance"}, {"impurity": "gini"}),
]


@pytest.mark.parametrize("good, bad", [*TREE_BOUNDS, ({"num_trees": 1000}, {"num_trees": 0}), ({"num_trees": 1}, {"num_trees": 1001})])
def test_forest_bounds(good, bad):
    ops.ForestParams(**good).validate()
    with pytest.raises(ValueError):
        ops.ForestParams(**bad).validate()


@pytest.mark.parametrize(
    "good, bad",
    [
        *TREE_BOUNDS,
        ({"max_iter": 10_000}, {"max_iter": 0}),
        ({"step_size": 1.0}, {"step_size": 0.0}),
        ({"loss": "absolute"}, {"loss": "huber"}),
    ],
)
def test_boost_bounds(good, bad):
    ops.BoostParams(**good).validate()
    with pytest.raises(ValueError):
        ops.BoostParams(**bad).validate()


# ---------------------------------------------------------------- metrics


def test_metrics_equal_the_library(spark, planted):
    models = ops.linear_regression_by_key(planted, "k", ["x", "z"], "y")
    scored = ops.score_by_key(planted, models, "k", ["x", "z"]).cache()
    by_key = {r["k"]: r for r in ops.regression_metrics(scored, "y", "prediction", "k").collect()}
    moments = {r["k"]: r for r in ops.linear_metrics_by_key(planted, models, "k", ["x", "z"], "y").collect()}
    for key, row in by_key.items():
        part = scored.where(F.col("k") == key)
        for name in ("rmse", "r2"):
            want = RegressionEvaluator(labelCol="y", predictionCol="prediction", metricName=name).evaluate(part)
            assert math.isclose(row[name], want, rel_tol=1e-9)
            assert math.isclose(moments[key][name], want, rel_tol=1e-6)
        assert row["n"] == moments[key]["n"] == part.count()
    overall = ops.regression_metrics(scored, "y", "prediction").first()
    assert overall["n"] == planted.count()


def test_r2_is_relative_to_the_labels(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (3.0, 2.0)], "y double, p double")
    row = ops.regression_metrics(df, "y", "p").first()
    assert row["r2"] == pytest.approx(1 - (1 + 0.25 + 1) / 2)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 1.0)], "y double, p double")
    assert tuple(ops.regression_metrics(flat, "y", "p").first()) == (2, 1.0, None)


@pytest.mark.parametrize("features", [["x"], ["x", "z"], ["x", "z", *[f"g{i}" for i in range(8)]]])
def test_one_scan_fit_and_test_equals_the_two_step_form(spark, planted, features):
    planted = planted.withColumns({f: F.sin(F.col("x") * (i + 2)) for i, f in enumerate(features[2:])})
    train, test = ops.train_test_split(planted, ["id", "k"], 70)
    models = ops.linear_regression_by_key(train, "k", features, "y")
    want = {r["k"]: r for r in models.collect()}
    quality = {r["k"]: r for r in ops.linear_metrics_by_key(test, models, "k", features, "y").collect()}
    got = ops.linear_regression_with_test(planted, "k", features, "y", id_cols=["id", "k"], train_pct=70).collect()
    assert len(got) == 3
    for row in got:
        assert row["coefficients"] == pytest.approx(want[row["k"]]["coefficients"])
        assert row["rmse"] == pytest.approx(want[row["k"]]["rmse"])
        assert row["test_n"] == quality[row["k"]]["n"]
        assert row["test_rmse"] == pytest.approx(quality[row["k"]]["rmse"])
        assert row["test_r2"] == pytest.approx(quality[row["k"]]["r2"])


# ---------------------------------------------------------------- trees


@pytest.fixture(scope="module")
def steps(spark):
    rng = random.Random(9)
    rows = []
    for key, n in (("a", 300), ("b", 900)):
        for i in range(n):
            x, z = rng.uniform(0, 10), rng.uniform(0, 1)
            rows.append((key, i, x, z, (20.0 if x > 5 else 0.0) + z + rng.gauss(0, 0.3)))
    return spark.createDataFrame(rows, "k string, id int, x double, z double, y double").cache()


@pytest.mark.parametrize("which", ["forest", "boost"])
def test_trees_learn_and_repeat(spark, steps, which):
    if which == "forest":
        fit, params = ops.random_forest_by_key, ops.ForestParams(num_trees=5, max_depth=4, bootstrap=True, feature_subset="all")
    else:
        fit, params = ops.gbt_by_key, ops.BoostParams(max_iter=4, max_depth=3, step_size=0.5)
    first = fit(steps, "k", ["x", "z"], "y", ["b", "nope", "a"], id_cols=["id"], params=params).collect()
    again = fit(steps.repartition(5), "k", ["x", "z"], "y", ["b", "nope", "a"], id_cols=["id"], params=params).collect()
    got = {r["k"]: r for r in first}
    assert got["nope"]["rmse"] is None
    # predicting the mean has an RMSE near 10
    assert all(got[k]["rmse"] < 3 and got[k]["r2"] > 0.9 for k in "ab")
    for row in again:
        if row["rmse"] is not None:
            assert row["rmse"] == pytest.approx(got[row["k"]]["rmse"], rel=1e-9)


def grown(rows, splits, params, plan):
    """Brute force of a single tree on all rows: list of (node, feature, value at the cut)."""
    out = []

    def grow(node, part, level):
        x, y = np.array([r[0] for r in part]), np.array([r[1] for r in part])
        best = None
        if level < params.max_depth:
            for f in range(x.shape[1]):
                for cut in splits[f]:
                    left = x[:, f] <= cut
                    if min(left.sum(), (~left).sum()) < params.min_instances_per_node or left.all() or not left.any():
                        continue
                    gain = y.var() - (left.mean() * y[left].var() + (~left).mean() * y[~left].var())
                    if gain > max(params.min_info_gain, 1e-9) and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, cut, left)
        if best is None:
            out.append((node, None, round(float(y.mean()), 6)))
            return
        _, f, cut, left = best
        out.append((node, f, cut))
        grow(2 * node, [r for r, here in zip(part, left) if here], level + 1)
        grow(2 * node + 1, [r for r, here in zip(part, left) if not here], level + 1)

    grow(1, rows, 0)
    return out


@pytest.mark.parametrize("params", [ops.ForestParams(num_trees=1, max_depth=3), ops.ForestParams(num_trees=1, max_depth=5, min_info_gain=0.05, min_instances_per_node=9)])
def test_one_tree_equals_brute_force(spark, params):
    """A single tree on all training rows is the greedy tree; its error on the held-out rows tells."""
    rng = random.Random(21)
    rows = []
    for key in "abc":
        for i in range(240):
            x, z = rng.randrange(12), rng.randrange(9)
            rows.append((key, i, float(x), float(z), float((x > 4) * 5 + (z % 3 == 1) * (x - 3) + rng.randrange(5))))
    df = spark.createDataFrame(rows, "k string, id int, x double, z double, y double").repartition(4)
    got = {r["k"]: r for r in ops.random_forest_by_key(df, "k", ["x", "z"], "y", id_cols=["id"], params=params).collect()}
    placed = {r["id"]: r["t"] for r in df.select("id", (row_hash(df, ["id"]) < 0.8 * MODULUS).alias("t")).distinct().collect()}
    for key in "abc":
        train = [((r[2], r[3]), r[4]) for r in rows if r[0] == key and placed[r[1]]]
        test = [((r[2], r[3]), r[4]) for r in rows if r[0] == key and not placed[r[1]]]
        splits = [sorted({r[0][f] for r in train})[:-1] for f in (0, 1)]
        tree = {node: (f, cut) for node, f, cut in grown(train, splits, params, None)}

        def predict(x):
            node = 1
            while tree[node][0] is not None:
                node = 2 * node + (x[tree[node][0]] > tree[node][1])
            return tree[node][1]

        error = np.array([y - predict(x) for x, y in test])
        y = np.array([y for _, y in test])
        assert got[key]["test_n"] == len(test)
        assert got[key]["rmse"] == pytest.approx(np.sqrt(np.mean(error**2)), rel=1e-5)
        assert got[key]["r2"] == pytest.approx(1 - np.mean(error**2) / y.var(), rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("loss", ["squared", "absolute"])
@pytest.mark.parametrize("iterations", [1, 2, 6])
def test_boosting_equals_the_library(spark, steps, loss, iterations):
    """All rows train and no feature is left out, so the library has nothing to draw."""
    params = ops.BoostParams(max_iter=iterations, max_depth=2, step_size=0.3, loss=loss, max_bins=100, train_split=0.8)
    even = steps.withColumns({"x": F.floor("x"), "z": F.floor(F.col("z") * 6)})
    got = {r["k"]: r for r in ops.gbt_by_key(even, "k", ["x", "z"], "y", id_cols=["id"], params=params).collect()}
    train = even.where(row_hash(even, ["id"]) < 0.8 * MODULUS)
    test = even.where(row_hash(even, ["id"]) >= 0.8 * MODULUS)
    for key in "ab":
        parts = [ops.assemble(side.where(F.col("k") == key), ["x", "z"], keep=["y"]) for side in (train, test)]
        model = GBTRegressor(labelCol="y", maxIter=iterations, maxDepth=2, stepSize=0.3, lossType=loss, maxBins=100).fit(parts[0])
        want = RegressionEvaluator(labelCol="y", metricName="rmse").evaluate(model.transform(parts[1]))
        assert got[key]["rmse"] == pytest.approx(want, rel=1e-5)


def test_a_forest_is_about_as_good_as_the_library(spark, steps):
    params = ops.ForestParams(num_trees=12, max_depth=4, bootstrap=True, feature_subset="sqrt", subsampling_rate=0.8)
    got = {r["k"]: r for r in ops.random_forest_by_key(steps, "k", ["x", "z"], "y", id_cols=["id"], params=params).collect()}
    train = steps.where(row_hash(steps, ["id"]) < 0.8 * MODULUS)
    test = steps.where(row_hash(steps, ["id"]) >= 0.8 * MODULUS)
    for key in "ab":
        parts = [ops.assemble(side.where(F.col("k") == key), ["x", "z"], keep=["y"]) for side in (train, test)]
        model = RandomForestRegressor(
            labelCol="y", numTrees=12, maxDepth=4, subsamplingRate=0.8, bootstrap=True, featureSubsetStrategy="all", seed=3
        ).fit(parts[0])
        want = RegressionEvaluator(labelCol="y", metricName="rmse").evaluate(model.transform(parts[1]))
        assert got[key]["rmse"] < 3 * want and got[key]["r2"] > 0.9


def test_many_keys_odd_keys_and_constants(spark):
    rows = [(f"k{i % 150}", i, float(i % 7), float(i % 7 > 3) * (i % 150)) for i in range(3000)]
    rows += [("flat", 10_000 + i, 1.0, 5.0) for i in range(40)] + [("one", 99_999, 1.0, 2.0), (None, 5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, id int, x double, y double").repartition(3)
    params = ops.ForestParams(num_trees=2, max_depth=2)
    jobs = lambda: spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    before = len(jobs())
    got = {r["key"]: r for r in ops.random_forest_by_key(df, "key", ["x"], "y", id_cols=["id"], params=params).collect()}
    assert len(jobs()) - before < 120  # fewer than the keys
    assert set(got) <= {r[0] for r in rows if r[0]} and len(got) >= 151
    assert got["flat"]["rmse"] == pytest.approx(0, abs=1e-9) and got["flat"]["r2"] is None
    assert all(got[f"k{i}"]["r2"] is None or got[f"k{i}"]["r2"] > 0.99 for i in range(1, 150))
    shallow = ops.random_forest_by_key(df, "key", ["x"], "y", ["flat", "k7"], id_cols=["id"], params=ops.ForestParams(num_trees=1, max_depth=0))
    assert {r["key"]: r["rmse"] is not None for r in shallow.collect()} == {"flat": True, "k7": True}
    empty = ops.gbt_by_key(df.limit(0), "key", ["x"], "y", id_cols=["id"])
    assert empty.collect() == []


@pytest.mark.parametrize("step", ["bins", "histograms", "errors"])
def test_trees_hold_one_block_of_a_batch(step):
    """What a Python worker holds beside a batch does not grow with the number of its blocks."""
    plan = trees._Plan(2, 2, 8, 2, 1.0, False, False, 1.0, False, 1)
    rows, rng = 2_000, np.random.default_rng(3)
    block = {
        "key": "a", "ids": rng.integers(0, 2**62, rows).tobytes(), "train": (np.arange(rows) % 3 > 0).tobytes(),
        "y": rng.random(rows).tobytes(), "scale": 1024.0,
    }
    if step == "bins":
        run = trees._to_bins(pa.string(), 2)
        block |= {"x": rng.random(2 * rows).tobytes(), "cuts": [[0.25, 0.5], [0.75]], "middle": 0.5}
    else:
        run = trees._histograms(range(2), 0, 2, plan, pa.string()) if step == "histograms" else trees._errors(2, plan, pa.string())
        root = [{"tree": t, "node": 0, "feature": -1, "bin": -1, "left": 0.5, "right": 0.0} for t in range(2)]
        block |= {"bins": rng.integers(0, 8, 2 * rows).astype(np.uint8).tobytes(), "model": root if step == "errors" else None}

    def peak(blocks):
        batch = pa.RecordBatch.from_pylist([block] * blocks)
        tracemalloc.start()
        out = sum(b.num_rows for b in run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    peak(1)
    (few, low), (many, high) = peak(3), peak(300)
    assert many == 100 * few and high < 4 * low


def test_trees_check_their_columns(steps):
    with pytest.raises(ValueError):
        ops.random_forest_by_key(steps, "k", ["x", "y"], "y", ["a"], id_cols=["id"])


# ---------------------------------------------------------------- clustering


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(4)
    rows = [
        (f"e{i}", cx + rng.gauss(0, 0.3), cy + rng.gauss(0, 0.3))
        for i, (cx, cy) in enumerate([(0, 0), (10, 0), (0, 10)] * 60)
    ]
    rows += [("missing", None, 1.0)] + [(f"copy{i}", 0.0, 0.0) for i in range(200)]
    return spark.createDataFrame(rows, "k string, p double, q double").cache()


def groups(predictions):
    out = {}
    for r in predictions.collect():
        out.setdefault(r["prediction"], set()).add(r["k"])
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("operator", [ops.kmeans, ops.bisecting_kmeans, ops.gaussian_mixture])
def test_clusters_are_found_and_repeatable(spark, blobs, operator):
    first = operator(blobs, "k", ["p", "q"], 3, partitions=4)
    assert first.predictions.count() == 380 and first.components.count() == 3
    assert {r["prediction"] for r in first.predictions.collect()} <= {0, 1, 2}
    again = operator(blobs.repartition(7), "k", ["p", "q"], 3, partitions=4)
    assert groups(first.predictions) == groups(again.predictions)
    sizes = sorted(len(g) for g in groups(first.predictions))
    if operator is ops.kmeans:
        assert sizes == [60, 60, 260]
    if operator is ops.bisecting_kmeans:
        # all rows count, copies too, and the larger of the first two parts is divided again
        assert len(sizes) == 3 and sizes[1] == 120 and sum(sizes) == 380


@pytest.mark.parametrize("operator", [ops.kmeans, ops.bisecting_kmeans, ops.gaussian_mixture, ops.lda])
def test_fits_do_not_depend_on_shuffle_partitions(spark, blobs, operator):
    runs = []
    try:
        for n in ("1", "3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found = operator(blobs.repartition(int(n)), "k", ["p", "q"], 3, max_iter=6)
            runs.append({r["k"]: r["prediction"] for r in found.predictions.collect()})
            assert found.predictions.count() == 380
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1] == runs[2]
    with pytest.raises(ValueError):
        operator(blobs, "k", ["p", "q"], 3, partitions=0)


def test_kmeans_lowers_the_cost(spark, blobs):
    three = ops.kmeans(blobs, "k", ["p", "q"], 3)
    two = ops.kmeans(blobs, "k", ["p", "q"], 2)
    assert three.summary["training_cost"] < two.summary["training_cost"]


def test_mixture_weights_sum_to_one(spark, blobs):
    rows = ops.gaussian_mixture(blobs, "k", ["p", "q"], 3, max_iter=20).components.collect()
    assert sum(r["weight"] for r in rows) == pytest.approx(1.0)
    assert all(len(r["mean"]) == 2 and np.array(r["covariance"]).shape == (2, 2) for r in rows)


def test_lda(spark, blobs):
    got = ops.lda(blobs, "k", ["p", "q"], 3, max_iter=5)
    rows = got.predictions.collect()
    assert len(rows) == 380
    for r in rows:
        assert sum(r["topic_distribution"]) == pytest.approx(1.0)
        assert r["prediction"] == int(np.argmax(r["topic_distribution"]))
    assert set(got.summary) == {"log_likelihood", "log_perplexity"}
    assert {t for r in got.components.collect() for t in r["terms"]} == {"p", "q"}


def test_lda_in_parts(spark, blobs, monkeypatch):
    """More entities, more tasks, in the fit and in the predictions; the figures are the library's."""
    small = ops.lda(blobs.coalesce(1), "k", ["p", "q"], 3, max_iter=2)
    assert small.predictions.rdd.getNumPartitions() == clustering.PARTITIONS
    monkeypatch.setattr(clustering, "_TOPIC_ROWS", 20)
    got = ops.lda(blobs.coalesce(1), "k", ["p", "q"], 3, max_iter=2)
    assert got.predictions.rdd.getNumPartitions() == 19 and got.predictions.count() == 380
    points = as_vector(ops.prepare_features(blobs, "k", ["p", "q"])).select("k", "features")
    part = F.pmod(F.xxhash64("k"), F.lit(19)).cast("int")
    corpus = points.repartitionById(19, part).sortWithinPartitions("k").cache()
    model = LDA(k=3, maxIter=2, seed=1, subsamplingRate=1.0).fit(corpus)
    assert got.summary["log_likelihood"] == pytest.approx(model.logLikelihood(corpus), rel=1e-6)
    assert got.summary["log_perplexity"] == pytest.approx(model.logPerplexity(corpus), rel=1e-6)


def test_power_iteration(spark):
    edges = [(a, b, 1.0) for g in (range(0, 6), range(10, 16)) for a in g for b in g if a < b] + [(5, 10, 0.01), (3, 3, 9.0)]
    df = spark.createDataFrame(edges + [(1, 0, 1.0)], "a long, b long, w double")
    got = {r["id"]: r["cluster"] for r in ops.power_iteration(df, "a", "b", "w", 2, max_iter=30).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1
    assert got[0] != got[10]


def test_power_iteration_equals_dense_algebra(spark):
    """The clusters are intervals of the vector that dense products give from the same start, at any layout."""
    rng = np.random.default_rng(8)
    n = 60
    edges = [(int(a), int(b) + 100, float(w)) for a, b, w in zip(rng.integers(0, n, 400), rng.integers(0, n, 400), rng.integers(1, 9, 400))]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    ids = sorted({i for a, b, _ in edges for i in (a, b)})
    uniform = [F.pmod(F.xxhash64(F.lit(1), F.lit(i), "id"), F.lit(1 << 52)) / float(1 << 52) for i in range(2)]
    drawn = spark.createDataFrame([(i,) for i in ids], "id long").select("id", *[u.alias(f"u{i}") for i, u in enumerate(uniform)]).collect()
    v = np.array([np.sqrt(-2 * np.log(1 - r["u0"])) * np.cos(2 * np.pi * r["u1"]) for r in sorted(drawn)])
    weights, place = np.zeros((len(ids), len(ids))), {i: p for p, i in enumerate(ids)}
    for a, b, w in edges:
        weights[place[a], place[b]] += w
        weights[place[b], place[a]] += w
    for _ in range(5):
        v = (weights / weights.sum(axis=1)[:, None]) @ (v / np.abs(v).sum())
    for parts in (1, 7):
        found = ops.power_iteration(df.repartition(parts), "a", "b", "w", 3, max_iter=5, partitions=parts).collect()
        got = {r["id"]: r["cluster"] for r in found}
        assert sorted(got) == ids and set(got.values()) <= {0, 1, 2}
        along = [got[i] for _, i in sorted(zip(v, ids))]
        assert sum(x != y for x, y in zip(along, along[1:])) == len(set(along)) - 1


def test_power_iteration_refuses_negative_weights(spark):
    with pytest.raises(Exception, match="at least 0"):
        ops.power_iteration(spark.createDataFrame([(1, 2, -1.0), (2, 3, 1.0)], "a long, b long, w double"), "a", "b", "w", 2)
    empty = spark.createDataFrame([(1, 1, 1.0)], "a long, b long, w double")
    assert ops.power_iteration(empty, "a", "b", "w", 2).collect() == []


@pytest.mark.parametrize("operator", [ops.kmeans, ops.bisecting_kmeans, ops.gaussian_mixture, ops.lda])
def test_clustering_parameters(blobs, operator):
    with pytest.raises(ValueError):
        operator(blobs, "k", ["p", "q"], 1)
    with pytest.raises(ValueError):
        operator(blobs, "k", ["p", "q"], 3, max_iter=0)
