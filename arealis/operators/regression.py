"""One linear regression per key, all keys in one job: see :mod:`arealis.operators.moments` for the algebra."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from arealis.functions.split import split_percentile
from arealis.operators.features import assemble
from arealis.operators.keyed import fit_by_key, for_keys, restrict_keys, spread_by_size
from arealis.operators.moments import NAMES, moments_by_key, solved, solved_line
from arealis.operators.params import check_choice, check_range


@dataclass(frozen=True)
class LinearParams:
    """Hyper-parameters; a value out of its range is an error."""

    loss: str = "squaredError"
    solver: str = "auto"
    aggregation_depth: int = 2
    max_iter: int = 10
    elastic_net: float = 0.0
    epsilon: float = 1.35
    reg: float = 0.5
    tol: float = 1e-6
    fit_intercept: bool = True
    standardization: bool = True

    def validate(self) -> None:
        check_choice("loss", self.loss, ("squaredError", "huber"))
        check_choice("solver", self.solver, ("auto", "normal", "l-bfgs"))
        check_range("aggregation_depth", self.aggregation_depth, 2, 10)
        check_range("max_iter", self.max_iter, 0, 100, open_high=True)
        check_range("elastic_net", self.elastic_net, 0, 1)
        check_range("epsilon", self.epsilon, 1, 10, open_low=True)
        check_range("reg", self.reg, 0, 10)
        check_range("tol", self.tol, 0, 10)

    @property
    def from_moments(self) -> bool:
        """Whether the fit depends on the rows through their moments alone."""
        return self.loss == "squaredError"


def check_columns(key: str, features: Sequence[str], label: str) -> None:
    if not features:
        raise ValueError("at least one feature is needed")
    if label in features:
        raise ValueError(f"label {label!r} is also listed as a feature")
    if key == label or key in features:
        raise ValueError(f"key {key!r} cannot be label or feature")


def complete_rows(df: DataFrame, columns: Sequence[str], nulls: str) -> DataFrame:
    """Rows without nulls in ``columns``: others are an error, or skipped."""
    if nulls == "skip":
        return df.na.drop("any", subset=list(columns))
    if nulls != "error":
        raise ValueError("nulls must be 'error' or 'skip'")
    message = F.lit("null in " + ", ".join(columns))
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.raise_error(message)) for c in columns})


def linear_regression_by_key(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    *,
    keys: Sequence[Any] | None = None,
    params: LinearParams = LinearParams(),
    nulls: str = "error",
    parallelism: int = 8,
) -> DataFrame:
    """Fit ``label`` on ``features`` for every key (or for the requested ``keys``).

    Columns: key, total_iterations, rmse, r2, intercept, coefficients,
    objective_history; the metrics are those of the rows fitted on.

    Squared error depends on the data only through means and covariances per
    key, whatever the penalty, the solver's name and the number of features.
    These are one group-by, combined on the map side: neither the number of
    keys nor one very large key matters.  Without an L1 penalty the small
    systems are solved directly (no iterations), with one by coordinate descent
    of at most ``max_iter`` sweeps.  The Huber loss needs passes over the rows
    and runs one distributed fit per requested key.

    A constant feature has the coefficient 0, a constant label the model that
    is its mean (r2 null); of collinear features the shortest coefficients
    are taken.  Keys whose values are not finite have null figures.
    """
    check_columns(key, features, label)
    params.validate()
    rows = df if keys is None else restrict_keys(df, key, keys)
    rows = complete_rows(rows.where(F.col(key).isNotNull()).select(key, *features, label), [*features, label], nulls)
    if params.from_moments:
        models = _fitted(moments_by_key(rows, key, features, label), key, features, params)
    elif keys is None:
        raise ValueError("this loss fits key by key and needs an explicit list of keys")
    else:
        models = _iterative(rows, key, features, label, list(dict.fromkeys(keys)), params, parallelism)
    return models if keys is None else for_keys(models, list(dict.fromkeys(keys)), key).drop("ord")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _residual_variance(w: Column, p: int, prefix: str = "") -> Column:
    """Variance of ``y - w.x`` from moments: var(y) - 2 w.s + w.S.w."""
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(p - 1)), lambda i: _dot(w, F.slice(f"{prefix}cov_xx", i * p + 1, F.lit(p)))
    )
    quadratic = _dot(w, rows)
    spread = F.col(f"{prefix}var_y") - F.lit(2.0) * _dot(w, F.col(f"{prefix}cov_xy")) + quadratic
    return F.when(w.isNotNull(), F.greatest(spread, F.lit(0.0)))


def _quality(w: Column, b: Column, p: int, prefix: str) -> tuple[Column, Column]:
    """RMSE and r2 of the model ``b + w.x`` on rows given by their moments."""
    bias = F.col(f"{prefix}mean_y") - b - _dot(w, F.col(f"{prefix}mean_x"))
    mse = bias * bias + _residual_variance(w, p, prefix)
    return F.sqrt(mse), F.when(F.col(f"{prefix}var_y") > 0, 1 - mse / F.col(f"{prefix}var_y"))


def _fitted(moments: DataFrame, key: str, features: Sequence[str], params: LinearParams, keep: Sequence[str] = ()) -> DataFrame:
    how = {
        "reg": float(params.reg),
        "elastic_net": float(params.elastic_net),
        "fit_intercept": params.fit_intercept,
        "standardization": params.standardization,
        # fixed rule: this solver takes spreads with divisor n - 1, the others with n
        "unbiased": params.solver == "l-bfgs",
    }
    if len(features) == 1:
        return moments.select(key, *[c.alias(name) for name, c in solved_line(**how).items()], *keep)
    models = moments.withColumn("_model", solved(moments, **how, max_iter=params.max_iter, tol=float(params.tol)))
    return models.select(key, "_model.*", *keep)


def _iterative(
    rows: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    keys: list[Any],
    params: LinearParams,
    parallelism: int,
) -> DataFrame:
    estimator = LinearRegression(
        featuresCol="_features",
        labelCol=label,
        loss=params.loss,
        solver=params.solver,
        aggregationDepth=params.aggregation_depth,
        maxIter=params.max_iter,
        elasticNetParam=params.elastic_net,
        epsilon=params.epsilon,
        regParam=params.reg,
        tol=params.tol,
        fitIntercept=params.fit_intercept,
        standardization=params.standardization,
    )

    def fit(value: Any, part: DataFrame) -> tuple | None:
        if part.isEmpty():
            return None
        model = estimator.fit(part)
        summary = model.summary
        history = [] if params.loss == "huber" and params.max_iter == 0 else summary.objectiveHistory
        return (
            value,
            int(summary.totalIterations),
            float(summary.rootMeanSquaredError),
            float(summary.r2),
            float(model.intercept),
            [float(c) for c in model.coefficients],
            [float(v) for v in history],
        )

    laid_out = spread_by_size(rows, key, keys, [*features, label])
    vectors = assemble(laid_out, features, keep=[key, label], out="_features")
    results = [r for r in fit_by_key(vectors, key, keys, fit, parallelism=parallelism) if r is not None]
    schema = StructType(
        [
            StructField(key, rows.schema[key].dataType),
            StructField("total_iterations", IntegerType()),
            StructField("rmse", DoubleType()),
            StructField("r2", DoubleType()),
            StructField("intercept", DoubleType()),
            StructField("coefficients", ArrayType(DoubleType())),
            StructField("objective_history", ArrayType(DoubleType())),
        ]
    )
    return rows.sparkSession.createDataFrame(results, schema)


def score_by_key(
    df: DataFrame, models: DataFrame, key: str, features: Sequence[str], *, out: str = "prediction"
) -> DataFrame:
    """Add each row's prediction by its key's linear model; null without a model.

    The number of models grows with the number of keys, so no broadcast is
    forced: the planner broadcasts them when it has seen that they are few.
    """
    weights = models.select(key, F.col("intercept").alias("_b"), F.col("coefficients").alias("_w"))
    values = F.array(*[F.col(f).cast("double") for f in features])
    return df.join(weights, key, "left").withColumn(out, F.col("_b") + _dot(F.col("_w"), values)).drop("_b", "_w")


def linear_metrics_by_key(
    df: DataFrame, models: DataFrame, key: str, features: Sequence[str], label: str, *, nulls: str = "error"
) -> DataFrame:
    """RMSE and r2 of each key's linear model on further rows: key, n, rmse, r2.

    The rows are reduced to moments per key before they meet the models, so
    the join handles one row per key instead of every row.
    """
    check_columns(key, features, label)
    p = len(features)
    rows = complete_rows(df.where(F.col(key).isNotNull()).select(key, *features, label), [*features, label], nulls)
    moments = moments_by_key(rows, key, features, label)
    weights = models.select(key, F.col("intercept").alias("_b"), F.col("coefficients").alias("_w"))
    rmse, r2 = _quality(F.col("_w"), F.col("_b"), p, "")
    return moments.join(weights, key).select(key, "n", rmse.alias("rmse"), r2.alias("r2"))


def linear_regression_with_test(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    *,
    id_cols: Sequence[str],
    train_pct: int = 80,
    keys: Sequence[Any] | None = None,
    params: LinearParams = LinearParams(),
    nulls: str = "error",
) -> DataFrame:
    """Fit on the training rows and measure on the others, in one scan and one shuffle.

    The columns of :func:`linear_regression_by_key` and ``test_n``,
    ``test_rmse``, ``test_r2``.  The moments of both sides are gathered by one
    group-by, so the table is read once.  For squared error.
    """
    check_columns(key, features, label)
    params.validate()
    if not params.from_moments:
        raise ValueError("this loss needs passes over the rows; use linear_regression_by_key on a split")
    if not 0 < train_pct < 100:
        raise ValueError("train_pct must be between 1 and 99")
    rows = df if keys is None else restrict_keys(df, key, keys)
    placed = rows.where(F.col(key).isNotNull()).withColumn("_train", split_percentile(df, id_cols) < train_pct)
    rows = complete_rows(placed.select(key, *features, label, "_train"), [*features, label], nulls)
    moments = moments_by_key(rows, key, features, label, side="_train")
    test = [f"test_{c}" for c in NAMES]
    models = _fitted(moments, key, features, params, test)
    rmse, r2 = _quality(F.col("coefficients"), F.col("intercept"), len(features), "test_")
    models = models.withColumns({"test_rmse": rmse, "test_r2": r2}).drop(*test[1:])
    return models if keys is None else for_keys(models, list(dict.fromkeys(keys)), key).drop("ord")
