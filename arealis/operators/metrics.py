"""Regression metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, label: str, prediction: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """RMSE and r2 of predictions, overall or per group: by, n, rmse, r2.

    r2 is measured against the variance of the labels and is null where that
    is zero.  Rows without a label or a prediction do not count.
    """
    by = [] if by is None else [by] if isinstance(by, str) else list(by)
    y, error = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction)
    scored = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    sums = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("_sse"), F.var_pop(y).alias("_var")
    )
    return sums.select(
        *by,
        "n",
        F.when(F.col("n") > 0, F.sqrt(F.col("_sse") / F.col("n"))).alias("rmse"),
        F.when(F.col("_var") > 0, 1 - F.col("_sse") / (F.col("_var") * F.col("n"))).alias("r2"),
    )
