"""Feature preparation: scaling, vectors, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.functions.split import split_percentile
from arealis.operators.stages import drop_incomplete, select_features


def minmax_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value of each column: one row, ``<column>_min`` and ``<column>_max``."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*aggs)


def minmax_scale(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale the feature columns to [0, 1]; a constant column becomes 0.5.

    One pass finds the bounds, two numbers per feature; the scaling itself is
    plain column arithmetic in the caller's plan.
    """
    bounds = minmax_bounds(df, features).first()
    scaled = {}
    for c in features:
        low, high = bounds[f"{c}_min"], bounds[f"{c}_max"]
        value = F.col(c).cast("double")
        if low is None or low == high:
            scaled[c] = F.when(value.isNotNull(), F.lit(0.5))
        else:
            scaled[c] = (value - F.lit(float(low))) / F.lit(float(high) - float(low))
    return df.withColumns(scaled)


def assemble(
    df: DataFrame, features: Sequence[str], *, keep: Sequence[str] = (), out: str = "features", nulls: str = "error"
) -> DataFrame:
    """Feature columns as one vector; a null is an error unless ``nulls="skip"``."""
    if out in keep or out in features:
        raise ValueError(f"column {out!r} would be overwritten")
    assembler = VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid=nulls)
    return assembler.transform(df).select(*keep, out)


def prepare_features(df: DataFrame, key: str, features: Sequence[str], *, out: str = "features") -> DataFrame:
    """Select, drop incomplete rows, scale, and pack into an array: key, features."""
    rows = drop_incomplete(select_features(df, key, features), [key, *features])
    return minmax_scale(rows, features).select(key, F.array(*[F.col(c) for c in features]).alias(out))


def as_vector(df: DataFrame, column: str = "features") -> DataFrame:
    """Turn an array column into a vector column."""
    return df.withColumn(column, array_to_vector(F.col(column)))


def train_test_split(df: DataFrame, id_cols: Sequence[str], train_pct: int = 80) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the row's id: the same rows on every run and every cluster."""
    if not 0 < train_pct < 100:
        raise ValueError("train_pct must be between 1 and 99")
    place = split_percentile(df, id_cols)
    return df.where(place < train_pct), df.where(place >= train_pct)
