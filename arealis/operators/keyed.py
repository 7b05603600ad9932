"""Requested keys: restricting to them, answering them, fitting one model each."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any, TypeVar

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

T = TypeVar("T")

# Up to this many keys are written into the filter, where they reach the files; more are joined.
MAX_IN_FILTER = 1_000
# Fits run many short jobs; smaller partitions than this only add tasks.
ROWS_PER_PARTITION = 100_000


def _listed(df: DataFrame, key: str, keys: Sequence[Any], ord_col: str) -> DataFrame:
    """A list of keys as a table, numbered in its order."""
    schema = StructType([StructField(ord_col, LongType(), False), StructField(key, df.schema[key].dataType)])
    return df.sparkSession.createDataFrame(list(enumerate(keys)), schema)


def restrict_keys(df: DataFrame, key: str, keys: Sequence[Any] | DataFrame) -> DataFrame:
    """Rows of the requested keys, a list or a table with a column ``key``.

    A short list becomes a filter that reaches the files; a longer one, or a
    table, becomes a semi-join.  No broadcast is forced: the planner knows the
    size of either.  The values are taken in the column's type in all cases.
    """
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(key).cast(df.schema[key].dataType).alias(key)), key, "left_semi")
    wanted = list(dict.fromkeys(keys))
    if len(wanted) <= MAX_IN_FILTER:
        return df.where(F.col(key).isin([F.lit(k).cast(df.schema[key].dataType) for k in wanted]))
    return df.join(_listed(df, key, wanted, "_ord").select(key), key, "left_semi")


def for_keys(result: DataFrame, keys: Sequence[Any] | DataFrame, key: str, *, ord_col: str = "ord") -> DataFrame:
    """Answer every requested key, in request order.

    ``keys`` is a list, or a table with the columns ``key`` and ``ord``, of any
    length.  A key asked for twice is answered twice and a key without data
    gives a row of nulls; ``ord`` is the position in the request.  The other
    columns come from ``result``, which should hold few rows per key
    (documents, counts, models), since a key's rows are repeated for each time
    it is asked for.  Where ``result`` is grouped by the key, only the rows of
    requested keys are aggregated.
    """
    if isinstance(keys, DataFrame):
        requested = keys.select(ord_col, F.col(key).cast(result.schema[key].dataType).alias(key))
    else:
        keys = list(keys)
        requested = _listed(result, key, keys, ord_col).withColumn(ord_col, F.col(ord_col).cast("int"))
    answers = restrict_keys(result, key, keys)
    return requested.join(answers, key, "left").select(
        ord_col, key, *[answers[c] for c in result.columns if c != key]
    )


def spread_by_size(
    df: DataFrame, key: str, keys: Sequence[Any], spread_by: Sequence[str], *, partitions: int | None = None
) -> DataFrame:
    """Rows of the requested keys, laid out for one model fit per key.

    A small key sits in one partition, so that its fit touches that partition
    only; a key with many rows is spread by a hash of ``spread_by`` over as
    many partitions as its share of the rows asks for.  Hash and order depend
    on the data alone: a lost partition is rebuilt identically.
    """
    rows = restrict_keys(df, key, keys)
    # one count per requested key
    sizes = {row[key]: row["n"] for row in rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    n = partitions or max(1, math.ceil(total / ROWS_PER_PARTITION))
    share = max(1.0, total / n)
    slots, before = [], 0
    for value in sorted(sizes):
        slots.append((value, int(before / share), math.ceil(sizes[value] / share)))
        before += sizes[value]
    schema = StructType(
        [
            StructField(key, df.schema[key].dataType),
            StructField("_slot", IntegerType()),
            StructField("_width", IntegerType()),
        ]
    )
    placed = rows.join(F.broadcast(df.sparkSession.createDataFrame(slots, schema)), key)
    salt = F.pmod(F.xxhash64(*spread_by), F.col("_width").cast("bigint"))
    partition = F.pmod(F.col("_slot") + salt, F.lit(n)).cast("int")
    return placed.repartitionById(n, partition).sortWithinPartitions(key, *spread_by).drop("_slot", "_width")


def fit_by_key(
    df: DataFrame, key: str, keys: Sequence[Any], fit: Callable[[Any, DataFrame], T], *, parallelism: int = 8
) -> list[T]:
    """Call ``fit(key, rows)`` for each key, a bounded number at a time.

    ``df`` is kept while the fits run.  Each fit is itself a distributed job,
    so a large key is no problem for it.
    """
    keys = list(keys)
    if not keys:
        return []
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    pool = ThreadPool(min(parallelism, len(keys)))
    try:
        run = inheritable_thread_target(df.sparkSession)(lambda k: fit(k, kept.where(F.col(key) == F.lit(k))))
        return pool.map(run, keys)
    finally:
        pool.close()
        kept.unpersist()
