"""Pipeline stages; all of them compose with ``DataFrame.transform``."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.functions.predicates import predicate
from arealis.functions.split import row_hash
from arealis.operators.grouping import MAX_ARRAY, push, push_parts, sortable_columns
from arealis.operators.positions import ROWS_PER_TASK
from arealis.operators.skew import BLOCK, MAX_CUTS, order_number, with_ranges


#: places that :func:`row_hash` gives, as a power of two, and intervals in which they are counted at a time
_PLACES, _INTERVALS = 1 << 31, 1 << 16


def match(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """Rows that meet all conditions of ``spec``."""
    return df.where(predicate(spec, df.schema))


def project(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    """Keep the ``include`` columns or drop the ``exclude`` columns."""
    if (include is None) == (exclude is None):
        raise ValueError("give either include or exclude")
    return df.select(*include) if include is not None else df.drop(*exclude)


def select_features(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """The key and the feature columns."""
    return df.select(key, *features)


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in ``columns`` (all columns by default)."""
    return df.na.drop("any", subset=list(columns) if columns is not None else None)


def add_fields(df: DataFrame, **fields: Column | Any) -> DataFrame:
    """Add or replace columns; plain values become constants."""
    return df.withColumns({n: v if isinstance(v, Column) else F.lit(v) for n, v in fields.items()})


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns, old name to new name."""
    return df.withColumnsRenamed(dict(names))


def sort(df: DataFrame, spec: Mapping[str, int], *, tie_cols: Sequence[str] = ()) -> DataFrame:
    """Sort by the columns of ``spec``: 1 ascending (nulls first), -1 descending (nulls last).

    Rows with equal sort values follow a hash of ``tie_cols``.  That makes their
    order repeatable, and lets many rows with one sort value be sorted by
    several tasks.  Only the named columns are read for it; without any, rows
    with equal sort values have no set order.
    """
    if not spec or set(spec.values()) - {1, -1}:
        raise ValueError("sort directions are 1 and -1")
    order = [F.asc_nulls_first(c) if d == 1 else F.desc_nulls_last(c) for c, d in spec.items()]
    if not tie_cols:
        return df.orderBy(*order)
    return df.withColumn("_ties", F.xxhash64(*tie_cols)).orderBy(*order, "_ties").drop("_ties")


def unwind(df: DataFrame, column: str, *, keep_empty: bool = False, index: str | None = None) -> DataFrame:
    """One row per array element; ``keep_empty`` keeps rows with a null or empty array."""
    others = {c: F.col(c) for c in df.columns}
    if index is None:
        explode = F.explode_outer if keep_empty else F.explode
        return df.select(*[explode(c).alias(c) if c == column else others[c] for c in df.columns])
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return df.select(
        *[explode(c).alias(index, c) if c == column else others[c] for c in df.columns]
    )


def lookup(
    df: DataFrame,
    other: DataFrame,
    left_key: str,
    right_key: str,
    as_: str,
    *,
    fields: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
    max_array: int = MAX_ARRAY,
    large_keys: str | None = "auto",
    rows_per_task: int = ROWS_PER_TASK,
    sums: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Attach the matching rows of ``other`` as an array of structs.

    No match gives an empty array; null keys match each other.  ``other`` is
    first reduced to the keys that ``df`` has, and the arrays are built once
    per key before the join.  Rows are (row of ``df``, part): match i of a key
    is in part ``i div max_array``, in the column ``<as_>_part``, so a key with
    more matches gives its rows several times.  With ``sums``, a number of an
    array by name, each row of ``df`` comes once, with the sums over all
    arrays of its key in place of the part and the array.
    """
    fields = list(fields) if fields is not None else other.columns
    order = list(order) if order is not None else [c for c in sortable_columns(other) if c != right_key]
    wanted = df.select(F.col(left_key).alias("_wanted")).distinct()
    keyed = other.withColumn("_lookup_key", F.col(right_key))
    keyed = keyed.join(wanted, keyed["_lookup_key"].eqNullSafe(wanted["_wanted"]), "left_semi")
    spec = push(fields, order or ["_lookup_key"], max_array=max_array)
    arrays = push_parts(keyed, ["_lookup_key"], spec, as_, large_keys=large_keys, rows_per_task=rows_per_task)
    part = f"{as_}_part"
    arrays = arrays.withColumnRenamed("part", part)
    kind = arrays.schema[as_].dataType
    if sums:
        numbers = arrays.select("_lookup_key", *[number(F.col(as_)).alias(n) for n, number in sums.items()])
        totals = numbers.groupBy("_lookup_key").agg(*[F.sum(n).alias(n) for n in sums])
        return df.join(totals, df[left_key].eqNullSafe(totals["_lookup_key"]), "left").select(
            *[df[c] for c in df.columns],
            *[F.coalesce(totals[n], number(F.array().cast(kind))).alias(n) for n, number in sums.items()],
        )
    return df.join(arrays, df[left_key].eqNullSafe(arrays["_lookup_key"]), "left").select(
        *[df[c] for c in df.columns],
        F.coalesce(arrays[part], F.lit(0).cast("bigint")).alias(part),
        F.coalesce(arrays[as_], F.array().cast(kind)).alias(as_),
    )


def union_with(df: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of both frames, by column name; columns only one has are null in the other."""
    return df.unionByName(other, allowMissingColumns=True)


def replace_root(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct column become the row."""
    return df.select(f"{column}.*")


def bucket(
    df: DataFrame,
    column: str,
    boundaries: Sequence[Any],
    default: Any = None,
    aggs: Mapping[str, Column] | None = None,
    *,
    out: str = "bucket",
) -> DataFrame:
    """Group by the range ``[b, next b)`` that holds the value; the bucket is named by its lower bound.

    Values outside all ranges go to the ``default`` bucket, and are an error
    where there is none.
    """
    bounds = list(boundaries)
    if len(bounds) < 2 or any(a >= b for a, b in zip(bounds, bounds[1:])):
        raise ValueError("boundaries must be at least two ascending values")
    text = isinstance(default, str) and not isinstance(bounds[0], str)

    def name(value: Any) -> Column:
        return F.lit(str(value)) if text else F.lit(value)

    value = F.col(column)
    chain = F
    for low, high in zip(bounds, bounds[1:]):
        chain = chain.when((value >= F.lit(low)) & (value < F.lit(high)), name(low))
    if default is None:
        label = chain.otherwise(
            F.raise_error(F.concat(F.lit(f"value of {column} outside the boundaries: "), value.cast("string")))
        )
    else:
        label = chain.otherwise(F.lit(default))
    accumulators = aggs or {"count": F.count(F.lit(1))}
    return df.groupBy(label.alias(out)).agg(*[c.alias(n) for n, c in accumulators.items()])


def bucket_auto(df: DataFrame, column: str, n: int, *, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """At most ``n`` buckets with about as many rows each: bucket, min, max, count.

    A value goes to bucket ``floor(n * rows before it / all rows)``, so equal
    values share a bucket; buckets that stay empty are not numbered.  Nulls are
    the lowest value.  The rows
    before a value are counted exactly: values are first combined with their
    frequency, ranges of values are accumulated in parallel, and the ranges'
    totals (a few thousand rows at most) are accumulated last.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    known = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v"))
    position = order_number(known, "_v")
    if position is None:
        raise ValueError(f"values of {column!r} have no order to cut at")
    spans = MAX_CUTS - 1
    quantiles = F.percentile_approx(position, [i / spans for i in range(spans + 1)], 10 * MAX_CUTS)
    # nulls are counted with the rest, and have no quantile
    every = df.select(F.col(column).alias("_v"))
    summary = every.agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("known"), quantiles.alias("cuts")).first()
    nulls = summary["n"] - summary["known"]
    everything, cuts = max(summary["n"], 1), sorted(set(summary["cuts"] or []))
    parts = math.ceil(everything / rows_per_task / spans)
    values = known.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    if everything > rows_per_task and len(cuts) > 1:
        placed = with_ranges(values, "_v", cuts, parts)
        totals = placed.groupBy(BLOCK).agg(F.sum("_n").alias("_sum"))
        offsets = totals.select(BLOCK, (F.sum("_sum").over(Window.orderBy(BLOCK)) - F.col("_sum")).alias("_offset"))
        inside = F.sum("_n").over(Window.partitionBy(BLOCK).orderBy("_v")) - F.col("_n")
        counted = placed.withColumn("_inside", inside).join(F.broadcast(offsets), BLOCK)
        before = F.col("_offset") + F.col("_inside")
    else:
        # few enough values for one task
        counted = values.withColumn("_inside", F.sum("_n").over(Window.orderBy("_v")) - F.col("_n"))
        before = F.col("_inside")
    numbered = counted.select("_v", "_n", F.floor((before + nulls) * n / everything).alias("_bucket"))
    if nulls:
        lowest = df.sparkSession.range(1).select(F.lit(None).alias("_v"), F.lit(nulls).alias("_n"), F.lit(0).alias("_bucket"))
        numbered = numbered.union(lowest)
    # a null is the least value
    least = F.when(~F.bool_or(F.col("_v").isNull()), F.min("_v"))
    buckets = numbered.groupBy("_bucket").agg(least.alias("min"), F.max("_v").alias("max"), F.sum("_n").alias("count"))
    dense = F.row_number().over(Window.orderBy("_bucket")) - 1
    return buckets.select(dense.cast("bigint").alias("bucket"), "min", "max", "count")


def sample_n(df: DataFrame, n: int, seed: int, *, id_cols: Sequence[str] | None = None) -> DataFrame:
    """``n`` rows drawn at random: those with the lowest hashes of their ids (without ``id_cols``: of the whole row).

    The draw depends on the ids and the seed alone, so it is the same however
    the rows are laid out; of rows with equal hashes the first by id are taken.
    The hash up to which rows are taken is found by counting hashes in
    intervals, twice; then the rows below it are a filter, and only those
    exactly at it are ordered.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    ids = list(id_cols) if id_cols is not None else df.columns
    place = row_hash(df, ids, seed)
    low, width, taken = 0, _PLACES, 0
    while width > 1:
        # the interval [low, low + width) holds the last place; count it in finer ones
        step = max(1, width // _INTERVALS)
        inside = df.select(place.alias("p")).where((F.col("p") >= low) & (F.col("p") < low + width))
        counts = inside.groupBy(F.floor((F.col("p") - low) / step).alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(counts, key=lambda r: r["i"]):
            if taken + row["n"] >= n:
                low, width = low + int(row["i"]) * step, step
                break
            taken += row["n"]
        else:
            return df  # no more rows than asked for
    last = df.where(place == low).orderBy(*ids).limit(n - taken)
    return df.where(place < low).unionAll(last)
