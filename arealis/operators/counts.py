"""Row counts of several tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.sources.tables import load


def count_frames(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Count the named frames: ord, name, n, ``ord`` being the place in the list.

    A table given twice is counted once and answered twice; different tables
    may have the same name.
    """
    if not frames:
        raise ValueError("at least one table is needed")
    places: dict[tuple[str, int], list[int]] = {}
    for place, (name, df) in enumerate(frames):
        places.setdefault((name, id(df)), []).append(place)
    counted = [
        df.agg(F.count(F.lit(1)).alias("n")).select(
            F.explode(F.array(*[F.lit(place) for place in at])).alias("ord"), F.lit(name).alias("name"), "n"
        )
        for (name, _), at in places.items()
        for df in [frames[at[0]][1]]
    ]
    return reduce(DataFrame.unionByName, counted)


def count_tables(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """Count tables below ``root``, answered in request order."""
    tables = {name: load(spark, root, name) for name in dict.fromkeys(names)}
    return count_frames([(name, tables[name]) for name in names])
