"""Table scans.

A scan is lazy: filters and column lists applied to the returned DataFrame are
pushed to the files by Catalyst, so no operator here takes a filter itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# The spatial resolutions for which a statistics table exists.
RESOLUTIONS = ("state", "county", "tract", "block")

_SUFFIX = {"parquet": ".parquet", "orc": ".orc", "json": ".json", "csv": ".csv"}


def load(
    spark: SparkSession,
    root: str,
    name: str,
    *,
    format: str = "parquet",
    schema: StructType | str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Scan the table ``name`` below ``root``.

    JSON and CSV carry no types, and inferring them reads the whole table
    once more, so both need an explicit ``schema``.  Formats without a known
    file suffix are read from ``root/name`` with the given reader options.
    """
    if schema is None and format in ("json", "csv"):
        raise ValueError(f"{format} table {name!r} needs an explicit schema")
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    if options:
        reader = reader.options(**options)
    return reader.load(f"{root.rstrip('/')}/{name}{_SUFFIX.get(format, '')}")


def stats_table(resolution: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Pick ``<resolution>_stats`` from ``tables``; the resolution's case does not matter."""
    wanted = resolution.lower()
    if wanted not in RESOLUTIONS:
        raise ValueError(f"unknown resolution {resolution!r}, expected one of {RESOLUTIONS}")
    name = f"{wanted}_stats"
    if name not in tables:
        raise ValueError(f"no table {name!r} among {sorted(tables)}")
    return tables[name]
