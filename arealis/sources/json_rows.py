"""Rows to JSON text and JSON text to rows."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def to_json_rows(
    df: DataFrame,
    *,
    drop_nulls: bool = True,
    defaults: Mapping[str, Any] | None = None,
    column: str = "json",
) -> DataFrame:
    """One JSON document per row.

    ``drop_nulls=True`` leaves null fields out.  ``drop_nulls=False`` writes
    every field, nulls replaced by ``defaults`` where a default is given.
    """
    if defaults:
        unknown = set(defaults) - set(df.columns)
        if unknown:
            raise ValueError(f"defaults for unknown columns {sorted(unknown)}")
        df = df.withColumns(
            {
                name: F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType))
                for name, value in defaults.items()
            }
        )
    options = {"ignoreNullFields": "true" if drop_nulls else "false"}
    return df.select(F.to_json(F.struct(*df.columns), options).alias(column))


def from_json_rows(df: DataFrame, column: str, schema: StructType | str) -> DataFrame:
    """Parse a column of JSON documents; the document's fields replace the column.

    Fields absent from a document are null, and so are all fields of a text
    that is no valid JSON.
    """
    kept = [name for name in df.columns if name != column]
    return df.select(*kept, F.from_json(column, schema).alias("_doc")).select(*kept, "_doc.*")


def write_json_rows(df: DataFrame, path: str, *, drop_nulls: bool = True, mode: str = "errorifexists") -> None:
    """Write rows as JSON lines, one file per task."""
    df.write.mode(mode).option("ignoreNullFields", str(drop_nulls).lower()).json(path)


def explode_json_objects(df: DataFrame, column: str, *, out: str = "value") -> DataFrame:
    """One row per JSON object in a result body.

    A body is either an array, of which the object elements are kept and the
    others skipped, or a single object.  A body that is no valid JSON gives no
    row.  The objects come back as ``VARIANT`` next to the other columns.
    """
    body = F.col(column)
    # JSON text is an array exactly if it opens with a bracket, so one parse will do
    as_array = F.when(body.rlike(r"^\s*\["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    kept = [name for name in df.columns if name != out]
    # a body that does not parse is null, and null explodes to nothing
    elements = F.explode(F.try_parse_json(as_array).cast("array<variant>"))
    return df.select(*kept, elements.alias(out)).where(F.schema_of_variant(out).startswith("OBJECT"))
