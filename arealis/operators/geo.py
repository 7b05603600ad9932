"""Spatial filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from arealis.functions.geo import inside_polygon


def points_within(df: DataFrame, lon: str, lat: str, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """Rows whose point lies inside the polygon, given by its corners."""
    return df.where(inside_polygon(lon, lat, polygon))
