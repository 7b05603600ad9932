"""Point in polygon."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def inside_polygon(lon: str, lat: str, polygon: Sequence[tuple[float, float]]) -> Column:
    """True where the point lies inside the polygon, by the even-odd rule.

    The bounding box comes first, as plain comparisons that reach the files.
    """
    ring = [(float(x), float(y)) for x, y in polygon]
    if ring and ring[0] == ring[-1]:
        ring = ring[:-1]
    if len(ring) < 3:
        raise ValueError("a polygon needs at least three distinct corners")
    x, y = F.col(lon), F.col(lat)
    crossings = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        straddles = (F.lit(y1) > y) != (F.lit(y2) > y)
        to_the_right = x < F.lit((x2 - x1) / (y2 - y1)) * (y - F.lit(y1)) + F.lit(x1)
        crossings.append((straddles & to_the_right).cast("int"))
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    odd = F.pmod(reduce(lambda a, b: a + b, crossings), F.lit(2)) == 1
    return box & odd
