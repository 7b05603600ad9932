"""Column helpers used by the operators and directly by callers."""

from arealis.functions.dates import bucket_start, day_bounds, in_intervals, parse_date, typed
from arealis.functions.expressions import int_range, normalize_key, slice_from, window_means
from arealis.functions.geo import inside_polygon
from arealis.functions.predicates import predicate
from arealis.functions.split import row_hash, split_percentile

__all__ = [
    "bucket_start",
    "day_bounds",
    "in_intervals",
    "inside_polygon",
    "int_range",
    "normalize_key",
    "parse_date",
    "predicate",
    "row_hash",
    "slice_from",
    "split_percentile",
    "typed",
    "window_means",
]
