"""Row-by-row delivery of a result to a consumer on the driver."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from arealis.sources.json_rows import to_json_rows


def stream_json(df: DataFrame, *, drop_nulls: bool = True, prefetch: bool = False) -> Iterator[str]:
    """JSON documents of a result, in partition order.

    The driver holds one partition at a time, never the whole result.  For
    results of any size, write them with ``write_json_rows`` instead.
    """
    for row in to_json_rows(df, drop_nulls=drop_nulls).toLocalIterator(prefetchPartitions=prefetch):
        yield row[0]
