"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results or plans.  Sizes (executors, memory, shuffle
# partitions) belong to the deployment and are left alone.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even if a later aggregation then needs its own shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(app_name: str = "arealis", master: str | None = None, **extra: str) -> SparkSession:
    """Create or reuse a session with the defaults above.

    ``extra`` holds further settings, with ``__`` for the dots:
    ``spark__driver__memory="8g"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    for name, value in extra.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()
