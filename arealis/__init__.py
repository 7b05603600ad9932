"""Regional analytics on Spark: DataFrame operators for keyed, dated data."""

__version__ = "0.1.0"
