"""Helpers shared by the operators: stored intermediate tables, sizes, packed arrays, id filters."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a local session gets a folder of its own, and a cluster
    an error: a folder of one machine would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='llm-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The plan is cut, no executor has to survive, and the planner knows the
    table's true size.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`keep` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def total_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- arrays as bytes

_LEVEL = 1


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T
    return bytes([raw.itemsize]) + zstandard.ZstdCompressor(level=_LEVEL).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    size = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(f"<u{size}").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as compressed differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest one needs."""
    most = int(values.max()) if len(values) else 0
    return pack(values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)))


# ---------------------------------------------------------------- id filters

FILTER_BITS = 1 << 23


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for the hash of each id: a first sieve of fixed size (1 MB), whatever the number of ids.

    Ids outside may pass, ids inside always do, so an exact join must follow.
    """
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))
    rows = (
        ids.select(place.alias("place"))
        .groupBy(F.floor(F.col("place") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(place, 64) AS int))")).alias("bits"))
        .toPandas()
    )
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return bits


def place_column(column: str) -> Column:
    """Where :func:`id_filter` keeps an id; to be computed by Spark, looked up by :func:`passes`."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS)).cast("int")


def passes(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1
