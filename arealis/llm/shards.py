"""Global shuffle into shards by two passes over stored data.

Pass one scatters the records into buckets that fit in memory, by a seeded hash
of id and text; where records that agree in both are too many for a bucket, by
the whole record and the number of its copy too.  Pass two reads each bucket, shuffles it by Fisher-Yates with a
seed of its own, and writes it.  The buckets one after the other are a random
order of all records, which is cut into shards of equal counts.

A bucket is a partition of its own, so the generator of its shuffle depends on
the seed and the bucket's number alone; it is sorted first, so the result does
not depend on how records arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm.spread import keep

#: bytes of text in a bucket
BUCKET_BYTES = 24 << 20
#: copies of a record that are numbered at once
_COPIES = 65_536


def record_size(text_col: str) -> Column:
    """UTF-8 bytes of the text (none for null), plus 1."""
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("bigint")


def external_shuffle(
    docs: DataFrame,
    *,
    shards: int = 8,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``docs`` with ``bucket``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    The counts of any two shards differ by at most one.  The shuffled records
    are written to the shared folder and read again.  Null texts, null ids and
    repeated ids are records like others, and so are equal records, however
    many; an empty table gives an empty result.  Existing columns of the three
    names are replaced.  Map columns cannot be ordered and are not supported.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    columns = [c for c in docs.columns if c not in ("bucket", "shard", "slot")]
    # pass one: scatter
    record = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    alike = docs.groupBy(record.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(record_size(text_col)).alias("bytes"))
    sizes = alike.agg(F.sum("bytes").alias("bytes"), F.max(F.when(F.col("n") > 1, F.col("bytes"))).alias("most")).first()
    buckets = max(1, -(-(sizes["bytes"] or 0) // bucket_bytes))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("record"), record.alias("order"))
    if (sizes["most"] or 0) > bucket_bytes:
        # equal records are counted, and each copy is scattered by its record and number
        copies = source.groupBy("record", "order").agg(F.count(F.lit(1)).alias("n"))
        block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {_COPIES}")))
        copies = copies.withColumn("block", block)
        inner = F.sequence(F.col("block") * _COPIES, F.least(F.col("n"), (F.col("block") + 1) * _COPIES) - 1)
        source = copies.withColumn("copy", F.explode(inner)).select("record", F.xxhash64("order", "record", "copy").alias("order"))
    bucket = F.pmod("order", F.lit(buckets)).cast("int")
    scattered = source.select(bucket.alias("bucket"), "order", "record")
    scattered = scattered.repartitionById(buckets, F.col("bucket"))
    # pass two: Fisher-Yates inside each bucket
    gathered = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("order", "record"))).alias("records"))
    shuffled = keep(
        gathered.select("bucket", F.posexplode(F.shuffle("records", seed)).alias("place", "r")).select(
            "bucket", "place", "r.record"
        ),
        "shuffled",
    )
    # the buckets in their order, cut into equal shards
    counts = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    at = F.col("start") + F.col("place")
    placed = shuffled.join(starts, "bucket").withColumn("at", at)
    # shard k holds the places from ceil(k * total / shards) on
    shard = F.expr(f"(at * {shards}) div total")
    first = F.expr(f"(((at * {shards}) div total) * total + {shards - 1}) div {shards}")
    return placed.select(
        *[F.col("record")[c].alias(c) for c in columns],
        "bucket",
        shard.cast("int").alias("shard"),
        (F.col("at") - first).cast("bigint").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Shuffle ``docs`` and write ``path/shard=k``, the records of each shard in the order of their slots."""
    placed = external_shuffle(docs, **options)
    placed.repartition("shard", "bucket").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: its id, size, text_crc32, law, shard, slot and grown_shard."""
    placed = external_shuffle(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options)
    return placed.select(
        id_col,
        record_size(text_col).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
