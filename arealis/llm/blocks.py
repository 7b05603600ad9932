"""Exact duplicates by deterministic block naming.

A text is cut into blocks of ``block_bytes`` bytes.  The distinct blocks are
sorted and each gets an integer name; then adjacent names are paired, the
distinct pairs sorted and named, and so on, until every document is one name.
Two documents have the same name at the same level exactly when their texts
are equal: names come from comparing contents, never from a hash alone.

Everything is DataFrame operations.  Only distinct blocks are shuffled with
their text, after a partial distinct in each task, so a text with very many
copies travels once per task; all later rows hold integers.  A hash sends
blocks to ranges that are sorted on their own, and a name is the range's number
and the position in it.  Blocks of different content with equal hash (looked
for each time) are told apart by their content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm.spread import drop, keep, shuffle_partitions

BLOCK_BYTES = 4096
_POSITION_BITS = 40


def _sorted_names(distinct: DataFrame, by: list[str], ranges: int) -> DataFrame:
    """Number the distinct rows: the range of their hash, and their place in the sorted range; from 1."""
    where = F.pmod(F.xxhash64(*by), F.lit(ranges))
    ordered = Window.partitionBy("range").orderBy(*by)
    return distinct.withColumn("range", where).select(
        *distinct.columns,
        (F.shiftleft(F.col("range"), _POSITION_BITS) + F.row_number().over(ordered)).alias("name"),
    )


def name_documents(
    docs: DataFrame,
    *,
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """``docs`` without its texts, with ``level`` and ``name``: equal together exactly for equal texts.

    A null text counts as empty; an empty text is one empty block.  Also
    returns ``row_id``, which tells repeated rows apart, and ``text_sha256``.
    Existing columns of these names are replaced.
    """
    ranges = shuffle_partitions(docs.sparkSession)
    own = [c for c in docs.columns if c not in (text_col, "row_id", "level", "name", "text_sha256")]
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    n_blocks = F.greatest(F.ceil(F.octet_length(body) / block_bytes), F.lit(1)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.col("__n") - 1),
        lambda i: F.substring(F.col("__body"), i * block_bytes + 1, F.lit(block_bytes)),
    )
    rows = docs.select(
        F.struct(*own, F.sha2(body, 256).alias("text_sha256")).alias("__own"),
        body.alias("__body"),
        n_blocks.alias("__n"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    cuts = rows.select("__own", "__n", "row_id", F.posexplode(cut).alias("pos", "block"))
    cuts = cuts.withColumn("h", block_hash(F.col("block")).cast("bigint"))

    # level 0: distinct blocks, sorted
    distinct = cuts.groupBy("h", "block").agg(F.lit(1).alias("one"))
    hashes = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("variants"))
    numbered = hashes.select("h", F.explode(F.sequence(F.lit(1), F.col("variants").cast("int"))).alias("variant"))
    names = keep(_sorted_names(numbered, ["h", "variant"], ranges), "names")
    clashing = names.where("variant > 1").select("h").distinct()
    if clashing.limit(1).count():
        ordered = Window.partitionBy("h").orderBy("block")
        variants = distinct.join(clashing, "h", "left_semi").select("h", "block", F.row_number().over(ordered).alias("variant"))
        cuts = cuts.join(variants, ["h", "block"], "left").withColumn("variant", F.coalesce("variant", F.lit(1)))
    else:
        cuts = cuts.withColumn("variant", F.lit(1))
    # row ids are fixed from here on
    light = keep(cuts.select("__own", "__n", "row_id", "pos", "h", "variant"), "blocks")
    documents = light.where("pos = 0").select("__own", "row_id")
    named = light.join(names, ["h", "variant"]).select("row_id", "__n", "pos", "name")
    current = keep(named.where("__n > 1"), "level")
    done = named.where("__n = 1").select("row_id", F.lit(0).alias("level"), "name")

    # pair adjacent names until one is left; an unpaired last one is followed by 0
    level = 0
    while current.limit(1).count():
        level += 1
        pairs = current.groupBy("row_id", "__n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("right"),
        )
        pairs = keep(pairs.withColumn("__n", F.ceil(F.col("__n") / 2).cast("int")), "pairs")
        names_of = _sorted_names(pairs.select("left", "right").distinct(), ["left", "right"], ranges)
        named = keep(pairs.join(names_of, ["left", "right"]).select("row_id", "__n", "pos", "name"), "level")
        drop(pairs, current)
        done = done.union(named.where("__n = 1").select("row_id", F.lit(level).alias("level"), "name"))
        current = keep(named.where("__n > 1"), "level")
    return documents.join(done, "row_id").select("__own.*", "row_id", "level", "name")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and ``row_id``.

    Of equal texts the row with the largest id stays; null ids come last, and
    of repeated rows exactly one stays.  ``keep_id`` is the id of that row.
    """
    named = keep(name_documents(docs.select(id_col, text_col), text_col=text_col, **options), "named")
    best = named.groupBy("level", "name").agg(
        F.max(F.struct(F.col(id_col).alias("keep_id"), F.col("row_id").alias("keep_row"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    return named.join(best, ["level", "name"]).select(
        id_col,
        F.col("best.keep_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.keep_row")).alias("kept"),
        "text_sha256",
        "row_id",
    )


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row for each distinct text, that with the largest id."""
    found = keep(exact_duplicates(docs, id_col=id_col, text_col=text_col, **options), "copies")
    own = F.col(id_col).eqNullSafe(F.col("keep_id"))
    losers = found.where(~F.col("kept") & ~own).select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    marked = docs.withColumn("__text_sha", sha)
    same = (marked["__text_sha"] == losers["__sha"]) & marked[id_col].eqNullSafe(losers["__id"])
    left = marked.join(losers, same, "left_anti")
    if found.where(~F.col("kept") & own).limit(1).count():  # rows that repeat id and text
        left = left.dropDuplicates([id_col, "__text_sha"])
    return left.select(docs.columns)
