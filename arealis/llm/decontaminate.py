"""Benchmark decontamination: training token windows against a broadcast hash set of test n-grams.

The benchmark's windows are hashed and sent to every task as one sorted array,
at most ``max_windows`` of them at a time (a larger benchmark is scanned in
several such blocks, each over all documents).  Every window of a document
whose hash is in the set is then compared word by word, so a hash collision
cannot mark clean text.

Null and empty texts have no words and are never hit.  A benchmark row without
words gives no window; the windows of a row with a null id still mark text, but
name no item.  Repeated rows count once per id.  Documents with equal ids are
treated row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from arealis.llm import tokens

#: one block of benchmark windows: about 100 MB with the words that verify it
MAX_WINDOWS = 500_000


def _item_windows(size: int):
    """Rows of ``item``, ``length`` (words in the window) and ``window`` (its words, one space between)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, lengths, found = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, offsets = tokens.flatten(pa.array([text], pa.string()))
                data = tokens.LOWER[data]
                starts, ends, _ = tokens.find_words(data, offsets, tokens.ALPHANUMERIC)
                words = [data[s:e].tobytes() for s, e in zip(starts, ends)]
                n = min(size, len(words))
                for i in range(len(words) - n + 1 if n else 0):
                    items.append(item)
                    lengths.append(n)
                    found.append(b" ".join(words[i : i + n]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(lengths, pa.int32()), pa.array(found, pa.binary())],
                names=["item", "length", "window"],
            )

    return run


class WindowSet:
    """The benchmark windows of one block: per length a sorted hash array and, per hash, the exact windows."""

    def __init__(self, rows: list[tuple[int, bytes, list[str]]]):
        self.exact: dict[tuple[int, int], list[tuple[bytes, list[str]]]] = {}
        by_length: dict[int, list[bytes]] = {}
        items = {(length, window): names for length, window, names in rows}
        for length, window, _ in rows:
            by_length.setdefault(length, []).append(window)
        self.hashes = {}
        for length, windows in by_length.items():
            joined = np.frombuffer(b" ".join(windows), np.uint8)
            starts, ends, _ = tokens.find_words(joined, np.array([0, len(joined)]), tokens.ALPHANUMERIC)
            hashes = tokens.hash_grams(tokens.hash_words(joined, starts, ends), length)[::length]
            for window, h in zip(windows, hashes.tolist()):
                self.exact.setdefault((length, h), []).append((window, items[length, window]))
            self.hashes[length] = np.unique(hashes)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
        """Yields (text, first word, length, items) of every verified occurrence."""
        words = tokens.hash_words(data, starts, ends)
        for length, known in self.hashes.items():
            grams = tokens.hash_grams(words, length)
            place = np.searchsorted(known, grams)
            place[place == len(known)] = 0
            for i in np.flatnonzero(known[place] == grams).tolist():
                text = int(np.searchsorted(bounds, i, side="right")) - 1
                if i + length > bounds[text + 1]:
                    continue  # runs over into the next text
                seen = b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(i, i + length))
                for window, items in self.exact[length, int(grams[i])]:
                    if window == seen:
                        yield text, i - int(bounds[text]), length, items


def _scan(broadcast):
    """Per text: its words, the hit words as (first, last) ranges with byte places, and the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = broadcast.value
        for batch in batches:
            data, offsets = tokens.flatten(batch.column(1))
            for a, b in tokens.slices(offsets):
                part = tokens.LOWER[data[offsets[a] : offsets[b]]]
                at = offsets[a : b + 1] - offsets[a]
                starts, ends, bounds = tokens.find_words(part, at, tokens.ALPHANUMERIC)
                hit = np.zeros(len(starts) + 1, np.int32)
                items: dict[int, set[str]] = {}
                for text, first, length, names in windows.find(part, starts, ends, bounds):
                    hit[bounds[text] + first] += 1
                    hit[bounds[text] + first + length] -= 1
                    items.setdefault(text, set()).update(x for x in names if x is not None)
                covered = np.cumsum(hit[:-1]) > 0
                spans: list[list[dict]] = []
                for text in range(b - a):
                    lo, hi = bounds[text], bounds[text + 1]
                    if text not in items:
                        spans.append([])
                        continue
                    edge = np.diff(np.concatenate([[0], covered[lo:hi].astype(np.int8), [0]]))
                    firsts, lasts = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
                    spans.append([
                        {"first_word": int(f), "last_word": int(g), "start": int(starts[lo + f] - at[text]), "end": int(ends[lo + g] - at[text])}
                        for f, g in zip(firsts, lasts)
                    ])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(spans, pa.list_(_SPAN)),
                        pa.array([sorted(items.get(x, ())) for x in range(b - a)], pa.list_(pa.string())),
                    ],
                    names=["row", "text", "n_words", "spans", "items"],
                )

    return run


_SPAN = pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start", "end")])
_SPAN_TYPE = ArrayType(StructType([StructField(n, LongType()) for n in ("first_word", "last_word", "start", "end")]))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """The documents with ``leak``: n_words, ``spans`` of hit words (with byte places) and the ``items`` found there.

    An existing column ``leak`` is replaced.
    """
    spark = docs.sparkSession
    windows = (
        benchmark.select(F.col(item_id).cast("string"), F.col(item_text).cast("string"))
        .mapInArrow(_item_windows(window), "item string, length int, window binary")
        .groupBy("length", "window")
        .agg(F.collect_set("item").alias("items"))
    )
    blocks = -(-windows.count() // max_windows) or 1
    keep_cols = [c for c in docs.columns if c != "leak"]
    row = F.struct(*[F.col(f"`{c}`") for c in keep_cols])
    if blocks > 1:
        windows = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    source = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([*source.schema.fields, StructField("n_words", LongType()), StructField("spans", _SPAN_TYPE), StructField("items", ArrayType(StringType()))])
    for block in range(blocks):
        part = windows.where(F.col("block") == block) if blocks > 1 else windows
        rows = [(r["length"], bytes(r["window"]), r["items"] or [None]) for r in part.toLocalIterator()]
        shared = spark.sparkContext.broadcast(WindowSet(rows))
        found = source.mapInArrow(_scan(shared), schema)
        leak = F.struct("n_words", "spans", "items")
        if block:  # join what the earlier blocks found in the same row
            old = F.col("row.leak")
            leak = F.struct(
                F.col("n_words"),
                _merged(F.concat(old["spans"], F.col("spans"))).alias("spans"),
                F.array_sort(F.array_union(old["items"], F.col("items"))).alias("items"),
            )
        source = found.select(
            F.struct(*[F.col("row")[c].alias(c) for c in keep_cols], leak.alias("leak")).alias("row"), "text"
        )
        schema = StructType([*source.schema.fields, *schema.fields[2:]])
    return source.select(*[F.col("row")[c].alias(c) for c in [*keep_cols, "leak"]])


def _merged(spans):
    """Overlapping and touching spans as one, in order."""

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first_word"].alias("first_word"),
            F.greatest(last["last_word"], span["last_word"]).alias("last_word"),
            last["start"].alias("start"),
            F.greatest(last["end"], span["end"]).alias("end"),
        )
        extends = (F.size(done) > 0) & (span["first_word"] <= F.try_element_at(done, F.lit(-1))["last_word"] + 1)
        return F.when(extends, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(span))
        )

    empty = F.array().cast(_SPAN_TYPE)
    return F.aggregate(F.array_sort(spans), empty, add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text_col: str = "text", **options):
    """``docs`` without leaked test text: without the documents hit, or without the hit spans in their texts.

    ``remove="spans"`` cuts the bytes from the first to the last word of each
    span; the rest of the text is unchanged.
    """
    found = find_leaks(docs, benchmark, text_col=text_col, **options)
    if remove == "documents":
        return found.where(F.size("leak.spans") == 0).select(docs.columns)
    if remove != "spans":
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    body = F.encode(F.col(text_col), "utf-8")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.col("leak.spans.end"))
    ends = F.concat(F.col("leak.spans.start"), F.array(F.octet_length(F.col(text_col)).cast("bigint")))
    pieces = F.zip_with(
        starts, ends, lambda s, e: F.decode(F.substring(body, (s + 1).cast("int"), (e - s).cast("int")), "utf-8")
    )
    cleaned = F.when(F.size("leak.spans") > 0, F.concat_ws("", pieces)).otherwise(F.col(text_col))
    return found.withColumn(text_col, cleaned).select(docs.columns)


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_leaks(docs, benchmark, **options)
    n_hit = F.aggregate("leak.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return found.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("leak.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("leak.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("leak.spans") > 0).alias("contaminated"),
    )

