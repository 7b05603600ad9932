"""Removing repeated passages: anchors at the positions of a difference cover.

A difference cover D modulo a period P holds, for every shift, two of its
members that differ by it.  So wherever the same passage starts in two texts,
within P words both have a position in D at the same place of the passage.
Hashing only the short windows (*anchors*) at these positions is therefore
enough: every common passage of a full window's length shares an aligned
anchor, and 6 of 31 positions are hashed.

1. Texts are packed into chunks of a few megabytes and stored in the shared
   folder.  Texts with the same words are one class, of which a chunk states
   its smallest and largest id once; only texts with the smallest id of all
   go on, the others repeat in full.
2. Every chunk sends each of its anchors once; those that meet another one
   return to their chunks.
3. Shared anchors are extended: the full windows around them are compared, by
   128 bits, for the smallest id that holds them.
4. Windows with a smaller id elsewhere return to their chunks, where the words
   they cover are removed.

A passage, or a whole text, that very many texts share is one row per chunk,
not one per text, and no pairs are ever formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arealis.llm import tokens
from arealis.llm.spread import drop, keep, pack_sorted, text_of, unpack_sorted

WINDOW = 50
CHUNK_BYTES = 4 << 20
#: period -> positions; every difference modulo the period occurs among them (perfect difference sets)
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so they have inverses modulo 2**64
_SECOND = np.uint64(0x5851F42D4C957F2D)

COPY, ANCHOR, REPEAT = 0, 1, 2


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least two fifths of the window, and its positions; 1 for short windows."""
    period = max((p for p in COVERS if 5 * (window - p + 1) >= 2 * window), default=1)
    return period, COVERS.get(period, (0,))


def _sums(words: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial, and the powers of the inverse base, which move a window to its origin."""
    powers = np.full(len(words) + 1, np.uint64(base))
    powers[0] = 1
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * np.cumprod(powers)[:-1], out=sums[1:])
    powers[1:] = np.uint64(pow(base, -1, 1 << 64))
    return sums, np.cumprod(powers)


class _Chunk:
    """The words of a chunk's texts, and the order of their ids."""

    def __init__(self, row: dict, id_type: pa.DataType):
        self.ids = pa.array(row["ids"], id_type)
        body = zstandard.ZstdDecompressor().decompress(row["texts"]) if row["texts"] else b""
        self.offsets = unpack_sorted(row["offsets"]).astype(np.int64)
        self.body = body
        data = np.frombuffer(body, np.uint8)
        starts, ends, self.bounds = tokens.find_words(data, self.offsets, tokens.SPACED)
        self.words = tokens.hash_words(data, starts, ends)
        self.sizes = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def text(self, i: int) -> bytes:
        return self.body[self.offsets[i] : self.offsets[i + 1]]

    def streams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield _sums(self.words, _BASES[0])
        yield _sums(tokens.mix(self.words ^ _SECOND), _BASES[1])

    def digests(self) -> list[np.ndarray]:
        """Two 64-bit numbers for the words of each text."""
        return [tokens.mix((sums[self.bounds[1:]] - sums[self.bounds[:-1]]) * shift[self.bounds[:-1]]) for sums, shift in self.streams()]

    def windows(self, at: np.ndarray, size: int) -> list[np.ndarray]:
        """Two 64-bit numbers for the ``size`` words from each position on."""
        return [tokens.mix((sums[at + size] - sums[at]) * shift[at]) for sums, shift in self.streams()]

    def extremes(self, first: np.ndarray, second: np.ndarray, doc: np.ndarray) -> tuple:
        """The distinct pairs of numbers, and for each the smallest and the largest id among the texts ``doc`` they are from."""
        ranks = _ranks(self.ids)
        order, starts = _runs(first, second)
        rank = ranks[doc][order]
        of_rank = np.zeros(ranks.max(initial=0) + 1, np.int64)
        of_rank[ranks[ranks >= 0]] = np.flatnonzero(ranks >= 0)
        least, most = np.minimum.reduceat(rank, starts), np.maximum.reduceat(rank, starts)
        ids = [self.ids.take(pa.array(of_rank[r])) for r in (least, most)]
        return first[order][starts].view(np.int64), second[order][starts].view(np.int64), *ids

    def classes(self, window: int) -> tuple:
        """The texts of a full window and more, by their words: :meth:`extremes` of their digests."""
        first, second = self.digests()
        at = np.flatnonzero((self.sizes >= window) & (_ranks(self.ids) >= 0))
        return self.extremes(first[at], second[at], at) if len(at) else ((), (), (), ())

    def copies(self, answers: pa.Table, window: int) -> np.ndarray:
        """Which texts repeat one with a smaller id in full; ``answers`` has those classes and their smallest ids."""
        out = np.zeros(len(self.sizes), bool)
        if len(answers):
            hit = self._above(answers, self.digests(), np.arange(len(out)))
            out[hit & (self.sizes >= window)] = True
        return out

    def repeats(self, answers: pa.Table, window: int) -> np.ndarray:
        """Where windows start that a text with a smaller id holds; ``answers`` has those windows and their smallest ids."""
        at = np.arange(max(len(self.words) - window + 1, 0))
        at = at[at + window <= self.bounds[self.doc[at] + 1]]
        return at[self._above(answers, self.windows(at, window), self.doc[at])] if len(answers) else at[:0]

    def _above(self, answers: pa.Table, mine: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
        first, second = (answers[name].to_numpy().view(np.uint64) for name in ("value", "second"))
        order = np.argsort(first)
        ranks = _ranks(pa.concat_arrays([self.ids, answers["low"].combine_chunks().cast(self.ids.type)]))
        least, ranks = ranks[len(self.ids) :], ranks[: len(self.ids)]
        found = order[np.minimum(np.searchsorted(first, mine[0], sorter=order), len(order) - 1)]
        return (first[found] == mine[0]) & (second[found] == mine[1]) & (least[found] < ranks[doc])

    def anchors(self, skipped: np.ndarray, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors of all texts that hold a full window and are not skipped."""
        usable = (self.sizes >= window) & ~skipped
        length = window - period + 1
        member = np.zeros(period, bool)
        member[list(cover)] = True
        place = np.arange(len(self.words)) - self.bounds[:-1][self.doc]
        at = np.flatnonzero(usable[self.doc] & member[place % period] & (place + length <= self.sizes[self.doc]))
        sums, shift = _sums(self.words, _BASES[0])
        return at, tokens.mix((sums[at + length] - sums[at]) * shift[at])


def _ranks(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, equal for equal ones; -1 for a null."""
    ranks = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    ranks[np.asarray(ids.is_null())] = -1
    return ranks


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each run starts."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(new)


def _to_chunks(id_type: pa.DataType, size: int, window: int):
    classes = [("first", pa.int64()), ("second", pa.int64()), ("low", id_type), ("high", id_type)]
    schema = pa.schema(
        [("chunk", pa.int64()), ("ids", pa.list_(id_type)), ("offsets", pa.binary()), ("texts", pa.binary())]
        + [(name, pa.list_(kind)) for name, kind in classes]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = 0, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, ids, texts, held
            row = {
                "chunk": (TaskContext.get().partitionId() << 24) + number,
                "ids": ids,
                "offsets": pack_sorted(np.cumsum([0, *map(len, texts)]).astype(np.uint64)),
                "texts": zstandard.ZstdCompressor(level=3).compress(b"".join(texts)),
            }
            found = _Chunk(row, id_type).classes(window)
            number, ids, texts, held = number + 1, [], [], 0
            lists = {name: pa.array(v, kind).to_pylist() for (name, kind), v in zip(classes, found)}
            return pa.RecordBatch.from_pylist([row | lists], schema)

        for batch in batches:
            bodies = batch.column(1).cast(pa.binary())
            for i, name in enumerate(batch.column(0).to_pylist()):
                ids.append(name)
                texts.append(bodies[i].as_py())
                held += len(texts[-1])
                if held >= size:
                    yield close()
        if ids:
            yield close()

    return run


def _of(answers: pa.Table, kind: int) -> pa.Table:
    return answers.filter(pc.equal(answers["kind"], kind))


def _send_anchors(window: int, period: int, cover: tuple[int, ...], id_type: pa.DataType):
    schema = pa.schema([("anchor", pa.int64()), ("tag", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            chunk = _Chunk(row, id_type)
            at, hashes = chunk.anchors(chunk.copies(right, window), window, period, cover)
            if not len(at):
                continue
            order, starts = _runs(hashes)
            text = chunk.doc[at][order]
            many = np.minimum.reduceat(text, starts) != np.maximum.reduceat(text, starts)
            parts.append(pa.table([hashes[order][starts].view(np.int64), row["chunk"] * 2 + many], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def _send_windows(window: int, period: int, cover: tuple[int, ...], id_type: pa.DataType):
    schema = pa.schema([("first", pa.int64()), ("second", pa.int64()), ("chunk", pa.int64()), ("low", id_type), ("high", id_type)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shared = np.sort(_of(right, ANCHOR)["value"].to_numpy().view(np.uint64))
        parts = []
        for row in left.to_pylist():
            chunk = _Chunk(row, id_type)
            at, hashes = chunk.anchors(chunk.copies(_of(right, COPY), window), window, period, cover)
            at = at[np.isin(hashes, shared)]
            at = at[np.asarray(chunk.ids.is_valid())[chunk.doc[at]]]
            if not len(at):
                continue
            # all full windows whose first period holds a shared anchor
            text = chunk.doc[at]
            low = np.maximum(at - (period - 1), chunk.bounds[text])
            high = np.minimum(at, chunk.bounds[text + 1] - window)
            edges = np.zeros(len(chunk.words) + 1, np.int64)
            np.add.at(edges, low, 1)
            np.add.at(edges, high + 1, -1)
            place = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
            first, second, low, high = chunk.extremes(*chunk.windows(place, window), chunk.doc[place])
            parts.append(pa.table([first, second, np.full(len(first), row["chunk"]), low, high], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def _remove(window: int, id_col: str, id_type: pa.DataType, with_text: bool):
    fields = [(id_col, id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + ([("kept", pa.string())] if with_text else []))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        repeats, copies = _of(right, REPEAT), _of(right, COPY)
        parts = []
        for row in left.to_pylist():
            chunk = _Chunk(row, id_type)
            at = chunk.repeats(repeats, window)
            edges = np.zeros(len(chunk.words) + 1, np.int64)
            edges[at] += 1
            edges[at + window] -= 1
            gone = (np.cumsum(edges[:-1]) > 0) | chunk.copies(copies, window)[chunk.doc]
            removed = np.bincount(chunk.doc[gone], minlength=len(chunk.sizes))
            kept = []
            for i in range(len(chunk.sizes)):
                words = chunk.text(i).split()
                if removed[i]:
                    words = [words[j] for j in np.flatnonzero(~gone[chunk.bounds[i] : chunk.bounds[i + 1]]).tolist()]
                kept.append(b" ".join(words))
            digests = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            columns = [chunk.ids, pa.array(chunk.sizes), pa.array(removed.astype(np.int64)), digests]
            parts.append(pa.table(columns + ([pa.array(kept, pa.binary()).cast(pa.string())] if with_text else []), schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    chunk_bytes: int = CHUNK_BYTES,
    with_text: bool = False,
) -> DataFrame:
    """Remove every word covered by ``window`` words in a row that also start in a text with a smaller id.

    Returns the id, ``n_words``, ``n_removed``, ``kept_sha256`` of the kept
    words joined by single spaces and, with ``with_text``, these as ``kept``.
    Words are what lies between ASCII white space, unchanged.  Windows are
    judged on the input, not on what is left, so the passage stays where its
    smallest id holds it, however often it occurs there.

    Rows with equal ids count as one source: neither loses what the other
    holds.  A row without an id is neither a source nor shortened.  Null and
    empty texts have no words; an empty table gives no rows; other columns
    are not read.  Texts are taken whole, whatever their length.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    period, cover = cover_of(window)
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    id_ddl = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    stored = keep(
        source.mapInArrow(
            _to_chunks(id_type, chunk_bytes, window),
            f"chunk bigint, ids array<{id_ddl}>, offsets binary, texts binary, "
            f"first array<bigint>, second array<bigint>, low array<{id_ddl}>, high array<{id_ddl}>",
        ),
        "chunks",
    )
    chunks = stored.select("chunk", "ids", "offsets", "texts")
    alike = Window.partitionBy("first", "second")

    def repeated(met: DataFrame, kind: int) -> DataFrame:
        """What a smaller id holds too, for the chunks that it concerns."""
        least = met.withColumn("least", F.min("low").over(alike)).where("least < high")
        return least.select("chunk", F.lit(kind).alias("kind"), F.col("first").alias("value"), "second", F.col("least").alias("low"))

    texts = stored.select("chunk", F.explode(F.arrays_zip("first", "second", "low", "high")).alias("e")).select("chunk", "e.*")
    copies = keep(repeated(texts, COPY), "copies")

    anchors = chunks.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInArrow(
        _send_anchors(window, period, cover, id_type), "anchor bigint, tag bigint"
    )
    met = anchors.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where("n > 1 OR tag % 2 = 1")
    number = F.shiftright("tag", 1)
    shared = keep(met.select(number.alias("chunk"), F.lit(ANCHOR).alias("kind"), F.col("anchor").alias("value")), "shared")
    asked = shared.unionByName(copies, allowMissingColumns=True)
    windows = chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(
        _send_windows(window, period, cover, id_type), f"first bigint, second bigint, chunk bigint, low {id_ddl}, high {id_ddl}"
    )
    repeats = keep(repeated(windows, REPEAT), "repeats")
    drop(shared)
    result = f"`{id_col}` {id_ddl}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else "")
    return chunks.groupBy("chunk").cogroup(repeats.union(copies).groupBy("chunk")).applyInArrow(
        _remove(window, id_col, id_type, with_text), result
    )
