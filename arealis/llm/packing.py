"""Hierarchical multi-length packing of token ids into sequences.

Every document becomes its token ids and one end id.  What is longer than the
longest window gives full windows; the rest goes to the tier with the smallest
window that holds it.  The tiers are packed from the longest down, each into
windows of its own length: a window takes the longest rest of its tier, and its
gap is filled from shorter tiers (the longest rest that fits whole; where none
does, one is cut), so windows close full and a tier's documents are read in
that tier's context.  What is left of the last window closes in exact shorter
windows.  Sequences then go to step groups of equal token counts, the costliest
to the lightest group.

A task packs what it reads, a few million tokens at a time, and nothing is
shuffled: packing quality does not need more, as at most one short rest is
padded each time.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arealis.llm import tokens
from arealis.llm.spread import text_of

WINDOWS = (64, 128, 256, 512, 1024, 2048)
#: tokens packed together
POOL_TOKENS = 4_000_000
#: sequences of the longest window that make up one step
STEP_WINDOWS = 8
END_ID = 1


# ---------------------------------------------------------------- token ids


class Encoder:
    """Token ids of many texts; every distinct stretch between white space is tokenised once.

    A byte-level vocabulary never joins a character to white space before it,
    so a text may be cut before each ASCII white space character that follows
    something else, and the ids are those of the whole.  The texts of added
    tokens are not cut.  With ``special`` the special ones among them get their
    own ids, as from the tokenizer as loaded; else they are text like any other.
    """

    CACHE = 1_000_000

    def __init__(self, path: str, *, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if not special:
            self.tokenizer.encode_special_tokens = True
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        #: text, and whether the token also depends on what is beside it
        self.added = [(t.content.encode(), t.single_word or t.lstrip or t.rstrip) for t in added]
        self._forget()

    def _forget(self) -> None:
        """Start anew: ``known`` numbers the stretches, ``first`` says where the ids of each start in ``flat``."""
        self.known: dict[bytes, int] = {}
        self.flat, self.first = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _lookup(self, stretches: list[bytes]) -> np.ndarray:
        """The numbers of the given distinct stretches; unknown ones are tokenised and added."""
        if len(self.known) > self.CACHE:
            self._forget()
        new = [s for s in stretches if s not in self.known]
        if new:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([s.decode() for s in new], add_special_tokens=False)]
            n = len(self.known)
            self.known.update(zip(new, range(n, n + len(new))))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.first = np.append(self.first, self.first[-1] + np.cumsum(sizes))
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), np.uint32, sizes.sum()))
        return np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the n + 1 offsets."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[_cuts(data)] = True
        raw = data.tobytes() if self.added else b""
        for text, beside in self.added:
            at = raw.find(text)
            while at >= 0:
                begins[at + (not beside) : at + len(text) + beside] = False
                at = raw.find(text, at + 1)
        begins[offsets] = True
        starts = np.flatnonzero(begins[:-1])
        bounds = np.append(starts, len(data)).astype(np.int64)
        stretches = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        which = self._lookup(stretches.dictionary.to_pylist())[stretches.indices.to_numpy()]
        first = self.first[which]
        total = np.concatenate([[0], np.cumsum(self.first[which + 1] - first)])
        n = np.diff(total)
        at = np.repeat(first - total[:-1], n) + np.arange(total[-1])
        return self.flat[at], total[np.searchsorted(starts, offsets)]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process, so that a stretch is tokenised once by each."""
    return Encoder(path, special=True)


_WORD = ~tokens.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_PUNCTUATION = ~tokens.byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places of ASCII white space after a byte that is surely no end of a white space character."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    at = np.flatnonzero(space[1:]) + 1
    before, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    ascii_word = (before > 0x20) & (before < 0x7F)
    # Unicode white space is C2 xx, or E1, E2 or E3 and two more bytes
    other_word = (before >= 0x80) & (second != 0xC2) & ~((third >= 0xE1) & (third <= 0xE3) & (second >= 0x80))
    # a run of letters or digits also ends before ASCII punctuation, but an apostrophe may start a contraction
    ends = np.flatnonzero(_WORD[data[:-1]] & _PUNCTUATION[data[1:]]) + 1
    return np.concatenate([at[ascii_word | other_word], ends])


# ---------------------------------------------------------------- packing one pool


class Packer:
    """Packs documents, given by their lengths, into sequences; pieces are (document, start, length, sequence, offset)."""

    def __init__(self, windows: tuple[int, ...]):
        if sorted(set(windows)) != list(windows) or any(w & (w - 1) for w in windows):
            raise ValueError("windows must be rising powers of two")
        self.windows = windows

    def pack(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces as rows of five numbers, and the length to which each sequence is padded."""
        longest = self.windows[-1]
        pieces: list[tuple[int, int, int, int, int]] = []
        padded: list[int] = []
        tiers: list[list[tuple[int, int, int]]] = [[] for _ in self.windows]  # (length, document, start), rising
        for doc, n in enumerate(lengths.tolist()):
            full = n // longest
            for k in range(full):
                pieces.append((doc, k * longest, longest, len(padded), 0))
                padded.append(longest)
            if rest := n - full * longest:
                tiers[bisect_left(self.windows, rest)].append((rest, doc, full * longest))
        for tier in tiers:
            tier.sort()
        for top in reversed(range(len(tiers))):
            while tiers[top]:
                self._fill(tiers, top, self.windows[top], pieces, padded)
        return np.array(pieces, np.int64).reshape(-1, 5), np.array(padded, np.int64)

    def _fill(self, tiers, top, window, pieces, padded) -> None:
        """Close one sequence that starts with the longest rest of the tier ``top``; longer tiers are packed."""
        taken: list[tuple[int, int, int]] = [tiers[top].pop()]
        gap = window - taken[0][0]
        while gap:
            rest = self._take(tiers, gap)
            if rest is None:
                break
            taken.append(rest)
            gap -= rest[0]
        if gap:  # nothing left at all: close in exact windows, the last one padded
            self._close(taken, pieces, padded)
            return
        self._emit(taken, window, pieces, padded)

    def _take(self, tiers, gap):
        """The longest rest that fits in the gap, or else a piece of the shortest that does not."""
        for tier in reversed(tiers):
            if tier and tier[0][0] <= gap:
                return tier.pop(bisect_right(tier, (gap, float("inf"), 0)) - 1)
        for tier in tiers:
            if tier:
                n, doc, start = tier.pop(0)
                insort(tiers[bisect_left(self.windows, n - gap)], (n - gap, doc, start + gap))
                return gap, doc, start
        return None

    def _close(self, taken, pieces, padded) -> None:
        total, queue = sum(x[0] for x in taken), list(taken)
        for window in reversed(self.windows):
            while total >= window:
                part, need = [], window
                while need:
                    n, doc, start = queue.pop(0)
                    use = min(n, need)
                    part.append((use, doc, start))
                    if n > use:
                        queue.insert(0, (n - use, doc, start + use))
                    need -= use
                self._emit(part, window, pieces, padded)
                total -= window
        if queue:
            self._emit(queue, total if total & (total - 1) == 0 else self.windows[-1], pieces, padded)

    @staticmethod
    def _emit(taken, window, pieces, padded) -> None:
        offset = 0
        for n, doc, start in taken:
            pieces.append((doc, start, n, len(padded), offset))
            offset += n
        padded.append(window)


def step_groups(cost: np.ndarray, padded: np.ndarray, step_tokens: int) -> np.ndarray:
    """A step for each sequence: about equal tokens in each, and the costs spread evenly.

    Sequences of one window size are dealt from the costliest on, each to the
    step with the fewest tokens and then the least cost so far.
    """
    steps = max(1, round(int(padded.sum()) / step_tokens))
    load = [(0, 0.0, s) for s in range(steps)]
    out = np.zeros(len(padded), np.int64)
    for i in np.lexsort((-cost, -padded)).tolist():
        n, c, s = heapq.heappop(load)
        out[i] = s
        heapq.heappush(load, (n + int(padded[i]), c + float(cost[i]), s))
    return out


# ---------------------------------------------------------------- over a table


def _pack_stream(path: str, windows: tuple[int, ...], pool_tokens: int, schema: pa.Schema, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path).encode, Packer(windows)
        task, pools = TaskContext.get().partitionId(), 0
        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal waiting, held, pools
            ids = np.concatenate([w[1] for w in waiting])
            lengths = np.concatenate([w[2] for w in waiting])
            docs = pa.chunked_array([w[0] for w in waiting]).combine_chunks()
            first = np.cumsum(lengths) - lengths
            pieces, padded = packer.pack(lengths)
            doc, start, length, sequence, offset = pieces.T
            cost = np.bincount(sequence, length.astype(np.float64) ** 2, len(padded))
            steps = step_groups(cost, padded, STEP_WINDOWS * windows[-1])
            base = (task << 40) + (pools << 20)
            raw = [ids[first[d] + s : first[d] + s + n].astype("<u4").tobytes() for d, s, n in zip(doc, start, length)]
            columns = [
                docs.take(pa.array(doc)), start, length, [zlib.crc32(x) for x in raw], lengths[doc], base + sequence,
                offset, padded[sequence], base + steps[sequence],
            ]
            if with_ids:
                columns.append([np.frombuffer(x, "<u4").astype(np.int32) for x in raw])
            waiting, held, pools = [], 0, pools + 1
            return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], schema=schema)

        for batch in batches:
            data, offsets = tokens.flatten(batch.column(1))
            for a, b in tokens.slices(offsets):
                at = offsets[a : b + 1]
                ids, bounds = encode(data[at[0] : at[-1]], at - at[0])
                lengths = np.diff(bounds) + 1
                ends = np.cumsum(lengths) - 1
                line = np.full(len(ids) + b - a, END_ID, np.uint32)
                body = np.ones(len(line), bool)
                body[ends] = False
                line[body] = ids
                waiting.append((batch.column(0).slice(a, b - a), line, lengths))
                held += len(line)
                if held >= pool_tokens:
                    yield close()
        if waiting:
            yield close()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    windows: tuple[int, ...] = WINDOWS,
    pool_tokens: int = POOL_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document in a sequence.

    ``doc_id`` (under the name of ``id_col``), ``start``, ``length``,
    ``ids_crc32`` (of the ids as little-endian 32-bit numbers), ``doc_tokens``,
    ``sequence_id``, ``offset``, ``padded`` (the sequence's length with
    padding: one of ``windows``, or a power of two below them), ``step_group``
    and, if asked for, ``ids``.

    ``tokenizer`` is the path of a byte-level vocabulary on every machine; ids
    are those it gives as loaded, without special tokens around a text.  A
    null or empty text is one token, the end.  Every row is a document of its
    own, also those that repeat an id or have none; an empty table gives an
    empty result.
    """
    source = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    names = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded", pa.int64()), ("step_group", pa.int64())]
    schema = pa.schema([(id_col, to_arrow_type(docs.schema[id_col].dataType)), *names])
    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n, _ in names)
    if with_ids:
        schema, ddl = schema.append(pa.field("ids", pa.list_(pa.int32()))), ddl + ", ids array<int>"
    return source.mapInArrow(_pack_stream(tokenizer, windows, pool_tokens, schema, with_ids), ddl)
