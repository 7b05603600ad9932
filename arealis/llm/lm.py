"""Language-model scores by deleted interpolation.

The probability of a token mixes the n-gram maximum-likelihood estimates of all
orders and a uniform one.  At each order the weight of the estimate depends on
how often its context was seen, in buckets of powers of two, and the weights
are learned by expectation-maximisation on counts of a held-out part of the
training texts.  Afterwards the counts of that part join the others.

Texts are packed into chunks of a few megabytes.  A chunk asks for each n-gram
it holds once, with its own counts; the requests meet by ranges of the n-gram's
hash, where they are summed, and only the sums go back.  So a frequent n-gram
is one row per chunk, no task holds more than a range or a chunk, and what is
shuffled grows with the corpus.  N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arealis.llm import tokens
from arealis.llm.spread import keep, pack, pack_counts, pack_sorted, text_of, total_bytes, unpack, unpack_sorted

CHUNK_BYTES = 6 << 20
#: bytes of text whose n-grams of one order share a hash range
RANGE_BYTES = 6 << 20
#: 1 of so many training documents is held out to learn the weights
DEV_EVERY = 16
ROUNDS = 12
BUCKETS = 48  # powers of two of a context's count; the last one takes all above

_END = np.uint64(1)
_BEGIN = np.uint64(2)
TEXT, TRAIN, DEV = 0, 1, 2


def _packed(kind: int, number: int, ids: list, roles: np.ndarray, texts: list[bytes]) -> dict:
    offsets = np.cumsum([0, *map(len, texts)]).astype(np.uint64)
    return {
        "chunk": (TaskContext.get().partitionId() << 24) + number,
        "kind": kind,
        "ids": ids,
        "roles": roles.astype(np.uint8).tobytes(),
        "offsets": pack_sorted(offsets),
        "texts": zstandard.ZstdCompressor(level=3).compress(b"".join(texts)),
    }


def _to_chunks(id_type: pa.DataType, size: int):
    schema = pa.schema(
        [("chunk", pa.int64()), ("kind", pa.int32()), ("ids", pa.list_(id_type)), ("roles", pa.binary()), ("offsets", pa.binary()), ("texts", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = {kind: ([], [], []) for kind in (0, 1)}  # ids, roles, texts; held-out training texts apart
        held = {0: 0, 1: 0}
        number = 0

        def close(kind):
            nonlocal number
            ids, roles, texts = open_[kind]
            row = _packed(kind, number, ids, np.array(roles), texts)
            number += 1
            open_[kind], held[kind] = ([], [], []), 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i, role in enumerate(batch.column(1).to_numpy()):
                kind = int(role == DEV)
                ids, roles, bodies = open_[kind]
                ids.append(batch.column(0)[i].as_py())
                roles.append(role)
                bodies.append(texts[i].as_py())
                held[kind] += len(bodies[-1])
                if held[kind] >= size:
                    yield close(kind)
        for kind in (0, 1):
            if open_[kind][0]:
                yield close(kind)

    return run


class _Chunk:
    """The n-grams of one chunk: for each order their hashes, one per token."""

    def __init__(self, row: dict, order: int):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]) if row["texts"] else b"", np.uint8)
        offsets = unpack_sorted(row["offsets"]).astype(np.int64)
        self.roles = np.frombuffer(row["roles"], np.uint8)
        data = tokens.LOWER[data]
        starts, ends, bounds = tokens.find_words(data, offsets, tokens.SPACED)
        hashes = tokens.hash_words(data, starts, ends)
        hashes[hashes <= _BEGIN] += np.uint64(3)
        # every text: order - 1 marks of its beginning, its words, its end
        pad = order - 1
        sizes = np.diff(bounds) + pad + 1
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        line = np.full(self.bounds[-1], _BEGIN, np.uint64)
        text = np.repeat(np.arange(len(sizes)), np.diff(bounds))
        line[np.arange(len(hashes)) - bounds[:-1][text] + self.bounds[:-1][text] + pad] = hashes
        line[self.bounds[1:] - 1] = _END
        is_token = np.ones(len(line), bool)
        for j in range(pad):
            is_token[self.bounds[:-1] + j] = False
        place = np.flatnonzero(is_token)
        self.text = np.repeat(np.arange(len(sizes)), sizes - pad)
        self.first = np.concatenate([[True], self.text[1:] != self.text[:-1]])
        self.grams = [tokens.hash_grams(line, k, salt=k)[place - k + 1] for k in range(1, order + 1)]


def _requests(order: int, ranges: int):
    schema = pa.schema([("range", pa.int32()), ("k", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("grams", pa.binary()), ("kept", pa.binary()), ("dev", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, order)
                role = chunk.roles[chunk.text]
                for k, grams in enumerate(chunk.grams, 1):
                    known, place = np.unique(grams, return_inverse=True)
                    kept = np.bincount(place, role == TRAIN, len(known)).astype(np.uint64)
                    dev = np.bincount(place, role == DEV, len(known)).astype(np.uint64)
                    cuts = np.searchsorted(known, _range_starts(ranges))
                    out = []
                    for r, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(known)])):
                        if b > a:
                            out.append({
                                "range": r * order + k - 1, "k": k, "chunk": row["chunk"], "kind": row["kind"],
                                "grams": pack_sorted(known[a:b]), "kept": pack_counts(kept[a:b]), "dev": pack_counts(dev[a:b]),
                            })
                    yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _range_starts(ranges: int) -> np.ndarray:
    return np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)


_ANSWER = "range int, k int, chunk bigint, kind int, kept binary, dev binary, distinct_kept bigint, distinct_all bigint, n_kept bigint, n_all bigint"


def _answers(table: pa.Table) -> pa.Table:
    """Sum the requests of one range; every chunk gets the sums in the order it asked in."""
    rows = table.to_pylist()
    grams = [unpack_sorted(r["grams"]) for r in rows]
    known, place = np.unique(np.concatenate(grams), return_inverse=True)
    kept = np.bincount(place, np.concatenate([unpack(r["kept"]) for r in rows]), len(known)).astype(np.uint64)
    dev = np.bincount(place, np.concatenate([unpack(r["dev"]) for r in rows]), len(known)).astype(np.uint64)
    out, at = [], 0
    for i, (row, own) in enumerate(zip(rows, grams)):
        mine = place[at : at + len(own)]
        at += len(own)
        both = kept + dev
        first = i == 0  # the sums of the range itself travel once
        out.append({
            "range": row["range"], "k": row["k"], "chunk": row["chunk"], "kind": row["kind"],
            "kept": pack_counts(kept[mine]), "dev": pack_counts(dev[mine]),
            "distinct_kept": int((kept > 0).sum()) * first, "distinct_all": int((both > 0).sum()) * first,
            "n_kept": int(kept.sum()) * first, "n_all": int(both.sum()) * first,
        })
    return pa.Table.from_pylist(out, _ANSWER_ARROW)


_ANSWER_ARROW = pa.schema(
    [("range", pa.int32()), ("k", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("kept", pa.binary()), ("dev", pa.binary())]
    + [(n, pa.int64()) for n in ("distinct_kept", "distinct_all", "n_kept", "n_all")]
)


def _counts(chunk: _Chunk, answers: list[dict], with_dev: bool) -> list[np.ndarray]:
    """For each order the training count of every token's n-gram."""
    out = []
    for k, grams in enumerate(chunk.grams, 1):
        own = sorted((r for r in answers if r["k"] == k), key=lambda r: r["range"])
        sums = np.concatenate([unpack(r["kept"]).astype(np.int64) for r in own])
        if with_dev:
            sums = sums + np.concatenate([unpack(r["dev"]).astype(np.int64) for r in own])
        _, place = np.unique(grams, return_inverse=True)
        out.append(sums[place])
    return out


def _contexts(chunk: _Chunk, counts: list[np.ndarray], n_texts: int, n_tokens: int) -> list[np.ndarray]:
    """For each order the training count of the context: the n-gram one shorter that ends one token earlier."""
    out = [np.full(len(counts[0]), n_tokens)]
    for shorter in counts[:-1]:
        before = np.empty_like(shorter)
        before[1:] = shorter[:-1]
        before[chunk.first] = n_texts
        out.append(before)
    return out


def _bucket(n: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the power of two."""
    return np.minimum(np.frexp(n.astype(np.float64))[1], BUCKETS - 1)


def _mixture(counts: list[np.ndarray], contexts: list[np.ndarray], weights: np.ndarray, n_words: int) -> np.ndarray:
    """The interpolated probability: p_k = w f_k + (1 - w) p_(k-1), from the uniform one up."""
    p = np.full(len(counts[0]), 1.0 / (n_words + 1))
    for k, (c, x) in enumerate(zip(counts, contexts)):
        w = weights[k][_bucket(x)]
        p = w * (c / np.maximum(x, 1)) + (1 - w) * p
    return p


def _held_out(order: int, n_texts: int, n_tokens: int):
    """Distinct combinations of counts at the held-out tokens, and how often each occurs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers, parts = right.to_pylist(), []
        for row in left.to_pylist():
            chunk = _Chunk(row, order)
            counts = _counts(chunk, answers, with_dev=False)
            parts.append(np.stack([*counts, *_contexts(chunk, counts, n_texts, n_tokens)], axis=1))
        names = [f"c{k}" for k in range(order)] + [f"x{k}" for k in range(order)]
        found, n = np.unique(np.concatenate(parts) if parts else np.empty((0, 2 * order), np.int64), axis=0, return_counts=True)
        return pa.table({name: found[:, j] for j, name in enumerate(names)} | {"n": n.astype(np.int64)})

    return run


def _expect(order: int, weights: np.ndarray, n_words: int):
    """One expectation step over a batch: for each weight the tokens that used it, and those it could serve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy().astype(np.float64)
            n, p, steps = column("n"), np.full(len(batch), 1.0 / (n_words + 1)), []
            for k in range(order):
                bucket = _bucket(column(f"x{k}"))
                own = weights[k][bucket] * column(f"c{k}") / np.maximum(column(f"x{k}"), 1)
                p = own + (1 - weights[k][bucket]) * p
                steps.append((k, bucket, own / p))
            rows, reach = [], n  # tokens that no higher order has explained
            for k, bucket, share in reversed(steps):
                used, all_ = np.bincount(bucket, reach * share, BUCKETS), np.bincount(bucket, reach, BUCKETS)
                rows += [{"k": k, "b": b, "used": used[b], "reached": all_[b]} for b in np.flatnonzero(all_).tolist()]
                reach = reach * (1 - share)
            yield pa.RecordBatch.from_pylist(
                rows, pa.schema([("k", pa.int32()), ("b", pa.int32()), ("used", pa.float64()), ("reached", pa.float64())])
            )

    return run


def _learn(held_out: DataFrame, order: int, n_words: int, rounds: int) -> np.ndarray:
    """Weights by order and bucket.  A round is one aggregation of the held-out counts.

    One imagined token for and one against each weight keep it off 0 and 1.
    """
    weights = np.full((order, BUCKETS), 0.5)
    weights[:, 0] = 0.0  # a context never seen has no estimate
    for _ in range(rounds):
        sums = (
            held_out.mapInArrow(_expect(order, weights, n_words), "k int, b int, used double, reached double")
            .groupBy("k", "b").agg(F.sum("used").alias("used"), F.sum("reached").alias("reached")).collect()
        )
        for r in sums:
            if r["b"]:
                weights[r["k"], r["b"]] = (r["used"] + 1) / (r["reached"] + 2)
    return weights


def _scores(order: int, n_texts: int, n_tokens: int, n_words: int, weights: np.ndarray, id_col: str, id_type: pa.DataType):
    schema = pa.schema(
        [(id_col, id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers, out = right.to_pylist(), []
        for row in left.to_pylist():
            chunk = _Chunk(row, order)
            counts = _counts(chunk, answers, with_dev=True)
            p = _mixture(counts, _contexts(chunk, counts, n_texts, n_tokens), weights, n_words)
            base = np.log10((counts[0] + 1) / (n_tokens + n_words + 1))
            n = len(chunk.roles)
            total = lambda values: np.bincount(chunk.text, values, n)
            out.append(pa.table([
                pa.array(row["ids"], id_type),
                pa.array(chunk.roles == TEXT),
                pa.array(np.bincount(chunk.text, minlength=n).astype(np.int64)),
                pa.array(total(counts[0] > 0).astype(np.int64)),
                pa.array(np.full(n, n_tokens, np.int64)),
                pa.array(total(base)),
                pa.array(total(np.log10(p))),
            ], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def score_corpus(
    docs: DataFrame,
    train: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 2,
    dev_every: int = DEV_EVERY,
    rounds: int = ROUNDS,
    chunk_bytes: int = CHUNK_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Score every text with a model of the texts where ``train`` is true.

    Returns the id, ``held_out``, ``n_tokens`` (words and one end), ``n_known``
    (tokens that occur in training), ``train_tokens``, ``base_score`` (log10,
    add-one unigrams) and ``score`` (log10, the mixture).  Null texts count as
    empty: one token, the end.  Repeated rows are scored one by one, an empty
    table gives an empty result.  Without training texts every token gets the
    uniform probability of an empty vocabulary, 1.

    Words are lower-cased (A-Z only) and separated by ASCII white space.  The
    order is free; every order above the second shuffles about 1.5 times the
    size of the (compressed) input more.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    dev = F.pmod(F.xxhash64(F.lit("held out"), F.col(id_col)), F.lit(dev_every)) == 0
    role = F.when(F.coalesce(train, F.lit(False)), F.when(dev, DEV).otherwise(TRAIN)).otherwise(TEXT)
    source = docs.select(F.col(id_col), role.cast("int").alias("role"), text_of(text_col).alias("text"))
    ranges = max(1, -(-total_bytes(source, "text") // range_bytes))
    id_ddl = docs.schema[id_col].dataType.simpleString()
    schema = f"chunk bigint, kind int, ids array<{id_ddl}>, roles binary, offsets binary, texts binary"
    chunks = keep(source.mapInArrow(_to_chunks(id_type, chunk_bytes), schema), "chunks")
    requests = chunks.drop("ids").mapInArrow(
        _requests(order, ranges), "range int, k int, chunk bigint, kind int, grams binary, kept binary, dev binary"
    )
    answers = keep(
        requests.repartitionById(ranges * order, F.col("range")).groupBy("range").applyInArrow(_answers, _ANSWER), "answers"
    )
    of = {r["k"]: r for r in answers.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("distinct_kept", "distinct_all", "n_kept", "n_all")]).collect()}
    roles = source.groupBy("role").count().collect()
    n_texts = {r["role"]: r["count"] for r in roles}
    one = of.get(1)
    n_kept, n_all = (one["n_kept"], one["n_all"]) if one else (0, 0)
    words_kept, words_all = (one["distinct_kept"], one["distinct_all"]) if one else (0, 0)

    answers = answers.select("range", "k", "chunk", "kind", "kept", "dev")
    names = [f"c{k}" for k in range(order)] + [f"x{k}" for k in range(order)] + ["n"]
    held_out = keep(
        chunks.where("kind = 1").groupBy("chunk").cogroup(answers.where("kind = 1").groupBy("chunk"))
        .applyInArrow(_held_out(order, n_texts.get(TRAIN, 0), n_kept), ", ".join(f"{n} bigint" for n in names)),
        "held-out",
    )
    weights = _learn(held_out, order, words_kept, rounds)
    result = f"`{id_col}` {id_ddl}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    trained = n_texts.get(TRAIN, 0) + n_texts.get(DEV, 0)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _scores(order, trained, n_all, words_all, weights, id_col, id_type), result
    )
