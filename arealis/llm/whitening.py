"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed.  What is iterated is a small block of
directions Q: one distributed pass over the centred rows X gives XᵀXQ.  A
Chebyshev polynomial of that product, evaluated by its three-term recurrence,
damps the unwanted part of the spectrum; then QR and a Rayleigh-Ritz step turn
the block towards the eigenvectors.  This repeats until the residuals certify
the wanted pairs.

The rows are stored once as integers, in blocks of a bounded size, in the
shared folder; every pass reads those blocks.  Only matrices of (dimensions x
block) entries reach the driver, and they are summed by dimension in Spark, so
neither the number of rows nor that of tasks matters there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arealis.llm.spread import keep

#: a vector's entry c becomes the integer floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
#: entries beyond this cannot be made integers in double arithmetic with room for sums
LARGEST = float(1 << 50)
BLOCK_VALUES = 1 << 20
DEGREE = 10
#: an eigenvalue of less than this share of the largest one is taken for zero
ZERO = 1e-11
#: residuals are relative to the largest eigenvalue
CERTIFIED = 1e-12
MOST_ROUNDS = 60
_LANCZOS = 12


class NotCertified(ArithmeticError):
    """The residuals did not become small enough in the rounds allowed."""


@dataclass(frozen=True)
class Whitening:
    """The fit: the kept rows, their sums, and the certified eigenpairs in columns."""

    blocks: DataFrame  # id array, integer rows
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def _numbers(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch that can be used, as integers, and where they are."""
    vectors = batch.column(1)
    if isinstance(vectors, pa.FixedSizeListArray):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    sizes = np.where(np.asarray(vectors.is_valid()), vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), -1)
    at = np.flatnonzero(sizes == width)
    flat = vectors.take(pa.array(at)).flatten().cast(pa.float64(), safe=False)
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), width)
    scaled = np.floor(values * SCALE)
    with np.errstate(invalid="ignore"):
        good = (np.isfinite(scaled) & (np.abs(scaled) < LARGEST)).all(axis=1)
    return at[good], scaled[good].astype(np.int64) + SHIFT


def _to_blocks(width: int, id_type: pa.DataType):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(id_type)), ("rows", pa.binary())])
    most = max(1, BLOCK_VALUES // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first in range(0, len(batch), most):
                part = batch.slice(first, most)
                at, rows = _numbers(part, width)
                if len(at):
                    ids = part.column(0).take(pa.array(at))
                    lists = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists, pa.array([rows.tobytes()], pa.binary())], schema=schema)
                    number += 1

    return run


def _rows(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(-1, width)


def _sums(width: int):
    schema = pa.schema([("i", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                rows = _rows(blob.as_py(), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, len(rows))), pa.array(rows.sum(axis=0))],
                    schema=schema,
                )

    return run


def _centred(rows: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n, from the exact integer n*x - S."""
    total = np.array(sums, object)
    largest = n * max(int(np.abs(rows).max(initial=0)), 1) + max((abs(s) for s in sums), default=0)
    if largest < 1 << 62:
        return (rows * n - total.astype(np.int64)) / n
    return ((rows.astype(object) * n - total) / n).astype(np.float64)


def _summed(blocks: DataFrame, width: int, columns: int, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``product(rows)``, a matrix of ``columns`` columns; partial sums by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column(0):
                part = product(_rows(blob.as_py(), width))
                total = part if total is None else total + part
        if total is not None:
            lists = pa.ListArray.from_arrays(np.arange(0, total.size + 1, columns, dtype=np.int32), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists], ["i", "v"])

    entries = blocks.select("rows").mapInArrow(run, "i int, v array<double>")
    summed = entries.groupBy("i").agg(*[F.sum(F.get("v", F.lit(j))).alias(f"c{j}") for j in range(columns)])
    return summed.toPandas().sort_values("i").iloc[:, 1:].to_numpy(np.float64)


def _bounds(apply: Callable[[np.ndarray], np.ndarray], width: int, seed: int) -> float:
    """A lower estimate of the smallest eigenvalue: Lanczos, less the residual of its smallest Ritz pair."""
    q = np.random.default_rng(seed).standard_normal(width)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(_LANCZOS, width)):
        w = apply(basis[-1][:, None])[:, 0]
        alpha.append(basis[-1] @ w)
        for _ in range(2):
            w -= np.array(basis).T @ (np.array(basis) @ w)
        beta.append(np.linalg.norm(w))
        if beta[-1] <= 1e-10 * max(map(abs, alpha)):
            break
        basis.append(w / beta[-1])
    steps = len(alpha)
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: steps - 1], 1) + np.diag(beta[: steps - 1], -1))
    return max(0.0, float(values[0] - beta[-1] * abs(vectors[-1, 0])))


def _filter(apply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial that is small on [low, cut], scaled to 1 at ``top``, of the covariance times the block."""
    middle, half = (cut + low) / 2, (cut - low) / 2
    step = half / (top - middle)
    first, now, scale = block, (apply(block) - middle * block) * (step / half), step
    for _ in range(degree - 1):
        new = 1 / (2 / step - scale)
        first, now = now, (apply(now) - middle * now) * (2 * new / half) - (scale * new) * first
        scale = new
    return now


def fit_whitening(
    vectors: DataFrame,
    components: int = 32,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    guard: int | None = None,
    degree: int = DEGREE,
    seed: int = 13,
) -> Whitening:
    """The leading eigenpairs of the covariance (divisor n) of all usable vectors.

    Vectors that are null or hold null or non-finite entries are left out, as
    are those whose entries exceed 2**50 / 64 or whose length is not the
    commonest one (of equally common ones the larger).  Repeated rows count as
    often as they occur.  ``guard`` further directions (half as many as there
    are components, 8 at least) are iterated with the wanted ones; in each
    round the last one is drawn anew, so that no eigenvector can stay unseen.
    Each round costs ``degree`` + 1 passes.  Components end where the
    eigenvalue is 0: equal vectors, or an empty table, have none.

    A pair is certified when |Vq - eq| is at most 1e-12 of the largest
    eigenvalue; rounds go on while that still shrinks.  ``NotCertified`` is
    raised if it stays above 1e-8.
    """
    source = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("vector"))
    lengths = source.where("size(vector) > 0").groupBy(F.size("vector").alias("width")).count()
    widest = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    width = widest["width"] if widest else 1
    id_type = to_arrow_type(vectors.schema[id_col].dataType)
    id_ddl = vectors.schema[id_col].dataType.simpleString()
    blocks = keep(source.mapInArrow(_to_blocks(width, id_type), f"block bigint, ids array<{id_ddl}>, rows binary"), "vectors")

    counted = (
        blocks.select("rows").mapInArrow(_sums(width), "i int, n bigint, total bigint")
        .groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    )
    exact = sorted(counted, key=lambda r: r["i"])
    n, sums = (exact[0]["n"], tuple(int(r["total"]) for r in exact)) if exact else (0, (0,) * width)
    if not n:
        return Whitening(blocks, 0, sums, np.empty(0), np.empty((width, 0)), 0.0, 0.0, 0)

    spread = _summed(blocks, width, 1, lambda rows: (_centred(rows, n, sums) ** 2).sum(axis=0)[:, None]) / n
    trace, passes = float(spread.sum()), 0
    if not trace:
        return Whitening(blocks, n, sums, np.empty(0), np.empty((width, 0)), 0.0, 0.0, 0)

    def apply(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def product(rows):
            centred = _centred(rows, n, sums)
            return centred.T @ (centred @ block)

        return _summed(blocks, width, block.shape[1], product) / n

    wanted = min(components, width)
    size = min(width, wanted + (guard if guard is not None else max(8, wanted // 2)))
    random = np.random.default_rng(seed)
    low = _bounds(apply, width, seed) if size < width else 0.0
    q = np.linalg.qr(random.standard_normal((width, size)))[0]
    best = None
    for _ in range(MOST_ROUNDS):
        # Rayleigh-Ritz on the block
        image = apply(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        some = wanted if values[0] <= 0 else int((values[:wanted] > ZERO * values[0]).sum())
        residual = float(np.linalg.norm(image[:, :some] - q[:, :some] * values[:some], axis=0).max(initial=0) / values[0])
        stalled = best is not None and residual > best[0] / 4
        if best is None or residual < best[0]:
            best = (residual, values[:some].copy(), q[:, :some].copy())
        if best[0] <= CERTIFIED and (stalled or size == width):
            break
        top, cut = float(values[0]), float(values[-1])
        if size < width:
            q[:, -1] = random.standard_normal(width)  # a direction that no round before has shaped
            q = np.linalg.qr(q)[0]
            # without an unwanted part between the bounds (it is 0, or level with the least wanted) a plain step is enough
            apart = cut > ZERO * top and cut > low + ZERO * top
            q = _filter(apply, q, low, cut, top, degree) if apart else apply(q)
        q = np.linalg.qr(q)[0]
    residual, values, vectors_ = best
    if residual > 1e-8:
        raise NotCertified(f"residual {residual:.2e} after {MOST_ROUNDS} rounds")
    return Whitening(blocks, n, sums, values, vectors_, trace, residual, passes)


def _whiten(rows: np.ndarray, fit_n: int, sums: tuple[int, ...], vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    return _centred(rows, fit_n, sums) @ vectors / np.sqrt(values)


def identity_error(fit: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity; one pass."""
    if not len(fit.values):
        return 0.0
    n, sums, vectors, values = fit.n, fit.sums, fit.vectors, fit.values

    def product(rows):
        white = _whiten(rows, n, sums, vectors, values)
        return np.vstack([white.T @ white, white.sum(axis=0)])

    total = _summed(fit.blocks, len(sums), len(values), product) / n
    covariance = total[:-1] - np.outer(total[-1], total[-1])
    return float(np.abs(covariance - np.eye(len(values))).max())


def deviations(rows: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The exact sum over dimensions of (n*x - S)**2 of each row; None where it does not fit 64 bits."""
    largest = float(np.abs(_centred(rows, n, sums)).max(initial=0)) * n
    if largest**2 * rows.shape[1] < 2.0**62 and n * float(np.abs(rows).max(initial=0)) < 2.0**62:
        return ((rows * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((rows.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(fit: Whitening, *, id_col: str = "vec_id") -> DataFrame:
    """The fitted rows as one vector each: id, ``deviation`` (exact, or null beyond 64 bits), ``whitened`` array."""
    n, sums, vectors, values = fit.n, fit.sums, fit.vectors, fit.values
    element = fit.blocks.schema["ids"].dataType.elementType
    schema = pa.schema([(id_col, to_arrow_type(element)), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blob in enumerate(batch.column(1)):
                rows = _rows(blob.as_py(), len(sums))
                white = _whiten(rows, n, sums, vectors, values)
                lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(values), pa.array(white.ravel()))
                ids = batch.column(0)[i].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(rows, n, sums), pa.int64()), lists], schema=schema)

    ddl = f"`{id_col}` {element.simpleString()}, deviation bigint, whitened array<double>"
    return fit.blocks.select("ids", "rows").mapInArrow(run, ddl)


def whitening_report(vectors: DataFrame, components: int = 32, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable vector and component.

    Id, ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation``,
    ``whitened``, ``explained`` (the eigenvalue's share of the trace) and
    ``identity_error``.  Which vectors are left out is told at
    :func:`fit_whitening`; equal vectors alone, or none, give no rows.
    """
    fit = fit_whitening(vectors, components, id_col=id_col, vector_col=vector_col)
    error = identity_error(fit)
    shares = F.from_json(F.lit(json.dumps((fit.values / fit.trace).tolist() if fit.trace else [])), "array<double>")
    rows = whiten(fit, id_col=id_col).withColumn("_shares", shares)
    return rows.select(id_col, "deviation", "_shares", F.posexplode("whitened").alias("_at", "whitened")).select(
        id_col,
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get("_shares", F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
