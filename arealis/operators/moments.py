"""Least squares from moments: counts, means and covariances per key.

A fit with squared error, whatever its penalty and with or without an
intercept, depends on the rows only through these.  They are gathered in one
shuffle for all keys, and the small systems are solved in batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: up to so many features each moment is an aggregate column of its own, beyond they are vectors; the figures are the same
COLUMN_FEATURES = 8
#: bytes of partial moments that a task holds before it sends them on
_HELD_BYTES = 64 << 20
#: a variance below this share of the squared mean is rounding: the column is constant
_CONSTANT = 1e-26
#: directions of the scaled system below this share of the largest are not determined
_RANK = 1e-13

NAMES = ("n", "mean_y", "var_y", "mean_x", "cov_xy", "cov_xx")


# ---------------------------------------------------------------- gathering


def moments_by_key(rows: DataFrame, key: str, features: Sequence[str], label: str, side: str | None = None) -> DataFrame:
    """One row per key: ``n, mean_y, var_y, mean_x, cov_xy, cov_xx`` (row by row), all with divisor n.

    ``rows`` has no nulls in key, features and label.  With ``side``, a boolean
    column, these are of the rows where it is true, and the same names with
    ``test_`` before them of the others; a side without rows has n = 0 and
    nulls or empty arrays.
    """
    if len(features) <= COLUMN_FEATURES:
        columns = _columns(features, label, "", F.col(side) if side else None)
        if side:
            columns += _columns(features, label, "test_", ~F.col(side))
        return rows.groupBy(key).agg(*columns)
    merged = _merged(rows, key, features, label, side)
    if not side:
        return merged.drop("_side")
    train, test = (merged.where(F.col("_side") == value).drop("_side") for value in (True, False))
    test = test.withColumnsRenamed({n: f"test_{n}" for n in NAMES})
    both = train.join(test, key, "full")
    return both.withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")) for n in ("n", "test_n")})


def _columns(features: Sequence[str], label: str, prefix: str, where: Column | None) -> list[Column]:
    def side(name: str) -> Column:
        return F.col(name) if where is None else F.when(where, F.col(name))

    p, y = len(features), side(label)
    x = [side(f) for f in features]

    def cov(i: int, j: int) -> Column:
        return F.var_pop(x[i]) if i == j else F.covar_pop(x[min(i, j)], x[max(i, j)])

    return [
        F.count(y).alias(f"{prefix}n"),
        F.avg(y).alias(f"{prefix}mean_y"),
        F.var_pop(y).alias(f"{prefix}var_y"),
        F.array(*[F.avg(v) for v in x]).alias(f"{prefix}mean_x"),
        F.array(*[F.covar_pop(v, y) for v in x]).alias(f"{prefix}cov_xy"),
        F.array(*[cov(i, j) for i in range(p) for j in range(p)]).alias(f"{prefix}cov_xx"),
    ]


class _Partial:
    """Centred moments of a group of rows, mergeable: count, means, sums of products about the means."""

    __slots__ = ("n", "mean", "square")

    def __init__(self, n: int, mean: np.ndarray, square: np.ndarray):
        self.n, self.mean, self.square = n, mean, square

    @classmethod
    def of(cls, values: np.ndarray) -> _Partial:
        mean = values.mean(axis=0)
        centred = values - mean
        return cls(len(values), mean, centred.T @ centred)

    def add(self, other: _Partial) -> None:
        n = self.n + other.n
        step = other.mean - self.mean
        self.square = self.square + other.square + np.outer(step, step) * (self.n * other.n / n)
        self.mean = self.mean + step * (other.n / n)
        self.n = n


def _gather(width: int, key_type: pa.DataType):
    """Rows (key, side, values) to partial moments by key and side.

    A group with few rows in a task is sent as these rows, which take less
    room than a matrix; so what is shuffled is never more than the rows.
    """
    upper = np.triu_indices(width)
    schema = pa.schema([("key", key_type), ("side", pa.bool_()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("square", pa.list_(pa.float64()))])

    def sent(partials: dict) -> Iterator[pa.RecordBatch]:
        out = []
        for (key, side), part in partials.items():
            if isinstance(part, list):
                out += [{"key": key, "side": side, "n": 1, "mean": v, "square": []} for rows in part for v in rows]
            else:
                out.append({"key": key, "side": side, "n": part.n, "mean": part.mean, "square": part.square[upper]})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partials: dict = {}
        held = 0
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1)
            place, groups = pd.MultiIndex.from_arrays(
                [batch.column(0).to_pandas(), batch.column(1).to_numpy(zero_copy_only=False)]
            ).factorize()
            order = np.argsort(place, kind="stable")
            bounds = np.searchsorted(place[order], np.arange(len(groups) + 1))
            for i, group in enumerate(groups):
                rows = values[order[bounds[i] : bounds[i + 1]]]
                known = partials.get(group)
                if isinstance(known, _Partial):
                    known.add(_Partial.of(rows))
                    continue
                known = [*(known or []), rows]
                if 2 * sum(map(len, known)) > width:
                    partials[group] = _Partial.of(np.concatenate(known))
                    held += 8 * width * width
                else:
                    partials[group] = known
                    held += rows.nbytes
            if held >= _HELD_BYTES:
                yield from sent(partials)
                partials, held = {}, 0
        yield from sent(partials)

    return run


def _merge(width: int, key_type: pa.DataType, names: Sequence[str]):
    """Partial moments, sorted by key and side, to one row each."""
    upper = np.triu_indices(width)
    lists = pa.list_(pa.float64())
    schema = pa.schema(
        [(names[0], key_type), ("_side", pa.bool_()), ("n", pa.int64()), ("mean_y", pa.float64()), ("var_y", pa.float64()), ("mean_x", lists), ("cov_xy", lists), ("cov_xx", lists)]
    )

    def row(group: tuple, part: _Partial) -> dict:
        cov = part.square / part.n
        return {
            names[0]: group[0], "_side": group[1], "n": part.n, "mean_y": part.mean[-1], "var_y": cov[-1, -1],
            "mean_x": part.mean[:-1], "cov_xy": cov[:-1, -1], "cov_xx": cov[:-1, :-1].ravel(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, out = None, None, []
        for batch in batches:
            squares = batch.column(4)
            for i, (key, side, n) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)))):
                square = np.zeros((width, width))
                packed = squares[i].values.to_numpy()
                if len(packed):
                    square[upper] = packed
                    square.T[upper] = packed
                part = _Partial(n, batch.column(3)[i].values.to_numpy(), square)
                if (key, side) == now:
                    total.add(part)
                    continue
                if now is not None:
                    out.append(row(now, total))
                now, total = (key, side), part
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([*out, row(now, total)], schema)

    return run


def _merged(rows: DataFrame, key: str, features: Sequence[str], label: str, side: str | None) -> DataFrame:
    width, kind = len(features) + 1, rows.schema[key].dataType
    key_type, ddl = to_arrow_type(kind), kind.simpleString()
    values = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate([*features, label])]
    flat = rows.select(F.col(key).alias("key"), (F.col(side) if side else F.lit(True)).alias("side"), *values)
    partial = flat.mapInArrow(
        _gather(width, key_type), f"key {ddl}, side boolean, n bigint, mean array<double>, square array<double>"
    )
    dealt = partial.repartition("key").sortWithinPartitions("key", "side")
    return dealt.mapInArrow(
        _merge(width, key_type, [key]),
        f"`{key}` {ddl}, _side boolean, n bigint, mean_y double, var_y double, "
        "mean_x array<double>, cov_xy array<double>, cov_xx array<double>",
    )


# ---------------------------------------------------------------- solving


def _soft(value: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(value) * np.maximum(np.abs(value) - by, 0)


def least_squares(
    n: np.ndarray,
    mean_y: np.ndarray,
    var_y: np.ndarray,
    mean_x: np.ndarray,
    cov_xy: np.ndarray,
    cov_xx: np.ndarray,
    *,
    reg: float,
    elastic_net: float,
    fit_intercept: bool,
    standardization: bool,
    unbiased: bool,
    max_iter: int,
    tol: float,
) -> tuple[np.ndarray, ...]:
    """Solve N systems of p features at once: coefficients, intercept, mse, r2, iterations, objective history.

    Minimises the mean squared error / 2 and the penalty ``reg * (elastic_net *
    |w| + (1 - elastic_net) / 2 * w**2)`` on labels in units of their spread
    and, with ``standardization``, on features in units of theirs
    (``unbiased``: with divisor n - 1).  A constant feature has the coefficient
    0; a constant label (through the origin: 0) has no coefficients but 0.
    Where features are collinear, the shortest solution in these units is
    taken.  An L1 penalty is solved by coordinate descent, at most ``max_iter``
    sweeps, until no fitted value moves by more than ``tol`` in these units.
    """
    count, p = mean_x.shape
    var_x = np.einsum("npp->np", cov_xx)
    live = var_x > _CONSTANT * mean_x**2
    flat_y = ~(var_y > _CONSTANT * mean_y**2)
    correct = np.where(n > 1, n / np.maximum(n - 1, 1), 1.0) if unbiased else np.ones(count)
    spread_x = np.sqrt(np.where(live, var_x, 0) * correct[:, None])
    unit = np.sqrt(np.where(flat_y, 0, var_y) * correct)
    if fit_intercept:
        system, right, square = cov_xx, cov_xy, np.where(flat_y, 0, var_y)
    else:
        system = cov_xx + mean_x[:, :, None] * mean_x[:, None, :]
        right, square = cov_xy + mean_x * mean_y[:, None], var_y + mean_y**2
        unit = np.where(flat_y, np.abs(mean_y), unit)
    live = live & (unit > 0)[:, None]
    unit = np.where(unit > 0, unit, 1.0)
    scale = np.where(live, np.sqrt(np.einsum("npp->np", system)), 1.0)
    # in units where each live feature has length 1 and the label spread 1
    a = system / (scale[:, :, None] * scale[:, None, :]) * (live[:, :, None] & live[:, None, :])
    b = np.where(live, right / scale, 0) / unit[:, None]
    weight = spread_x / scale if standardization else 1 / scale
    strength = (reg / unit)[:, None]
    ridge = np.where(live, strength * (1 - elastic_net) * weight**2, 1.0)
    lasso = np.where(live, strength * elastic_net * weight, 0.0)
    energy = square / unit**2

    def objective(w):
        error = energy - 2 * (w * b).sum(1) + np.einsum("ni,nij,nj->n", w, a, w)
        return 0.5 * error + (lasso * np.abs(w)).sum(1) + 0.5 * (np.where(live, ridge, 0) * w**2).sum(1)

    w, sweeps = np.zeros((count, p)), np.zeros(count, int)
    if reg and elastic_net:
        history = [[float(v)] for v in objective(w)]
        moving = np.ones(count, bool)
        length = np.where(live, np.einsum("npp->np", a), 1.0)
        while moving.any() and sweeps.max(initial=0) < max_iter:
            at = np.flatnonzero(moving)
            before = w[at].copy()
            for j in range(p):
                rest = b[at, j] - np.einsum("ni,ni->n", a[at, j], w[at]) + length[at, j] * w[at, j] * live[at, j]
                w[at, j] = np.where(live[at, j], _soft(rest, lasso[at, j]) / (length[at, j] + ridge[at, j]), 0)
            sweeps[at] += 1
            now = objective(w)
            for i in at:
                history[i].append(float(now[i]))
            moving[at] = np.abs(w[at] - before).max(axis=1, initial=0) > tol
    else:
        history = [[0.0]] * count
        values, axes = np.linalg.eigh(a + np.einsum("np,pq->npq", ridge, np.eye(p)))
        known = values > _RANK * values.max(axis=1, keepdims=True)
        along = np.einsum("nij,ni->nj", axes, b)
        w = np.einsum("nij,nj->ni", axes, np.where(known, along / np.where(known, values, 1), 0))
        w = np.where(live, w, 0)
    w = w * unit[:, None] / scale
    mse = np.maximum(square - 2 * (w * right).sum(1) + np.einsum("ni,nij,nj->n", w, system, w), 0)
    intercept = mean_y - (w * mean_x).sum(1) if fit_intercept else np.zeros(count)
    r2 = np.where(square > 0, 1 - mse / np.where(square > 0, square, 1), np.nan)
    return w, intercept, mse, r2, sweeps, history


def solved(moments: DataFrame, **how) -> Column:
    """The fit of each row of :func:`moments_by_key` as a struct; null where its figures are not finite or there are no rows."""

    @F.pandas_udf(
        "total_iterations int, rmse double, r2 double, intercept double, coefficients array<double>, objective_history array<double>"
    )
    def solve(n: pd.Series, mean_y: pd.Series, var_y: pd.Series, mean_x: pd.Series, cov_xy: pd.Series, cov_xx: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(
            index=n.index, columns=["total_iterations", "rmse", "r2", "intercept", "coefficients", "objective_history"], dtype=object
        )
        usable = [i for i in n.index if n[i] and _finite(mean_y[i], var_y[i], mean_x[i], cov_xy[i], cov_xx[i])]
        # as many systems at a time as fit a few megabytes
        p = len(mean_x[usable[0]]) if usable else 1
        step = max(1, (4 << 20) // (8 * p * p))
        for first in range(0, len(usable), step):
            at = usable[first : first + step]
            stack = lambda s: np.array([s[i] for i in at], float)
            w, intercept, mse, r2, sweeps, history = least_squares(
                stack(n), stack(mean_y), stack(var_y), stack(mean_x), stack(cov_xy), stack(cov_xx).reshape(len(at), p, p), **how
            )
            for k, i in enumerate(at):
                out.loc[i] = [int(sweeps[k]), float(np.sqrt(mse[k])), None if np.isnan(r2[k]) else float(r2[k]), float(intercept[k]), w[k].tolist(), history[k]]
        return out

    return solve(*[F.col(name) for name in NAMES])


def _finite(*values) -> bool:
    return all(v is not None and np.isfinite(np.asarray(v, float)).all() for v in values)


def solved_line(reg: float, elastic_net: float, fit_intercept: bool, standardization: bool, unbiased: bool) -> dict[str, Column]:
    """:func:`least_squares` for one feature, as columns: the soft threshold is the whole solution."""
    mean_x, cov_xy, var_x = (F.get(c, F.lit(0)) for c in ("mean_x", "cov_xy", "cov_xx"))
    mean_y, var_y, n = F.col("mean_y"), F.col("var_y"), F.col("n")
    correct = F.when(n > 1, n / (n - 1)).otherwise(F.lit(1.0)) if unbiased else F.lit(1.0)
    flat_x, flat_y = ~(var_x > _CONSTANT * mean_x**2), ~(var_y > _CONSTANT * mean_y**2)
    square = F.when(flat_y, F.lit(0.0)).otherwise(var_y)
    spread_x, unit = F.sqrt(var_x * correct), F.sqrt(square * correct)
    system, right = var_x, cov_xy
    if not fit_intercept:
        system, right, square = var_x + mean_x * mean_x, cov_xy + mean_x * mean_y, var_y + mean_y * mean_y
        unit = F.when(flat_y, F.abs(mean_y)).otherwise(unit)
    ridge = F.lit(reg * (1 - elastic_net)) / unit * (spread_x * spread_x if standardization else F.lit(1.0))
    lasso = F.lit(reg * elastic_net) * (spread_x if standardization else F.lit(1.0))
    # the penalties are 0 where the unit is: such a label has the coefficient 0 anyway
    shrunk = F.signum(right) * F.greatest(F.abs(right) - lasso, F.lit(0.0)) if reg and elastic_net else right
    slope = F.when(flat_x | ~(unit > 0), F.lit(0.0)).otherwise(shrunk / (system + ridge) if reg else right / system)
    slope = F.when(n > 0, slope)
    mse = F.greatest(square - 2 * slope * right + slope * slope * system, F.lit(0.0))
    return {
        "total_iterations": F.lit(1 if reg and elastic_net else 0),
        "rmse": F.sqrt(mse),
        "r2": F.when(square > 0, 1 - mse / square),
        "intercept": mean_y - slope * mean_x if fit_intercept else F.when(n > 0, F.lit(0.0)),
        "coefficients": F.when(n > 0, F.array(slope)),
        "objective_history": F.array(F.lit(0.0)),
    }
