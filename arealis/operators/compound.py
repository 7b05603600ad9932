"""Compound queries: sub-queries joined on the entity key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.functions.expressions import normalize_key

# The names of the join operators.
HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full"}


@dataclass(frozen=True)
class Leaf:
    """A sub-query.

    Of several rows with one key the last by ``order_by`` counts, so the order
    must be total.  ``unique=True`` states that keys do not repeat, and saves
    the aggregation.
    """

    df: DataFrame
    order_by: Sequence[str] | None = None
    unique: bool = False


# A leaf, or (first operand, join type, second operand).
Tree = Union[Leaf, tuple["Tree", str, "Tree"]]


def merge(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join two frames with unique keys; on shared columns the first operand's value wins.

    A null counts as a missing field, so the second operand fills it.
    """
    shared = [c for c in left.columns if c in right.columns and c != key]
    renamed = right.withColumnsRenamed({c: f"_second_{c}" for c in shared})
    joined = left.join(renamed, key, HOW[how])
    columns = [
        F.coalesce(F.col(c), F.col(f"_second_{c}")).alias(c) if c in shared else F.col(c) for c in left.columns
    ]
    return joined.select(*columns, *[c for c in right.columns if c not in left.columns])


def compound(tree: Tree, key: str, *, normalize: bool = False) -> DataFrame:
    """Evaluate a tree of sub-queries.

    Joins are on ``key``: inner, left, right or full.  Rows without a key
    match nothing; they appear only where their side is preserved.  A tree of
    one leaf returns the leaf, one row per key, keyless rows kept.
    ``normalize=True`` removes double quotes from the keys first.

    All leaves are read once, into one table with a column for each leaf's
    row, and grouped by key in one shuffle, the last row of a key being an
    ordinary maximum that is combined on the map side.  What the joins keep
    follows from which leaves have a row: no rows are joined, repeats of a key
    never meet in one task, and a leaf named several times is read once.
    """
    leaves: list[Leaf] = []
    shape = _collect(tree, leaves)
    needed = [i in _preserved(shape) for i in range(len(leaves))]
    shape, leaves, needed = _once(shape, leaves, needed)
    # the names of the leaves' columns are theirs; ours are numbered
    kinds, parts = [], []
    for i, leaf in enumerate(leaves):
        if not leaf.unique and not leaf.order_by:
            raise ValueError("order_by is needed to tell which of several rows is the last; or state unique=True")
        df = leaf.df.withColumn(key, normalize_key(key)) if normalize else leaf.df
        order = F.struct(*[F.col(c) for c in leaf.order_by]) if leaf.order_by and not leaf.unique else F.struct(F.lit(0))
        rest = [F.col(f"`{c}`") for c in df.columns if c != key] or [F.lit(0).alias("none")]
        row = df.select(F.col(key).alias("key"), F.struct(order.alias("order"), F.struct(*rest).alias("row")).alias("leaf"))
        kinds.append(row.schema["leaf"].dataType)
        parts.append(row if needed[i] else row.where(F.col("key").isNotNull()))
    tagged = [
        part.select(
            "key",
            *[(F.col("leaf") if i == j else F.lit(None).cast(kind)).alias(f"leaf{j}") for j, kind in enumerate(kinds)],
        )
        for i, part in enumerate(parts)
    ]
    # a row without a key is a group of its own content, and comes as often as it occurs
    solo = [j for j, keep in enumerate(needed) if keep]
    rows = reduce(DataFrame.union, tagged).withColumns(
        {f"solo{j}": F.when(F.col("key").isNull(), F.col(f"leaf{j}.row")) for j in solo}
    )
    last = [
        F.any_value(f"leaf{j}", ignoreNulls=True) if leaf.unique else F.max_by(F.col(f"leaf{j}"), F.col(f"leaf{j}.order"))
        for j, leaf in enumerate(leaves)
    ]
    grouped = rows.groupBy("key", *[f"solo{j}" for j in solo]).agg(
        *[c.alias(f"leaf{j}") for j, c in enumerate(last)], F.count(F.lit(1)).alias("copies")
    )
    present, columns = _joined(shape, [leaf.df.columns for leaf in leaves], key)
    found = grouped.where(present)
    if solo:
        times = F.when(F.col("key").isNull(), F.col("copies")).otherwise(F.lit(1).cast("bigint"))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    return found.select(*[c.alias(name) for name, c in columns.items()])


def _collect(tree: Tree, leaves: list[Leaf]) -> int | tuple:
    """The tree with the numbers of its leaves."""
    if isinstance(tree, DataFrame):
        tree = Leaf(tree)
    if isinstance(tree, Leaf):
        leaves.append(tree)
        return len(leaves) - 1
    first, how, second = tree
    if how.lower() not in HOW:
        raise ValueError(f"unknown join type {how.lower()!r}, expected one of {sorted(HOW)}")
    return _collect(first, leaves), HOW[how.lower()], _collect(second, leaves)


def _once(shape: int | tuple, leaves: list[Leaf], needed: list[bool]) -> tuple[int | tuple, list[Leaf], list[bool]]:
    """The tree with each leaf once whose rows without a key play no part."""
    number: dict[int, int] = {}
    kept: list[int] = []
    for i, leaf in enumerate(leaves):
        same = next((n for n, j in enumerate(kept) if leaves[j] is leaf and not needed[i] and not needed[j]), None)
        if same is None:
            kept.append(i)
        number[i] = len(kept) - 1 if same is None else same

    def renamed(part):
        return number[part] if isinstance(part, int) else (renamed(part[0]), part[1], renamed(part[2]))

    return renamed(shape), [leaves[i] for i in kept], [needed[i] for i in kept]


def _preserved(shape: int | tuple) -> set[int]:
    """Leaves whose rows without a key reach the result."""
    if isinstance(shape, int):
        return {shape}
    first, how, second = shape
    return (_preserved(first) if how in ("left", "full") else set()) | (_preserved(second) if how in ("right", "full") else set())


def _joined(shape: int | tuple, names: list[list[str]], key: str) -> tuple[Column, dict[str, Column]]:
    """Whether a key is in the result of a tree, and its columns there.

    On shared columns the first operand's value wins, a null being a missing
    field; a column of an operand without the key is null, whatever its leaves
    have.
    """
    if isinstance(shape, int):
        columns = {c: F.col("key") if c == key else F.col(f"leaf{shape}.row")[c] for c in names[shape]}
        return F.col(f"leaf{shape}").isNotNull(), columns
    first, how, second = shape
    (left, ours), (right, theirs) = (_joined(operand, names, key) for operand in (first, second))
    present = {"inner": left & right, "left": left, "right": right, "full": left | right}[how]
    ours = {c: v if c == key else F.when(left, v) for c, v in ours.items()}
    theirs = {c: v if c == key else F.when(right, v) for c, v in theirs.items()}
    merged = {c: v if c == key or c not in theirs else F.coalesce(v, theirs[c]) for c, v in ours.items()}
    return present, merged | {c: v for c, v in theirs.items() if c not in ours}


def compound_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    how: str = "inner",
    left_order_by: Sequence[str] | None = None,
    right_order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Two sub-queries joined; a side without an order must have unique keys."""
    return compound(
        (
            Leaf(left, left_order_by, unique=left_order_by is None),
            how,
            Leaf(right, right_order_by, unique=right_order_by is None),
        ),
        key,
    )
