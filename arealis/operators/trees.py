"""One tree ensemble per key, all keys grown together."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arealis.functions.split import MODULUS, row_hash
from arealis.operators.keyed import for_keys, restrict_keys
from arealis.operators.params import check_choice, check_range
from arealis.operators.regression import check_columns, complete_rows
from arealis.sources.stored import discard, stored

#: rows of a key, drawn by a hash of their ids, that tell where its features may be split
SAMPLED_ROWS = 10_000
#: up to so many splits (or split values) are broadcast, some 50 MB
BROADCAST_SPLITS = 1_000_000
#: a smaller share of the explained sum of squares is rounding
_NO_GAIN = 1e-12

# Accepted names.
SUBSETS = ("auto", "all", "sqrt", "log2", "onethird")
LOSSES = ("squared", "absolute")


@dataclass(frozen=True)
class TreeParams:
    """Hyper-parameters common to both ensembles."""

    impurity: str = "variance"
    feature_subset: str = "auto"
    min_instances_per_node: int = 1
    max_depth: int = 5
    max_bins: int = 32
    min_info_gain: float = 0.0
    min_weight_fraction_per_node: float = 0.0
    subsampling_rate: float = 1.0
    train_split: float = 0.8

    def validate(self) -> None:
        check_choice("impurity", self.impurity, ("variance",))
        check_choice("feature_subset", self.feature_subset, SUBSETS)
        check_range("min_instances_per_node", self.min_instances_per_node, 1, 10_000)
        check_range("max_depth", self.max_depth, 0, 15)
        check_range("max_bins", self.max_bins, 2, 100)
        check_range("min_info_gain", self.min_info_gain, 0, 1)
        check_range("min_weight_fraction_per_node", self.min_weight_fraction_per_node, 0, 0.5, open_high=True)
        check_range("subsampling_rate", self.subsampling_rate, 0, 1, open_low=True)
        check_range("train_split", self.train_split, 0, 1, open_low=True, open_high=True)


@dataclass(frozen=True)
class ForestParams(TreeParams):
    num_trees: int = 20
    bootstrap: bool = False

    def validate(self) -> None:
        super().validate()
        check_range("num_trees", self.num_trees, 1, 1000)


@dataclass(frozen=True)
class BoostParams(TreeParams):
    loss: str = "squared"
    max_iter: int = 10
    step_size: float = 0.1

    def validate(self) -> None:
        super().validate()
        check_choice("loss", self.loss, LOSSES)
        check_range("max_iter", self.max_iter, 1, 10_000)
        check_range("step_size", self.step_size, 0, 1, open_low=True)


@dataclass(frozen=True)
class _Plan:
    """What a pass needs to know of the ensemble."""

    trees: int
    depth: int
    bins: int
    chosen: int  # features looked at in a node
    rate: float
    bootstrap: bool
    boosted: bool
    step_size: float
    absolute: bool
    seed: int


def _subset(strategy: str, p: int, trees: int, boosted: bool) -> int:
    if strategy == "auto":
        strategy = "all" if boosted or trees == 1 else "onethird"
    share = {"all": p, "sqrt": math.sqrt(p), "log2": max(1.0, math.log2(p)), "onethird": p / 3}[strategy]
    return max(1, math.ceil(share))


def random_forest_by_key(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    keys: Sequence[Any] | None = None,
    *,
    id_cols: Sequence[str],
    params: ForestParams = ForestParams(),
    seed: int = 1,
    nulls: str = "error",
) -> DataFrame:
    """A random forest for every key (or the requested ``keys``): key, test_n, rmse, r2 on the held-out rows.

    All forests grow together, a level of all trees of all keys with each pass;
    see :func:`_grow`.  The result depends on the ids, the seed and the values,
    not on the layout.  A key without training rows has null figures.
    """
    params.validate()
    plan = _Plan(
        params.num_trees, params.max_depth, params.max_bins, _subset(params.feature_subset, len(features), params.num_trees, False),
        params.subsampling_rate, params.bootstrap, False, 1.0, False, seed,
    )
    return _fit_all(df, key, features, label, keys, id_cols, params, plan, nulls)


def gbt_by_key(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    keys: Sequence[Any] | None = None,
    *,
    id_cols: Sequence[str],
    params: BoostParams = BoostParams(),
    seed: int = 1,
    nulls: str = "error",
) -> DataFrame:
    """Gradient-boosted trees for every key (or the requested ``keys``): key, test_n, rmse, r2 on the held-out rows.

    The first tree learns the labels, each further one what the ones before
    leave: twice the difference, or with the absolute loss its sign, and counts
    ``step_size``.  All keys grow together; see :func:`random_forest_by_key`.
    """
    params.validate()
    plan = _Plan(
        params.max_iter, params.max_depth, params.max_bins, _subset(params.feature_subset, len(features), params.max_iter, True),
        params.subsampling_rate, False, True, params.step_size, params.loss == "absolute", seed,
    )
    return _fit_all(df, key, features, label, keys, id_cols, params, plan, nulls)


# ---------------------------------------------------------------- rows in blocks


def _split_values(key: str, key_type: pa.DataType, p: int, bins: int):
    """A key's sampled rows to the values at which each feature may be split: those of equal steps in rank."""
    schema = pa.schema([(key, key_type), ("cuts", pa.list_(pa.list_(pa.float64())))])

    def run(table: pa.Table) -> pa.Table:
        cuts = []
        for i in range(p):
            values = np.sort(table.column(f"_x{i}").to_numpy())
            known = np.unique(values)
            if len(known) > bins:
                known = np.unique(values[(np.arange(1, bins) * len(values)) // bins])
            # a split leaves something on its right
            cuts.append(known[known < values[-1]].tolist())
        return pa.Table.from_pylist([{key: table.column(key)[0].as_py(), "cuts": cuts}], schema)

    return run


def _to_blocks(key_type: pa.DataType, p: int):
    """Rows sorted by key to blocks of one key: ids, sides, features and labels as arrays of bytes."""
    schema = pa.schema([("key", key_type), ("ids", pa.binary()), ("train", pa.binary()), ("x", pa.binary()), ("y", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pd.factorize(batch.column(0).to_pandas())[0]
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            ids, train = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(3 + i).to_numpy() for i in range(p)], axis=1)
            y = batch.column(3 + p).to_numpy()
            cut = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(codes)])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), cut(ids), cut(train), cut(x), cut(y)], schema=schema)

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a batch one at a time, as views of it: a batch holds hundreds of them, of which no second copy is made."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _array(block: pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    """The bytes of a block's column as numbers, not copied."""
    return np.frombuffer(block.column(column)[0].as_buffer(), kind)


def _to_bins(key_type: pa.DataType, p: int):
    """Features as the number of split values below them; labels about the middle of their key's."""
    schema = pa.schema([("key", key_type), ("ids", pa.binary()), ("train", pa.binary()), ("bins", pa.binary()), ("y", pa.binary()), ("scale", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _single(batches):
            x, cuts = _array(block, "x", np.float64).reshape(-1, p), block.column("cuts")[0].as_py()
            places = [np.searchsorted(np.array(c, np.float64), x[:, i], "left") for i, c in enumerate(cuts)]
            bins = np.stack(places, axis=1).astype(np.uint8).tobytes()
            labels = (_array(block, "y", np.float64) - block.column("middle")[0].as_py()).tobytes()
            rest = [block.column(c) for c in ("key", "ids", "train")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([bins], pa.binary()), pa.array([labels], pa.binary()), block.column("scale")], schema=schema)

    return run


class _Block:
    """One block and the trees of its key so far."""

    def __init__(self, row: pa.RecordBatch, p: int, plan: _Plan):
        self.plan, self.p = plan, p
        self.bins = _array(row, "bins", np.uint8).reshape(-1, p)
        self.y = _array(row, "y", np.float64)
        self.train = _array(row, "train", bool)
        self.ids = _array(row, "ids", np.uint64)
        self.scale = row.column("scale")[0].as_py()
        model = row.column("model")[0].as_py() or []
        self.model = np.array([tuple(m[c] for c in _SPLIT.names) for m in model], _SPLIT)

    def __len__(self) -> int:
        return len(self.y)

    def weights(self, tree: int) -> np.ndarray:
        """How often each row counts in a tree, from its id."""
        plan = self.plan
        if not plan.bootstrap and plan.rate >= 1:
            return self.train.astype(np.int64)
        drawn = _mix(self.ids ^ _mix(np.full(1, plan.seed * 1_000_003 + tree, np.uint64))) / 2.0**64
        if plan.bootstrap:
            terms = np.cumprod(np.concatenate([[math.exp(-plan.rate)], plan.rate / np.arange(1, 40)]))
            return np.searchsorted(np.cumsum(terms), drawn) * self.train
        return ((drawn < plan.rate) & self.train).astype(np.int64)

    def follow(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """The node of a tree that each row reaches, and its value."""
        own = self.model[self.model["tree"] == tree]
        at, value = np.ones(len(self), np.int64), np.zeros(len(self))
        if not len(own):
            return at, value
        value[:] = own["left"][own["node"] == 0][0]
        size = int(own["node"].max()) + 1
        feature, cut, left, right = np.full(2 * size + 2, -1), np.zeros(size), np.zeros(size), np.zeros(size)
        feature[own["node"]], cut[own["node"]] = own["feature"], own["bin"]
        left[own["node"]], right[own["node"]] = own["left"], own["right"]
        for _ in range(self.plan.depth):
            go = np.flatnonzero(feature[np.minimum(at, 2 * size + 1)] >= 0)
            if not len(go):
                break
            node = at[go]
            up = self.bins[go, feature[node]] > cut[node]
            value[go] = np.where(up, right[node], left[node])
            at[go] = 2 * node + up
        return at, value

    def predictions(self, trees: int) -> np.ndarray:
        """Of the first ``trees`` trees, about the middle."""
        total = np.zeros(len(self))
        for tree in range(trees):
            total += self.follow(tree)[1] * (self.plan.step_size if self.plan.boosted and tree else 1.0)
        return total if self.plan.boosted else total / max(trees, 1)

    def targets(self, tree: int) -> np.ndarray:
        """What a tree learns, as whole numbers, so that sums do not depend on their order."""
        target = self.y
        if self.plan.boosted and tree:
            rest = self.y - self.predictions(tree)
            if self.plan.absolute:
                return np.where(rest < 0, -1, 1) * _UNIT
            target = 2 * rest
        return np.rint(target * self.scale).astype(np.int64)


_SPLIT = np.dtype([("tree", np.int32), ("node", np.int32), ("feature", np.int32), ("bin", np.int32), ("left", np.float64), ("right", np.float64)])
#: the absolute loss learns signs, in these units
_UNIT = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _looked_at(plan: _Plan, tree: int, nodes: np.ndarray, p: int) -> np.ndarray:
    """Which features a node may split on: (nodes, p) of bool."""
    if plan.chosen >= p:
        return np.ones((len(nodes), p), bool)
    name = (np.uint64(plan.seed) << np.uint64(40)) + (np.uint64(tree) << np.uint64(24))
    drawn = _mix(_mix(nodes.astype(np.uint64) + name)[:, None] + np.arange(1, p + 1, dtype=np.uint64))
    return drawn.argsort(axis=1).argsort(axis=1) < plan.chosen


_HISTOGRAM = "tree int, node int, feature int, bin int, w bigint, s bigint"


def _histograms(trees: range, level: int, p: int, plan: _Plan, key_type: pa.DataType):
    """For the nodes of a level: the weight and the sum of targets in each bin of each feature looked at."""
    kinds = [pa.int32()] * 4 + [pa.int64()] * 2
    schema = pa.schema([("key", key_type), *zip("tree node feature bin w s".split(), kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _single(batches):
            block, found = _Block(row, p, plan), []
            for tree in trees:
                at, _ = block.follow(tree)
                weight = block.weights(tree)
                here = np.flatnonzero((at >= 1 << level) & (weight > 0))
                if not len(here):
                    continue
                nodes, place = np.unique(at[here], return_inverse=True)
                w, target = weight[here], block.targets(tree)[here] * weight[here]
                # two halves, each of which adds up exactly as a double
                high, low = (target >> 20).astype(float), (target & 0xFFFFF).astype(float)
                looked = _looked_at(plan, tree, nodes, p)
                for f in range(p):
                    use = looked[place, f]
                    spot = place[use] * 256 + block.bins[here[use], f]
                    count = np.bincount(spot, w[use])
                    sums = (np.bincount(spot, high[use]).astype(np.int64) << 20) + np.bincount(spot, low[use]).astype(np.int64)
                    some = np.flatnonzero(count)
                    found.append((np.full(len(some), tree), nodes[some >> 8], np.full(len(some), f), some & 255, count[some].astype(np.int64), sums[some]))
            if found:
                columns = [np.concatenate(c) for c in zip(*found)]
                keys = row.column("key").take(pa.array(np.zeros(len(columns[0]), np.int64)))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, k in zip(columns, kinds)]], schema=schema)

    return run


def _errors(p: int, plan: _Plan, key_type: pa.DataType):
    """Of the held-out rows of a block: their number, and the sums of labels, their squares, and squared errors."""
    names = ["n", "y", "yy", "e"]
    schema = pa.schema([("key", key_type), *[(c, pa.float64()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _single(batches):
            block = _Block(row, p, plan)
            test = ~block.train
            y, error = block.y[test], (block.y - block.predictions(plan.trees))[test]
            columns = [pa.array([float(v)], pa.float64()) for v in (test.sum(), y.sum(), y @ y, error @ error)]
            yield pa.RecordBatch.from_arrays([row.column("key"), *columns], schema=schema)

    return run


# ---------------------------------------------------------------- growing


def _with_model(blocks: DataFrame, splits: list[DataFrame], rows: int) -> DataFrame:
    """Blocks with the trees of their key; few enough splits are broadcast, so that no block moves."""
    if not splits:
        return blocks.withColumn("model", F.lit(None).cast(_MODEL))
    model = reduce(DataFrame.unionAll, splits).groupBy(F.col("key").alias("of")).agg(
        F.collect_list(F.struct("tree", "node", "feature", "bin", "left", "right")).cast(_MODEL).alias("model")
    )
    if rows <= BROADCAST_SPLITS:
        model = F.broadcast(model)
    return blocks.join(model, F.col("key") == F.col("of"), "left").drop("of")


_MODEL = "array<struct<tree:int,node:int,feature:int,bin:int,left:double,right:double>>"


def _grow(blocks: DataFrame, info: DataFrame, p: int, params: TreeParams, plan: _Plan) -> tuple[list[DataFrame], int]:
    """The splits of all trees of all keys: ``key, tree, node, feature, bin, left, right``, and their number.

    Each pass gathers the histograms of one level in one aggregation, of all
    keys and (in a forest) all trees; so the number of jobs grows with the
    depth, not with the keys.  Node 1 is a root, nodes 2i and 2i + 1 are the
    children of node i; the row of node 0 has the root's value.  Sums are whole
    numbers, so every layout finds the same splits.
    """
    key_type = to_arrow_type(blocks.schema["key"].dataType)
    ddl = f"key {blocks.schema['key'].dataType.simpleString()}, {_HISTOGRAM}"
    splits: list[DataFrame] = []
    rows = 0
    for trees in [range(t, t + 1) for t in range(plan.trees)] if plan.boosted else [range(plan.trees)]:
        # what a target of 1 is as a whole number
        unit = F.lit(float(_UNIT)) if plan.absolute and trees[0] else F.col("scale")
        for level in range(max(plan.depth, 1)):
            found = _with_model(blocks, splits, rows).mapInArrow(_histograms(trees, level, p, plan, key_type), ddl)
            sums = found.groupBy("key", "tree", "node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
            of_feature = Window.partitionBy("key", "tree", "node", "feature")
            below = of_feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            cut = sums.select(
                "key", "tree", "node", "feature", "bin",
                *[F.sum(c).over(below).alias(f"{c}l") for c in "ws"], *[F.sum(c).over(of_feature).alias(c) for c in "ws"],
            ).join(info.select("key", "n", unit.alias("unit")), "key")
            left, right = F.col("sl") * F.col("sl").cast("double") / F.col("wl"), F.col("s") - F.col("sl")
            right = right * right.cast("double") / F.col("wr")
            cut = cut.withColumn("wr", F.col("w") - F.col("wl"))
            parted = cut.where(F.col("wr") > 0).withColumns(
                {"parts": left + right, "gain": left + right - F.col("s") * F.col("s").cast("double") / F.col("w")}
            )
            least = F.greatest(F.lit(params.min_instances_per_node), F.col("n") * params.min_weight_fraction_per_node)
            enough = (F.col("wl") >= least) & (F.col("wr") >= least) & (F.col("gain") > F.col("parts") * _NO_GAIN)
            enough &= F.col("gain") / F.col("w") / F.col("unit") ** 2 >= params.min_info_gain
            value = lambda s, w: (F.col(s) / F.col(w) / F.col("unit")).alias(s)
            parted = parted.where(enough).select(
                "key", "tree", "node", "feature", "bin", "gain", value("sl", "wl"),
                ((F.col("s") - F.col("sl")) / F.col("wr") / F.col("unit")).alias("sr"),
            )
            best = parted.groupBy("key", "tree", "node").agg(
                F.max(F.struct("gain", -F.col("feature"), -F.col("bin"), F.col("sl"), F.col("sr"))).alias("b")
            )
            new = best.select(
                "key", "tree", "node", (-F.col("b.col2")).alias("feature"), (-F.col("b.col3")).alias("bin"),
                F.col("b.sl").alias("left"), F.col("b.sr").alias("right"),
            )
            if not level:
                roots = cut.groupBy("key", "tree").agg(F.max("w").alias("w"), F.max("s").alias("s"), F.max("unit").alias("unit"))
                none = F.lit(-1)
                roots = roots.select(
                    "key", "tree", F.lit(0).alias("node"), none.alias("feature"), none.alias("bin"),
                    (F.col("s") / F.col("w") / F.col("unit")).alias("left"), F.lit(0.0).alias("right"),
                )
                new = roots.unionAll(new) if plan.depth else roots
            new = stored(new, "splits")
            splits.append(new)
            found = new.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("node") > 0).alias("here")).first()
            rows += found["rows"]
            if not found["here"]:
                break
    return splits, rows


def _fit_all(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    keys: Sequence[Any] | None,
    id_cols: Sequence[str],
    params: TreeParams,
    plan: _Plan,
    nulls: str,
) -> DataFrame:
    check_columns(key, features, label)
    p, kind = len(features), df.schema[key].dataType
    key_type, ddl = to_arrow_type(kind), kind.simpleString()
    wanted = None if keys is None else list(dict.fromkeys(keys))
    rows = df if wanted is None else restrict_keys(df, key, wanted)
    names = list(dict.fromkeys([key, *id_cols, *features, label]))
    # the place in the split is taken from the ids as they are stored
    placed = rows.where(F.col(key).isNotNull()).withColumns(
        {"_train": row_hash(df, id_cols) < params.train_split * MODULUS, "_id": F.xxhash64(*id_cols)}
    )
    rows = complete_rows(placed.select(*names, "_train", "_id"), [*features, label], nulls)
    flat = rows.select(
        F.col(key).alias("key"), "_id", "_train", *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)],
        F.col(label).cast("double").alias("_y"),
    )

    # what is known of a key: its training rows, the middle of its labels, and the unit that makes them whole numbers
    ends = flat.groupBy("key").agg(
        F.sum(F.col("_train").cast("bigint")).alias("n"), F.min("_y").alias("low"), F.max("_y").alias("high")
    )
    half = F.col("high") / 2 - F.col("low") / 2
    half = F.when(half > 1e-280, half).otherwise(F.lit(1.0))
    # of 62 bits those that count rows (and their weights) are taken
    bits = F.least(F.lit(40), F.lit(56) - F.ceil(F.log2(F.col("n") + 1)))
    unit = F.pow(F.lit(2.0), bits)
    known = stored(
        ends.where("n > 0").select("key", "n", (F.col("low") / 2 + F.col("high") / 2).alias("middle"), (unit / half).alias("scale")), "keys"
    )
    share = F.pmod(F.xxhash64(F.lit("cuts"), "_id"), F.lit(1 << 30)) < F.lit(float(SAMPLED_ROWS << 30)) / F.col("n")
    sampled = flat.where("_train").join(known, "key").where(share)
    # the sample of a small key might be empty of rows only if it has none
    cuts = sampled.drop("_id", "_train", "_y", "n", "middle", "scale").groupBy("key").applyInArrow(
        _split_values("key", key_type, p, params.max_bins), f"key {ddl}, cuts array<array<double>>"
    )
    info = stored(known.join(cuts, "key"), "cuts")
    n_keys = info.count()
    small = F.broadcast(info) if n_keys * p * params.max_bins <= BROADCAST_SPLITS else info

    # ranges of (key, id) part a large key among tasks and keep the rows of a small one together
    dealt = flat.repartitionByRange("key", "_id").sortWithinPartitions("key", "_id")
    raw = dealt.mapInArrow(_to_blocks(key_type, p), f"key {ddl}, ids binary, train binary, x binary, y binary")
    blocks = stored(
        raw.join(small, "key").mapInArrow(_to_bins(key_type, p), f"key {ddl}, ids binary, train binary, bins binary, y binary, scale double"),
        "blocks",
    )
    splits, count = _grow(blocks, info, p, params, plan)
    errors = _with_model(blocks, splits, count).mapInArrow(_errors(p, plan, key_type), f"key {ddl}, n double, y double, yy double, e double")
    total = errors.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy", "e")])
    spread = F.col("yy") / F.col("n") - (F.col("y") / F.col("n")) ** 2
    some = F.col("n") > 0
    result = stored(
        total.select(
            F.col("key").alias(key),
            F.col("n").cast("bigint").alias("test_n"),
            F.when(some, F.sqrt(F.col("e") / F.col("n"))).alias("rmse"),
            F.when(some & (spread > 0), 1 - F.col("e") / F.col("n") / spread).alias("r2"),
        ),
        "quality",
    )
    discard(blocks, known, info, *splits)
    return result if wanted is None else for_keys(result, wanted, key).drop("ord")
