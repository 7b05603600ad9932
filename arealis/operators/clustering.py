"""Clustering of entities by their scaled features.

The library's estimators draw their starting points by partition, and sum by
partition; so the layout of the rows is part of what a fit depends on.  Here it
is a parameter: ``partitions`` parts by a hash of the entity's key, each sorted
by key.  With it and the seed a fit is the same on any cluster, whatever the
input's files or the session's shuffle settings.  Give a large table as many
partitions as the cluster has cores, or a multiple.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.operators.features import as_vector, prepare_features
from arealis.operators.stages import drop_incomplete, select_features
from arealis.sources.stored import discard, stored

PARTITIONS = 8
#: entities of a partition in a topic model, some seconds a pass
_TOPIC_ROWS = 20_000
#: directed edges of a graph in a partition
_EDGES_PER_PARTITION = 2_000_000
#: what the degree of a vertex without weight counts as
_LEAST_DEGREE = 2.0**-52


@dataclass(frozen=True)
class Clustering:
    """``predictions`` has a row per entity; ``components`` one per cluster."""

    predictions: DataFrame
    components: DataFrame
    summary: dict[str, float]


def _check(k: int, max_iter: int) -> None:
    if k < 2:
        raise ValueError("k must be at least 2")
    if max_iter < 1:
        raise ValueError("max_iter must be at least 1")


def _prepared(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Scaled features by key; the input is evaluated once and stored, then read for its bounds, the fit and the predictions."""
    rows = drop_incomplete(select_features(df, key, features), [key, *features])
    return prepare_features(stored(rows, "entities"), key, features)


def _laid_out(prepared: DataFrame, key: str, partitions: int) -> DataFrame:
    """The pinned layout: parts by a hash of the key."""
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    part = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    return prepared.repartitionById(partitions, part)


@contextmanager
def _points(prepared: DataFrame, key: str, partitions: int):
    """Feature vectors in the pinned layout, kept while a model is fitted."""
    laid_out = _laid_out(prepared, key, partitions).sortWithinPartitions(key, "features")
    points = as_vector(laid_out).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield points
    finally:
        points.unpersist()


def _predict(model: Any, prepared: DataFrame, key: str) -> DataFrame:
    return model.transform(as_vector(prepared)).select(key, "prediction")


def _centers(df: DataFrame, model: Any) -> DataFrame:
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "cluster int, center array<double>")


def kmeans(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    k: int,
    *,
    max_iter: int = 20,
    seed: int = 1,
    partitions: int = PARTITIONS,
) -> Clustering:
    """k-means; components: cluster, center (on the [0, 1] scale)."""
    _check(k, max_iter)
    prepared = _prepared(df, key, features)
    with _points(prepared, key, partitions) as points:
        model = KMeans(k=k, maxIter=max_iter, seed=seed).fit(points)
    summary = {"training_cost": model.summary.trainingCost, "iterations": float(model.summary.numIter)}
    return Clustering(_predict(model, prepared, key), _centers(df, model), summary)


def bisecting_kmeans(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    k: int,
    *,
    max_iter: int = 20,
    seed: int = 1,
    partitions: int = PARTITIONS,
) -> Clustering:
    """Bisecting k-means; components: cluster, center (on the [0, 1] scale)."""
    _check(k, max_iter)
    prepared = _prepared(df, key, features)
    with _points(prepared, key, partitions) as points:
        model = BisectingKMeans(k=k, maxIter=max_iter, seed=seed).fit(points)
    summary = {"training_cost": model.summary.trainingCost}
    return Clustering(_predict(model, prepared, key), _centers(df, model), summary)


def gaussian_mixture(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    k: int,
    *,
    max_iter: int = 100,
    seed: int = 1,
    partitions: int = PARTITIONS,
) -> Clustering:
    """Gaussian mixture; components: cluster, weight, mean, covariance."""
    _check(k, max_iter)
    prepared = _prepared(df, key, features)
    with _points(prepared, key, partitions) as points:
        model = GaussianMixture(k=k, maxIter=max_iter, seed=seed).fit(points)
    rows = [
        (
            i,
            float(weight),
            [float(v) for v in gaussian.mean],
            [[float(v) for v in row] for row in gaussian.cov.toArray()],
        )
        for i, (weight, gaussian) in enumerate(zip(model.weights, model.gaussians))
    ]
    components = df.sparkSession.createDataFrame(
        rows, "cluster int, weight double, mean array<double>, covariance array<array<double>>"
    )
    summary = {"log_likelihood": model.summary.logLikelihood, "iterations": float(model.summary.numIter)}
    return Clustering(_predict(model, prepared, key), components, summary)


def lda(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    k: int,
    *,
    max_iter: int = 20,
    seed: int = 1,
    partitions: int | None = None,
) -> Clustering:
    """Topic mixture of each entity, its scaled features taken as term weights.

    Every iteration reads all entities.  An entity takes long, so without
    ``partitions`` their number grows with the entities (from ``PARTITIONS``
    on), in the fit and in the predictions; the fit still depends on the data alone.  predictions: key, topic_distribution, prediction (the topic with the
    largest share); components: topic, terms, weights; summary: log_likelihood
    and log_perplexity.
    """
    _check(k, max_iter)
    prepared = _prepared(df, key, features)
    if partitions is None:
        partitions = max(PARTITIONS, math.ceil(prepared.count() / _TOPIC_ROWS))
    with _points(prepared, key, partitions) as corpus:
        model = LDA(k=k, maxIter=max_iter, seed=seed, subsamplingRate=1.0).fit(corpus)
        likelihood = model.logLikelihood(corpus)
    # the library's perplexity is the likelihood by the sum of all weights, but would find the likelihood again
    weights = prepared.agg(F.sum(F.aggregate("features", F.lit(0.0), lambda acc, v: acc + v))).first()[0]
    summary = {"log_likelihood": likelihood, "log_perplexity": -likelihood / weights if weights else math.nan}
    topics = model.transform(as_vector(_laid_out(prepared, key, partitions))).select(
        key, vector_to_array("topicDistribution").alias("topic_distribution")
    )
    predictions = topics.withColumn(
        "prediction",
        (F.array_position("topic_distribution", F.array_max("topic_distribution")) - 1).cast("int"),
    )
    components = model.describeTopics(len(features)).select(
        F.col("topic").cast("int").alias("topic"),
        F.transform("termIndices", lambda i: F.get(F.array(*[F.lit(f) for f in features]), i)).alias("terms"),
        F.col("termWeights").alias("weights"),
    )
    return Clustering(predictions, components, summary)


def power_iteration(
    edges: DataFrame, src: str, dst: str, weight: str, k: int, *, max_iter: int = 20, seed: int = 1, partitions: int = PARTITIONS
) -> DataFrame:
    """Cluster the vertices of a weighted similarity graph: id, cluster.

    Power iteration clustering: a vector over the vertices is replaced by the
    weighted means over their neighbours until its change settles, then
    clustered by k-means.  The start is normal, by a hash of seed and id.  The
    edges are laid out by one end once; a pass shuffles the vector and the sums.
    """
    _check(k, max_iter)
    spark = edges.sparkSession
    # the two directions of an edge, and its repeats, are one edge
    low, high = F.least(src, dst).cast("bigint"), F.greatest(src, dst).cast("bigint")
    total = F.sum(F.col(weight).cast("double"))
    merged = stored(
        edges.where(F.col(src) != F.col(dst))
        .groupBy(low.alias("src"), high.alias("dst"))
        .agg(F.when((total >= 0) & (total < math.inf), total).otherwise(F.raise_error(F.lit("weights must be finite and at least 0"))).alias("weight")),
        "edges",
    )
    both = merged.select(F.col("src").alias("end"), F.col("dst").alias("from"), "weight").unionAll(
        merged.select(F.col("dst").alias("end"), F.col("src").alias("from"), "weight")
    )
    uniform = [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 52)) / float(1 << 52) for i in range(2)]
    normal = F.sqrt(-2 * F.log(1 - uniform[0])) * F.cos(2 * math.pi * uniform[1])
    degrees = both.groupBy(F.col("end").alias("id")).agg(F.sum("weight").alias("degree"))
    vector = stored(degrees.select("id", "degree", normal.alias("value")), "vector")
    first = vector.agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("value")).alias("norm")).first()
    if not first["n"]:
        return vector.select("id", F.lit(0).alias("cluster"))
    norm, tol = first["norm"], max(1e-5 / first["n"], 1e-8)

    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * merged.count() / _EDGES_PER_PARTITION))
    by_from = both.repartition(width, "from").sortWithinPartitions("from").persist(StorageLevel.MEMORY_AND_DISK)
    change, tables = 0.0, [vector]
    try:
        for _ in range(max_iter):
            now = vector.select("id", "degree", (F.col("value") / F.lit(norm)).alias("value"))
            given = by_from.join(now.select(F.col("id").alias("from"), "value"), "from")
            sums = given.groupBy(F.col("end").alias("id")).agg(F.sum(F.col("weight") * F.col("value")).alias("sum"))
            mean = F.col("sum") / F.greatest("degree", F.lit(_LEAST_DEGREE))
            passed = stored(sums.join(now, "id").select("id", "degree", mean.alias("value"), F.col("value").alias("before")), "vector")
            tables.append(passed)
            size = passed.agg(F.sum(F.abs("value"))).first()[0]
            if not size:
                break
            vector, norm = passed, size
            before, change = change, vector.agg(F.sum(F.abs(F.col("value") / F.lit(norm) - F.col("before")))).first()[0]
            if abs(change - before) <= tol:
                break
    finally:
        by_from.unpersist()
    prepared = vector.select("id", F.array(F.col("value") / F.lit(norm)).alias("features"))
    with _points(prepared, "id", partitions) as points:
        model = KMeans(k=k, maxIter=20, seed=0).fit(points)
    discard(merged, *[t for t in tables if t is not vector])
    return _predict(model, prepared, "id").select("id", F.col("prediction").cast("int").alias("cluster"))
