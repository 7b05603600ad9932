"""Toxicity categories by a classifier chain of linear models.

The categories are predicted one after the other: the model of a category sees
the words of a text and the probabilities of all earlier categories.  While it
is trained, those probabilities are out-of-fold: each comes from a model that
has not seen the row, as it will be for new texts.

Words count once per text, and only those that stand out in some category take
part.  Training uses at most ``max_rows`` labelled rows, chosen by a hash of
the id; each fold is one task.  Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm import tokens
from arealis.llm.spread import id_filter, keep, passes, place_column, text_of

#: bound on the labelled rows that train the chain
MAX_ROWS = 20_000
#: standard deviations by which a word's share of a category must differ from the average, and the texts it needs
LEAST_Z, LEAST_TEXTS = 5.0, 5
FOLDS = 3
PENALTY = 0.1


@dataclass
class Chain:
    """Linear models by category: weights of the words, then of the earlier categories' probabilities, then a constant."""

    categories: list[str]
    words: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, features: Sequence[np.ndarray]) -> np.ndarray:
        """One row per text, one column per category, from each text's word numbers."""
        n = len(features)
        row = np.repeat(np.arange(n), [len(f) for f in features])
        column = np.concatenate([np.empty(0, np.int64), *features]).astype(np.int64)
        out = np.empty((n, 0))
        for w in self.weights:
            v = len(self.words)
            score = np.bincount(row, w[:v][column], n) + out @ w[v:-1] + w[-1]
            out = np.column_stack([out, _sigmoid(score)])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(row, column, extra: np.ndarray, y: np.ndarray, n_words: int, penalty: float = PENALTY, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression on sparse 0/1 words and dense ``extra`` columns; Newton steps by conjugate gradients.

    The constant is not penalised.  A category with one value only gets its
    smoothed share.
    """
    n, m = len(y), extra.shape[1]
    share = (y.sum() + 0.5) / (n + 1.0)
    w = np.zeros(n_words + m + 1)
    w[-1] = np.log(share / (1 - share))
    if n == 0 or y.min() == y.max():
        return w
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6

    def times(v):
        return np.bincount(row, v[:n_words][column], n) + extra @ v[n_words:-1] + v[-1]

    def back(r):
        return np.concatenate([np.bincount(column, r[row], n_words), extra.T @ r, [r.sum()]])

    def loss(v):
        s = times(v)
        return np.logaddexp(0, s).sum() - y @ s + 0.5 * (ridge * v * v).sum()

    now = loss(w)
    for _ in range(rounds):
        p = _sigmoid(times(w))
        residual = back(y - p) - ridge * w
        if np.abs(residual).max() < 1e-6 * n:
            break
        curve = p * (1 - p)
        step, r = np.zeros_like(w), residual.copy()
        d, rr = r.copy(), r @ r
        for _ in range(30):
            q = back(curve * times(d)) + ridge * d
            a = rr / (d @ q)
            step += a * d
            r -= a * q
            new = r @ r
            if new < 1e-8 * (residual @ residual):
                break
            d, rr = r + new / rr * d, new
        scale = 1.0
        while (then := loss(w + scale * step)) > now and scale > 1e-4:
            scale /= 2
        if then > now:
            break
        w, now = w + scale * step, then
    return w


def _word_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The ascending distinct word hashes of each text."""
    data, offsets = tokens.flatten(column)
    for a, b in tokens.slices(offsets):
        at = offsets[a : b + 1]
        part = tokens.LOWER[data[at[0] : at[-1]]]
        starts, ends, bounds = tokens.find_words(part, at - at[0], tokens.ALPHANUMERIC)
        words = tokens.hash_words(part, starts, ends)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            yield tokens.distinct(words[lo:hi])


def _sample_words(bits: np.ndarray):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits, batch.column("place").to_numpy(zero_copy_only=False))))
            if len(batch):
                words = [w.tobytes() for w in _word_sets(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["id", "words"])

    return run


def _count_words(categories: int):
    """For each word the texts that hold it, and of these the ones in each category."""

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
            labels = np.array(batch.column("labels").to_pylist(), np.float64).reshape(-1, categories)
            if not sets:
                continue
            known, place = np.unique(np.concatenate(sets), return_inverse=True)
            text = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            counts = [np.bincount(place, labels[text, c], len(known)).astype(np.int64) for c in range(categories)]
            n = np.bincount(place, minlength=len(known)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(known.view(np.int64)), pa.array(n), *map(pa.array, counts)],
                names=["word", "n", *[f"c{c}" for c in range(categories)]],
            )

    return run


def _features(words: np.ndarray, batch_sets: Iterator[np.ndarray]) -> list[np.ndarray]:
    out = []
    for own in batch_sets:
        at = np.searchsorted(words, own)
        at[at == len(words)] = 0
        out.append(at[words[at] == own] if len(words) else at[:0])
    return out


def _to_features(words: np.ndarray):
    def run(batches):
        for batch in batches:
            sets = (np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist())
            found = [x.astype(np.int32) for x in _features(words, sets)]
            rest = [batch.column(c) for c in ("id", "labels", "fold")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(found, pa.list_(pa.int32())), pa.array([[]] * len(batch), pa.list_(pa.float64()))],
                names=["id", "labels", "fold", "features", "earlier"],
            )

    return run


_ROW = "id string, labels array<double>, fold int, features array<int>, earlier array<double>"


def _train(category: int, own: np.ndarray, folds: int):
    """Model k < folds learns from the other folds and gives its own fold a probability; the last one learns from all.

    Only the words in ``own``, which stand out in this category, take part.
    """
    n_words = len(own)
    schema = pa.schema([("id", pa.string()), ("labels", pa.list_(pa.float64())), ("fold", pa.int32()), ("features", pa.list_(pa.int32())), ("earlier", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64()))])

    def run(table: pa.Table) -> pa.Table:
        model = table.column("model")[0].as_py()
        table = table.sort_by("id").combine_chunks()  # sums in one order, whatever the shuffle's
        column = lambda name: table.column(name).combine_chunks()
        n, fold = len(table), column("fold").to_numpy()
        features = column("features")
        row = np.repeat(np.arange(n), features.value_lengths().to_numpy())
        word = features.flatten().to_numpy()
        earlier = column("earlier").flatten().to_numpy().reshape(n, category)
        y = column("labels").flatten().to_numpy().reshape(n, -1)[:, category]
        use = fold != model
        mine = own[word] & use[row]
        place = np.cumsum(use) - 1
        w = fit_logistic(place[row[mine]], word[mine], earlier[use], y[use], n_words)
        if model == folds:
            return pa.Table.from_pylist([{"weights": w.tolist()}], schema)
        score = np.bincount(row, w[word], n) + earlier @ w[n_words:-1] + w[-1]
        told = np.column_stack([earlier, _sigmoid(score)])[~use]
        out = table.filter(pa.array(~use)).select(["id", "labels", "fold", "features"])
        bounds = np.arange(len(told) + 1, dtype=np.int32) * (category + 1)
        out = out.append_column("earlier", pa.ListArray.from_arrays(bounds, pa.array(told.ravel())))
        return out.append_column("weights", pa.nulls(len(told), pa.list_(pa.float64()))).cast(schema)

    return run


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
    folds: int = FOLDS,
) -> Chain:
    """Learn ``categories``, columns of ``labels`` with 0 or 1, in their order.

    Rows with a null id or label and labels without a text are not used.  An
    id that is labelled more than once is in a category if any row says so; of
    several texts under one id that with the smallest word hashes counts.  Of
    more than ``max_rows`` labelled ids about so many are drawn, by a hash of
    the id.  Words take part whose share in a category departs from chance
    (``LEAST_Z`` deviations, ``LEAST_TEXTS`` texts), all of them.  Without
    labelled rows the chain gives 0.5 to every text.
    """
    valued = labels.select(F.col(id_col).cast("string").alias("id"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(categories)])
    known = valued.na.drop().groupBy("id").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))])
    known = known.select("id", F.array(*[f"c{i}" for i in range(len(categories))]).alias("labels"))
    share = min(1.0, max_rows / max(known.count(), 1))
    order = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 30))
    known = known.where(order < int(share * (1 << 30)))
    known = keep(known.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col("id")), F.lit(folds)).cast("int")), "labels")
    bits = id_filter(known, "id")
    texts = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"), place_column("id").alias("place"))
    texts = texts.where("id is not null").mapInArrow(_sample_words(bits), "id string, words binary")
    sample = keep(texts.join(known, "id").groupBy("id", "labels", "fold").agg(F.min("words").alias("words")), "sample")

    n = len(categories)
    counted = sample.mapInArrow(_count_words(n), "word bigint, n bigint, " + ", ".join(f"c{c} bigint" for c in range(n)))
    counted = keep(
        counted.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(f"c{c}").alias(f"c{c}") for c in range(n)])
        .where(F.col("n") >= LEAST_TEXTS),
        "words",
    )
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("labels")[c]).alias(f"c{c}") for c in range(n)]).first()
    chosen: list[set[int]] = []
    for c in range(n):
        p = ((totals[f"c{c}"] or 0) + 0.5) / (totals["n"] + 1)
        z = F.abs((F.col(f"c{c}") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p)))
        chosen.append({r["word"] for r in counted.where(z >= LEAST_Z).select("word").collect()})
    words = np.sort(np.array(sorted(set().union(*chosen)), np.int64).view(np.uint64))
    own_words = [np.isin(words, np.array(sorted(x), np.int64).view(np.uint64)) for x in chosen]

    chain = Chain(list(categories), words)
    rows = keep(sample.mapInArrow(_to_features(words), _ROW), "rows")
    for c in range(n):
        models = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds))))
        trained = keep(
            models.repartitionById(folds + 1, F.col("model")).groupBy("model").applyInArrow(_train(c, own_words[c], folds), f"{_ROW}, weights array<double>"), "trained"
        )
        fitted = trained.where("weights is not null").select("weights").first()
        empty = np.zeros(len(words) + c + 1)
        chain.weights.append(np.array(fitted["weights"]) if fitted else empty)
        rows = trained.where("weights is null").drop("weights")
    return chain


def _score(chain: Chain):
    def run(batches):
        for batch in batches:
            p = chain.probabilities(_features(chain.words, _word_sets(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *[pa.array(np.ascontiguousarray(p[:, c])) for c in range(len(chain.categories))]],
                names=["row", *[f"p{c}" for c in range(len(chain.categories))]],
            )

    return run


def score_toxicity(docs: DataFrame, chain: Chain, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` for every category of the chain; columns of these names are replaced.

    Null and empty texts have no words and get the probability of a text
    without any known word.
    """
    names = [f"p_{c}" for c in chain.categories]
    columns = [c for c in docs.columns if c not in names]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text_of(text_col).alias("text"))
    ddl = f"row {source.schema['row'].dataType.simpleString()}, " + ", ".join(f"p{c} double" for c in range(len(names)))
    scored = source.mapInArrow(_score(chain), ddl)
    return scored.select(*[F.col("row")[c].alias(c) for c in columns], *[F.col(f"p{i}").alias(n) for i, n in enumerate(names)])


def reject_toxic(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` without those whose probability of the last category is above ``threshold``."""
    chain = fit_chain(docs, labels, categories, **options)
    scored = score_toxicity(docs, chain, text_col=options.get("text_col", "text"))
    return scored.where(F.col(f"p_{categories[-1]}") <= threshold).select(docs.columns)
