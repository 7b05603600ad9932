"""The learned operators against plain implementations on small corpora: deleted interpolation, logistic chains, one shuffle."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.llm import lm, toxicity

DOC = "doc_id long, text string"


# ---------------------------------------------------------------- 1


def grams(words, order):
    """For each token its n-grams of all orders, and the contexts (None at the beginning of the text)."""
    line = ["<s>"] * (order - 1) + words
    for i in range(order - 1, len(line)):
        yield [tuple(line[i - k + 1 : i + 1]) for k in range(1, order + 1)], [None if i == order - 1 else tuple(line[i - k : i]) for k in range(1, order)]


def bucket(n):
    return min(math.frexp(n)[1], lm.BUCKETS - 1)


def by_hand(rows, train, dev, order):
    texts = {i: (t or "").lower().split() + ["</s>"] for i, t in rows}

    def count(ids):
        counts = collections.Counter()
        for i in ids:
            for found, _ in grams(texts[i], order):
                counts.update(found)
        return counts

    def parts(found, contexts, counts, n_texts, n_tokens):
        c = [counts[g] for g in found]
        x = [n_tokens] + [n_texts if g is None else counts[g] for g in contexts]
        return c, x

    kept = [i for i in train if i not in dev]
    counts = count(kept)
    unigrams = {g: n for g, n in counts.items() if len(g) == 1}
    n_tokens, n_words = sum(unigrams.values()), len(unigrams)
    weights = collections.defaultdict(lambda: 0.5)
    for _ in range(lm.ROUNDS):
        used, reached = collections.Counter(), collections.Counter()
        for i in dev:
            for found, contexts in grams(texts[i], order):
                c, x = parts(found, contexts, counts, len(kept), n_tokens)
                p, share = 1 / (n_words + 1), []
                for k in range(order):
                    w = weights[k, bucket(x[k])] if x[k] else 0.0
                    own = w * c[k] / max(x[k], 1)
                    p = own + (1 - w) * p
                    share.append(own / p)
                reach = 1.0
                for k in reversed(range(order)):
                    used[k, bucket(x[k])] += reach * share[k]
                    reached[k, bucket(x[k])] += reach
                    reach *= 1 - share[k]
        for key, n in reached.items():
            if key[1]:
                weights[key] = (used[key] + 1) / (n + 2)
    counts = count(train)
    unigrams = {g: n for g, n in counts.items() if len(g) == 1}
    n_tokens, n_words = sum(unigrams.values()), len(unigrams)
    out = {}
    for i, words in texts.items():
        total = 0.0
        for found, contexts in grams(words, order):
            c, x = parts(found, contexts, counts, len(train), n_tokens)
            p = 1 / (n_words + 1)
            for k in range(order):
                w = weights[k, bucket(x[k])] if x[k] else 0.0
                p = w * c[k] / max(x[k], 1) + (1 - w) * p
            total += math.log10(p)
        out[i] = total
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_mixture_and_em_equal_a_plain_model(spark, order):
    rng = random.Random(order)
    phrases = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(2, 6))) for _ in range(15)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(rng.randrange(0, 7)))) for i in range(70)] + [(70, None), (71, "unseen WORDS here")]
    rows.append((3, "w1 w2"))  # an id twice
    df = spark.createDataFrame(rows, DOC).select("*", *[F.lit(1).alias(c) for c in "chunk kind ids roles role score id range k".split()])
    unique = {i: t for i, t in rows if i != 3}
    held = F.pmod(F.xxhash64(F.lit("held out"), F.col("doc_id")), F.lit(4)) == 0
    dev = {r["doc_id"] for r in df.where(held & (F.col("doc_id") % 5 != 0)).select("doc_id").collect()}
    got = collections.defaultdict(list)
    for r in lm.score_corpus(df, F.col("doc_id") % 5 != 0, order=order, dev_every=4, chunk_bytes=300, range_bytes=500).collect():
        got[r.doc_id].append(r.score)
    # rows of one id are texts of their own: number them for the plain model
    named = list(enumerate(t for _, t in rows))
    ids = [i for i, _ in rows]
    want = by_hand(named, [n for n, i in enumerate(ids) if i % 5], {n for n, i in enumerate(ids) if i in dev}, order)
    expected = collections.defaultdict(list)
    for n, score in want.items():
        expected[ids[n]].append(score)
    assert set(got) == set(expected) == {*unique, 3}
    for i in expected:
        assert sorted(got[i]) == pytest.approx(sorted(expected[i]), rel=1e-9)


# ---------------------------------------------------------------- 5


def dense_logistic(x, y, penalty):
    """Ridge logistic regression by Newton steps on dense matrices; the constant, last, is hardly penalised."""
    w = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(share / (1 - share))
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-12:
            break
    return w


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sparse_fit_equals_the_dense_one(seed):
    rng = np.random.default_rng(seed)
    n, v, m = 300, 25, 2
    sets = [np.flatnonzero(rng.random(v) < 0.2) for _ in range(n)]
    extra = rng.random((n, m))
    truth = rng.standard_normal(v)
    y = (np.array([truth[s].sum() for s in sets]) + extra @ [1.0, -2.0] + rng.standard_normal(n) > 0).astype(float)
    row, column = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    x = np.zeros((n, v + m + 1))
    x[row, column], x[:, v:-1], x[:, -1] = 1, extra, 1
    got = toxicity.fit_logistic(row, column, extra, y, v, rounds=60)
    want = dense_logistic(x, y, toxicity.PENALTY)
    assert np.abs(1 / (1 + np.exp(-(x @ got))) - 1 / (1 + np.exp(-(x @ want)))).max() < 1e-4


def test_the_chain_learns_from_out_of_fold_probabilities(spark):
    """The whole chain rebuilt with dense models, fold by fold."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(240):
        poor = rng.random() < 0.4
        toxic = rng.random() < (0.7 if poor else 0.1)
        words = [f"plain{rng.randrange(8)}" for _ in range(5)] + ["shoddy"] * (poor and rng.random() < 0.8) + ["vile"] * (toxic and rng.random() < 0.7)
        docs.append((i, " ".join(words)))
        labels.append((i, int(poor), int(toxic)))
    frame = spark.createDataFrame(docs, DOC)
    known = spark.createDataFrame(labels, "doc_id long, poor int, toxic int")
    chain = toxicity.fit_chain(frame, known, ["poor", "toxic"])
    fold = {r["doc_id"]: r["f"] for r in frame.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id").cast("string")), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    folds = np.array([fold[i] for i, _ in docs])

    # the words that stand out, by the same rule
    sets = [set(t.split()) for _, t in docs]
    y = np.array([row[1:] for row in labels], float)
    own = []
    for c in range(2):
        p = (y[:, c].sum() + 0.5) / (len(y) + 1)
        chosen = []
        for word in sorted(set().union(*sets)):
            has = np.array([word in s for s in sets])
            z = abs(y[has, c].sum() - has.sum() * p) / math.sqrt(has.sum() * p * (1 - p))
            if has.sum() >= toxicity.LEAST_TEXTS and z >= toxicity.LEAST_Z:
                chosen.append(word)
        own.append(chosen)
    assert own[0] and own[1] and len(chain.words) == len(set(own[0]) | set(own[1]))
    earlier = np.empty((len(docs), 0))
    probabilities = np.empty((len(docs), 0))
    for c in range(2):
        x = np.column_stack([*[[float(w in s) for s in sets] for w in own[c]], earlier, np.ones(len(docs))])
        out = np.zeros(len(docs))
        for k in range(toxicity.FOLDS):
            w = dense_logistic(x[folds != k], y[folds != k, c], toxicity.PENALTY)
            out[folds == k] = 1 / (1 + np.exp(-(x[folds == k] @ w)))
        w = dense_logistic(x, y[:, c], toxicity.PENALTY)
        # new texts see the final models' probabilities
        new = np.column_stack([*[[float(v in s) for s in sets] for v in own[c]], probabilities, np.ones(len(docs))])
        probabilities = np.column_stack([probabilities, 1 / (1 + np.exp(-(new @ w)))])
        earlier = np.column_stack([earlier, out])
    got = {r["doc_id"]: (r["p_poor"], r["p_toxic"]) for r in toxicity.score_toxicity(frame, chain).collect()}
    assert np.abs(np.array([got[i] for i, _ in docs]) - probabilities).max() < 1e-3
