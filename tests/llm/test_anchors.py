"""Difference-cover anchors against brute force."""

import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arealis.llm import anchors

DOC = "doc_id long, text string, lang string"


def brute(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    low = {}
    for i, words in texts:
        for j in range(len(words) - window + 1 if i is not None else 0):
            low[tuple(words[j : j + window])] = min(low.get(tuple(words[j : j + window]), i), i)
    out = []
    for i, words in texts:
        gone = [False] * len(words)
        for j in range(len(words) - window + 1 if i is not None else 0):
            if low[tuple(words[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def corpus(seed, window, n=60):
    """Texts with shared passages at every shift, just long enough and just too short."""
    rng = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(window + rng.randrange(-2, 2 * window))] for k in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 2 * window))]
            passage = rng.choice(passages)
            start = rng.randrange(0, 4)
            words += passage[start : len(passage) - rng.randrange(0, 4)]
        rows.append((rng.randrange(n), rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("window", [1, 2, 4, 12, 50])
def test_removal_equals_brute_force(spark, window):
    rows = corpus(window, window)
    df = spark.createDataFrame([(*r, "x") for r in rows], DOC).repartition(5)
    assert result(anchors.remove_repeats(df, window=window, chunk_bytes=2000)) == brute(rows, window)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.text("ab ", max_size=40)), min_size=1, max_size=12))
def test_two_words_repeat_everywhere(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], DOC)
    assert result(anchors.remove_repeats(df, window=5, chunk_bytes=50)) == brute(rows, 5)


def test_every_shift_shares_an_anchor():
    for period, cover in anchors.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    for window in range(1, 120):
        period, cover = anchors.cover_of(window)
        assert window - period + 1 >= 1 and max(cover) < period


def test_odd_rows(spark):
    """Nulls, empty and very long texts, equal ids, repeated rows, no id, clashing columns."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long + " tail"), (5, long + " tail"), (6, "é " * 70), (7, "é " * 71),
        (8, shared), (8, shared + " own"), (9, shared + " own"), (9, "a " + shared), (None, shared), (None, None), (10, shared),
    ]
    names = "chunk ids first second low high kind value row least most tag anchor n sizes".split()
    df = spark.createDataFrame([(*r, "x") for r in rows], DOC).select("*", *[F.lit("kept").alias(x) for x in names])
    got = anchors.remove_repeats(df.repartition(3), chunk_bytes=10_000, with_text=True)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    assert result(got) == brute(rows, 50)
    by = {r["kept_sha256"]: r["kept"] for r in got.collect()}
    assert all(hashlib.sha256(kept.encode()).hexdigest() == digest for digest, kept in by.items())
    # equal ids are one source: neither row of 8 loses what the other holds
    assert {(r["doc_id"], r["n_removed"]) for r in got.collect() if r["doc_id"] in (8, None)} == {(8, 0), (None, 0)}


def test_copies_of_one_text(spark):
    """A text that a third of all rows repeat is one row a chunk."""
    rows = [(i, " ".join(f"c{j}" for j in range(80))) for i in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOC).repartition(8)
    got = anchors.remove_repeats(df, chunk_bytes=4000)
    assert result(got) == brute(rows, 50)
    assert got.agg(F.sum("n_removed")).first()[0] == 299 * 80


def test_empty_table_text_ids_and_wrong_windows(spark):
    empty = spark.createDataFrame([], DOC)
    assert anchors.remove_repeats(empty).collect() == []
    words = " ".join(f"t{j}" for j in range(55))
    named = spark.createDataFrame([("b", words), ("a", words + " x"), ("ab", "y " + words)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in anchors.remove_repeats(named).collect()} == {"a": 0, "ab": 55, "b": 55}
    with pytest.raises(ValueError):
        anchors.remove_repeats(empty, window=0)
