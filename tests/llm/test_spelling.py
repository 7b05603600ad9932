"""Composed acceptors against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arealis.llm import spelling

DOC = "doc_id long, text string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, every=97, least_length=5, least_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n, len(near[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items()}


def result(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def texts(seed, n=900):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(4, 9))) for _ in range(25)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 40)):
            w = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["a", "b", "", "ç"])
            words.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((rng.randrange(50), rng.choice([" ", ", ", "-1-"]).join(words)))
    return rows


@pytest.mark.parametrize("state_words", [1, 3, 20, 4000])
def test_variants_equal_brute_force(spark, state_words):
    rows = texts(1)
    df = spark.createDataFrame(rows, DOC).repartition(4)
    want = brute(brute_words(rows))
    assert sum(v[1] for v in want.values()) > 100 and any(v[4] not in (w, v[2]) for w, v in want.items())
    assert result(spelling.spelling_variants(df, state_words=state_words)) == want


@settings(max_examples=40, deadline=None)
@given(words=st.sets(st.text("abc", max_size=6), min_size=1, max_size=60))
def test_composition_accepts_each_pair_once(words):
    pairs = [frozenset(p) for p in spelling.Acceptor(sorted(words)).pairs()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


@settings(max_examples=40, deadline=None)
@given(words=st.sets(st.text("ab", max_size=7), min_size=1, max_size=80))
def test_acceptor_is_minimal(words):
    machine = spelling.Acceptor(sorted(words))
    assert machine.tails(machine.start) == words
    languages = [machine.tails(s) for s in range(len(machine.arcs))]
    assert len(set(languages)) == len(languages)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words=st.sets(st.text("ab", max_size=5), min_size=1, max_size=40), state_words=st.integers(1, 8))
def test_opened_states_lose_no_pair(spark, words, state_words):
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(words))], "word string, n long")
    got = [(r["word"], r["near"]) for r in spelling.near_words(df, state_words).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_odd_rows(spark):
    """Nulls, empty texts, a very long run, repeated rows, ties, other scripts, clashing columns."""
    long = "a" * 3000
    rows = [
        (None, "vier vierr vierr"), (1, None), (2, ""), (3, long), (3, long), (4, long), (5, long[1:]), (6, long[1:]), (7, long[1:]),
        (8, "Ünïcödé ünïcödé ünïcödé ünïcöde"), (9, "слово слово слово × ÷×÷×÷ ÷×÷×÷ ÷×÷×÷"), (9, "tiger tiger tiger tigel tigel tigel"),
    ] + [(10 + i, "tigers tigers aacab aacab baker") for i in range(5)]
    df = spark.createDataFrame(rows, DOC).select("*", *[F.lit(1).alias(c) for c in "word n id near form root state cut d".split()])
    for every in (97, 3, None):
        counts = brute_words(rows, every)
        assert result(spelling.spelling_variants(df, damage_every=every, state_words=2)) == brute(counts)
    assert "÷×÷×÷" in brute_words(rows, None)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert spelling.spelling_variants(empty).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, "a b c")], DOC)).collect() == []


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, form string")
    assert {tuple(r) for r in spelling._roots(forms).collect()} == {(f"w{i}", "w40") for i in range(40)}
