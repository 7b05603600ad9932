"""Spelling variants: words one edit apart, by composing finite-state machines.

The vocabulary is a minimised acyclic acceptor V.  Composing V with a one-edit
transducer and with V again accepts exactly the pairs of words that differ by
one inserted, deleted or replaced code point.  A path of the composition reads
a common prefix, takes one edit arc, and then reads the same rest on both
sides; so the edit is where the two words first differ, and each pair has one
such path.

The composition is cut at its initial states.  States whose words are too many
for one task are *opened*: their arcs become initial states of their own, with
an acceptor per state, each built and composed inside one task.  The edit arcs
that leave an opened state are enumerated by a grouping in Spark: after such an
arc both sides read the same rest, so the words meet at (prefix, rest).  A
group holds at most one word per letter and the word without one, whatever the
size of the vocabulary.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter, _count_elements
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.spread import drop, keep, text_of

#: runs of Latin letters; U+00D7 and U+00F7 lie in the range and count
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: 1 of so many (document, run) pairs loses a code point
DAMAGE_EVERY = 97
#: a word's form is at least so many times as frequent
FORM_FACTOR = 2
#: words of one initial state
STATE_WORDS = 4000
_FLUSH = 300_000


# ---------------------------------------------------------------- counting


def damaged_runs(doc_id: str, runs: list[str], every: int | None) -> list[str]:
    """The runs of a document, of which 1 of ``every`` distinct ones has lost a code point, as its checksum says."""
    if not every:
        return runs
    seed = zlib.crc32(f"{doc_id}:".encode())
    changed = {}
    for run in set(runs):
        h = zlib.crc32(run.encode(), seed)
        if h % every == 0:
            at = h % len(run)
            changed[run] = run[:at] + run[at + 1 :]
    return [changed.get(run, run) for run in runs] if changed else runs


def _count(every: int | None, least_length: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    find = re.compile(RUN).findall

    def flushed(counts: Counter) -> pa.RecordBatch:
        kept = [(word, n) for word, n in counts.items() if len(word) >= least_length]
        words, numbers = zip(*kept) if kept else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(numbers, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            bodies = batch.column(1).cast(pa.binary())
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                runs = find(bodies[i].as_py().lower().decode("utf-8", "replace"))  # bytes lower A-Z alone
                _count_elements(counts, damaged_runs(doc_id, runs, every))
                if len(counts) >= _FLUSH:
                    yield flushed(counts)
                    counts = Counter()
        if counts:
            yield flushed(counts)

    return run


def vocabulary(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    damage_every: int | None = DAMAGE_EVERY,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``word`` and ``n`` of all runs, counted within tasks before the shuffle; a null text has none, a null id reads as empty."""
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))
    counted = source.mapInArrow(_count(damage_every, least_length), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- machines


class Acceptor:
    """The minimal deterministic acceptor of a sorted list of words: equal right languages are one state."""

    _FEW = 64

    def __init__(self, words: list[str], skip: int = 0):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        self._tails: dict[int, frozenset[str]] = {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * max(map(len, words), default=0)))
        self.start = self._state(words, 0, len(words), skip)

    def _state(self, words: list[str], low: int, high: int, depth: int) -> int:
        final = len(words[low]) == depth
        at, arcs = low + final, {}
        while at < high:
            letter, to = words[at][depth], at + 1
            while to < high and words[to][depth] == letter:
                to += 1
            arcs[letter] = self._state(words, at, to, depth + 1)
            at = to
        key = (final, *arcs.items())
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.size.append(final + sum(self.size[s] for s in arcs.values()))
        return state

    def tails(self, state: int) -> frozenset[str]:
        """The right language of a state."""
        known = self._tails.get(state)
        if known is None:
            found = [""] if self.final[state] else []
            for letter, to in self.arcs[state].items():
                found += [letter + tail for tail in self.tails(to)]
            known = frozenset(found)
            if len(known) <= self._FEW:
                self._tails[state] = known
        return known

    def common(self, p: int, q: int) -> frozenset[str] | list[str]:
        """The words that both right languages hold: the product of the two machines."""
        if p == q:
            return self.tails(p)
        if self.size[p] <= self._FEW and self.size[q] <= self._FEW:
            return self.tails(p) & self.tails(q)
        found = [""] if self.final[p] and self.final[q] else []
        first, second = self.arcs[p], self.arcs[q]
        for letter in first.keys() & second.keys():
            found += [letter + tail for tail in self.common(first[letter], second[letter])]
        return found

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of tails whose edit arc leaves this state: they differ in their first code point."""
        found, arcs = [], self.arcs[state]
        letters = list(arcs)
        for i, a in enumerate(letters):
            for b in letters[i + 1 :]:
                found += [(a + tail, b + tail) for tail in self.common(arcs[a], arcs[b])]
            # the letter a is read on one side alone; the other side goes on from here
            inner = self.arcs[arcs[a]]
            if self.final[state] and self.final[arcs[a]]:
                found.append((a, ""))
            for b in inner.keys() & arcs.keys():
                if b != a:
                    found += [(a + b + tail, b + tail) for tail in self.common(inner[b], arcs[b])]
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs of accepted words that one edit parts, each once."""
        edits: dict[int, list[tuple[str, str]]] = {}
        stack = [(self.start, "")]
        while stack:
            state, prefix = stack.pop()
            own = edits.get(state)
            if own is None:
                own = edits[state] = self.edits(state)
            for x, y in own:
                yield prefix + x, prefix + y
            stack += [(to, prefix + letter) for letter, to in self.arcs[state].items() if self.size[to] > 1]


_PAIR = "word string, n bigint, near string, near_n bigint"


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (state, word, n), sorted: an acceptor and its composition for each initial state."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def composed(state: str, counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        words = list(counts)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for x, y in Acceptor(words, len(state)).pairs() if len(words) > 1 else ():
            x, y = state + x, state + y
            for one, other in ((x, y), (y, x)):
                for column, value in zip(out, (one, counts[one], other, counts[other])):
                    column.append(value)
            if len(out[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                out = ([], [], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    now, counts = None, {}
    for batch in batches:
        for state, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if state != now:
                if counts:
                    yield from composed(now, counts)
                now, counts = state, {}
            counts[word] = n
    if counts:
        yield from composed(now, counts)


# ---------------------------------------------------------------- in Spark


def initial_states(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """Add ``cut``: the length of the prefix that is the word's initial state.

    A state with more than ``state_words`` words is opened, that is, its words
    take one more letter; a word that ends there is a state of its own.  The
    rounds end with the longest prefix that so many words share.
    """
    words = keep(words.withColumn("cut", F.lit(0)), "states")
    while True:
        prefix = F.substring("word", F.lit(1), F.col("cut"))
        open_ = F.col("cut") <= F.length("word")
        sized = words.where(open_).groupBy(prefix.alias("_state"), F.col("cut").alias("_cut")).count()
        full = keep(sized.where(F.col("count") > state_words).select("_state", "_cut"), "opened")
        if full.isEmpty():
            drop(full)
            return words
        at = full.withColumn("_more", F.lit(1))
        condition = (prefix == F.col("_state")) & (F.col("cut") == F.col("_cut"))
        deeper = words.join(at, condition, "left").withColumn("cut", F.col("cut") + F.coalesce("_more", F.lit(0)))
        new = keep(deeper.select("word", "n", "cut"), "states")
        drop(words, full)
        words = new


def near_words(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """All ordered pairs of distinct words one edit apart: ``word, n, near, near_n``.

    ``words`` has distinct words and their counts.
    """
    stated = initial_states(words.select("word", "n"), state_words)
    # edit arcs of opened states: the words meet at (prefix, rest after the arc)
    depth = F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("d")
    opened = stated.where("cut > 0").select("word", "n", depth).where(F.col("d") <= F.length("word"))
    head = F.substring("word", F.lit(1), F.col("d"))
    after = lambda skip: F.substring(F.col("word"), F.col("d") + 1 + skip, F.length("word"))
    letter = F.substring("word", F.col("d") + 1, F.lit(1))
    read = opened.where(F.col("d") < F.length("word")).select(
        "d", F.concat(head, after(1)).alias("rest"), F.struct(F.lit(True).alias("read"), letter.alias("letter"), "word", "n").alias("side")
    )
    unread = opened.select(
        "d", F.col("word").alias("rest"), F.struct(F.lit(False).alias("read"), letter.alias("letter"), "word", "n").alias("side")
    )
    # at most one word per letter, and one that reads none
    met = read.union(unread).groupBy("d", "rest").agg(F.collect_list("side").alias("sides")).where(F.size("sides") > 1)
    both = met.select("sides", F.explode("sides").alias("a")).select("a", F.explode("sides").alias("b"))
    differ = (F.col("a.letter") != F.col("b.letter")) & (F.col("a.read") | F.col("b.read"))
    across = both.where(differ).select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))
    # states that were not opened
    state = F.substring("word", F.lit(1), F.col("cut"))
    closed = stated.where(F.col("cut") <= F.length("word")).select(state.alias("state"), "word", "n")
    dealt = closed.repartition("state").sortWithinPartitions("state", "word")
    return across.union(dealt.mapInArrow(_compose, _PAIR))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word with a form, by pointer doubling: rounds grow with the logarithm of the longest chain.

    Counts grow along a chain by ``FORM_FACTOR`` each time, so a chain is short and has no cycle.
    """
    reach = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reach.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        joined = reach.join(onward, reach.root == onward["_at"], "left")
        new = keep(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        drop(reach)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        reach = keep(new.select("word", "root"), "roots")
        drop(new)


def spelling_variants(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    damage_every: int | None = DAMAGE_EVERY,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    state_words: int = STATE_WORDS,
) -> DataFrame:
    """Every word with its variants: ``word, n, n_near, form, form_n, root``.

    Words are runs of Latin letters, lower-cased in A-Z alone, of which 1 of
    ``damage_every`` (document, run) pairs loses a code point (None: none
    does); they have at least ``least_length`` code points and ``least_count``
    occurrences.  ``n_near`` counts the words one edit away.  ``form`` is the
    most frequent of these (of equally frequent ones the first in code-point
    order), if it occurs at least twice as often, else null; ``root`` is where
    the forms of forms end.  Null and empty texts have no words, repeated rows
    count again, an empty table gives no rows, other columns are not read.
    """
    words = keep(
        vocabulary(docs, id_col=id_col, text_col=text_col, damage_every=damage_every, least_length=least_length, least_count=least_count),
        "words",
    )
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    nears = near_words(words, state_words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= FORM_FACTOR * F.col("n")
    found = keep(
        nears.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")),
        "near",
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return words.join(found, "word", "left").join(roots, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )
