"""Every tier is packed into windows of its own length."""

import collections

import numpy as np
import pytest

from arealis.llm import packing

WINDOWS = packing.WINDOWS


def brute(lengths):
    """Sequences as lists of (document, start, length), by searching all rests for each step."""
    longest, out = WINDOWS[-1], []
    rests = []
    for doc, n in enumerate(lengths):
        for k in range(n // longest):
            out.append((longest, [(doc, k * longest, longest)]))
        if n % longest:
            rests.append((n % longest, doc, n - n % longest))
    for window in reversed(WINDOWS):
        while rests and max(rests)[0] > (window // 2 if window > WINDOWS[0] else 0):
            taken = [max(rests)]
            rests.remove(taken[0])
            gap = window - taken[0][0]
            while gap and rests:
                fitting = [r for r in rests if r[0] <= gap]
                if fitting:
                    n, doc, start = max(fitting)
                    rests.remove((n, doc, start))
                else:
                    whole = min(rests)
                    rests.remove(whole)
                    n, doc, start = gap, whole[1], whole[2]
                    rests.append((whole[0] - gap, doc, start + gap))
                taken.append((n, doc, start))
                gap -= n
            out.append((window if not gap else None, [(doc, start, n) for n, doc, start in taken]))
    return out


@pytest.mark.parametrize("seed, most", [(1, 60), (2, 300), (3, 1500), (4, 9000), (5, 2048)])
def test_fill_order_equals_brute_force(seed, most):
    lengths = np.random.default_rng(seed).integers(1, most, 300)
    pieces, padded = packing.Packer(WINDOWS).pack(lengths)
    got = collections.defaultdict(list)
    for doc, start, n, sequence, _ in pieces.tolist():
        got[sequence].append((doc, start, n))
    want = brute(lengths.tolist())
    closed = [p for w, p in want if w]
    assert [got[s] for s in range(len(closed))] == closed
    assert padded[: len(closed)].tolist() == [w for w, _ in want if w]
    # only what was left at the very end is closed otherwise
    assert sum(w is None for w, _ in want) <= 1 and padded.sum() - lengths.sum() < WINDOWS[-1]


def test_every_tier_gives_sequences_of_its_own():
    rng = np.random.default_rng(7)
    lengths = np.exp(rng.uniform(0, np.log(2048), 20_000)).astype(int)
    pieces, padded = packing.Packer(WINDOWS).pack(lengths)
    count = collections.Counter(padded.tolist())
    assert set(count) >= set(WINDOWS) and all(count[w] > 100 for w in WINDOWS)
    # a sequence starts with a document of its own tier, and documents are rarely cut
    first = pieces[pieces[:, 4] == 0]
    own = lengths[first[:, 0]]
    assert (own[:-1] <= padded[first[:-1, 3]]).all()
    assert (np.bincount(pieces[:, 0]) > 1).mean() < 0.2


def test_short_documents_stay_in_short_windows():
    lengths = np.random.default_rng(8).integers(1, 60, 50_000)
    _, padded = packing.Packer(WINDOWS).pack(lengths)
    assert (padded == 64).mean() > 0.99
    steps = packing.step_groups(np.ones(len(padded)), padded, 8 * 2048)
    load = np.bincount(steps, padded)
    assert load.max() - load.min() <= 64
