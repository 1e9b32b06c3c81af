"""Filled batches against the sequential rule: first fit, commonest anchors first."""

import random
from collections import Counter, defaultdict

import pytest

from turnweave.operators import pairs


def first_fit(order, size):
    """Sizes of batches when every pair goes to the first that has room and not its anchor."""
    batches = []
    for anchor in order:
        for b in batches:
            if len(b) < size and anchor not in b:
                b.add(anchor)
                break
        else:
            batches.append({anchor})
    return sorted(map(len, batches), reverse=True)


def sizes(counts, size):
    counts = sorted(counts, reverse=True)
    taken, left, places = pairs.peel(counts[:size], sum(counts), size)
    full, rest = divmod(left, places)
    last = max([full + (rest > 0), *counts[:taken]])
    return [sum(c > t for c in counts[:taken]) + (places if t < full else rest if t == full else 0) for t in range(last)]


def test_as_full_as_first_fit():
    rng = random.Random(1)
    equal = 0
    for _ in range(400):
        size = rng.randint(2, 8)
        counts = [rng.randint(1, 3) for _ in range(rng.randint(1, 25))] + [rng.randint(5, 40)] * rng.randint(0, 1)
        order = [a for a in sorted(range(len(counts)), key=lambda a: -counts[a]) for _ in range(counts[a])]
        mine, theirs = sorted(sizes(counts, size), reverse=True), first_fit(order, size)
        assert sum(mine) == sum(theirs) and len(mine) <= len(theirs)
        # batches of one are dropped: a remainder of one pair is the most that is lost more
        assert sum(n for n in mine if n > 1) >= sum(n for n in theirs if n > 1) - 1
        equal += mine == theirs
    assert equal > 340


@pytest.mark.parametrize("size", [2, 4, 7])
def test_batches(spark, size):
    rng = random.Random(size)
    for hot in (0, 45):
        rows = [(f"a{rng.randint(0, 30)}", f"c{i}") for i in range(90)] + [("hot", f"h{i}") for i in range(hot)] + [(None, "n1"), (None, "n2")]
        found = pairs.filled_anchor_batches(spark.createDataFrame(rows, "anchor string, candidate string"), size).collect()
        batches = defaultdict(list)
        for r in found:
            batches[r.batch].append(r.anchor)
        assert all(len(b) == len(set(b)) <= size and len(b) > 1 for b in batches.values())
        want = Counter(n for n in sizes(list(Counter(a for a, _ in rows).values()), size) if n > 1)
        assert Counter(map(len, batches.values())) == want
        assert len({(r.anchor, r.candidate) for r in found}) == len(found) == sum(n * k for n, k in want.items())
    assert pairs.filled_anchor_batches(spark.createDataFrame([], "anchor string, candidate string"), size).collect() == []
