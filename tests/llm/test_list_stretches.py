"""Verification reads of each list only the stretch of sets that may be linked."""

import numpy as np
import pytest

from slicewright.llm import jaccard_join


def some_sets(r):
    base = r.integers(0, 1 << 62, 90).astype(np.uint64)
    made = [np.unique(np.append(base[: int(r.integers(20, 90))], r.integers(0, 1 << 62, int(r.integers(0, 6))).astype(np.uint64))) for _ in range(60)]
    return sorted(made, key=lambda s: (len(s), s.tobytes()))


@pytest.mark.parametrize("threshold", [60, 80, 90])
def test_links_of_a_tile(threshold):
    for seed in range(8):
        sets = some_sets(np.random.default_rng(seed))
        link = [[100 * (k := len(np.intersect1d(x, y))) >= threshold * (len(x) + len(y) - k) for y in sets] for x in sets]
        spanning, linked = jaccard_join._links(sets, [0] * len(sets), False, [1] * len(sets), threshold)
        assert linked == [sum(row) - 1 for row in link]
        assert all(link[a][b] for a, b in spanning)


def test_what_is_read(monkeypatch):
    sets, read = some_sets(np.random.default_rng(1)), []
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, minlength: read.append(x) or count(x, minlength=minlength))
    jaccard_join._links(sets, [0] * len(sets), False, [1] * len(sets), 90)
    sizes = np.array([len(s) for s in sets])
    assert read
    for x in read:
        assert not len(x) or 90 * sizes[x.max()] <= 100 * sizes[x.min()] + 90
