"""Merging of sub-lines by a grid of free ends, against the walk over all of them."""

import time

import numpy as np
import pytest

from ferrovia.operators import trajectories as t


def walked(lines, threshold_km):
    """Every end is looked at in every round."""
    out, left = lines[0], list(lines[1:])
    while left:
        starts, ends = np.array([x[0] for x in left]), np.array([x[-1] for x in left])
        ways = np.stack([t.km_between(out[-1], starts), t.km_between(out[-1], ends), t.km_between(out[0], ends), t.km_between(out[0], starts)])
        way, i = np.unravel_index(int(ways.argmin()), ways.shape)
        if not ways[way, i] < threshold_km:
            break
        line = left.pop(i)
        line = line if way in (0, 2) else line[::-1]
        out = np.concatenate([out, line[1:]] if way < 2 else [line[:-1], out])
    return out


def made(rng, n, kind):
    if kind == "chain":  # pieces of a line in any order and direction, some apart
        xy = np.stack([100 + np.cumsum(rng.random(n * 4 + 1)) * 0.01, 30 + rng.normal(size=n * 4 + 1) * 0.01], 1)
        lines = [xy[4 * i : 4 * i + 5] for i in range(n)]
    elif kind == "scatter":
        lines = [rng.uniform([90, -20], [110, 70], 2) + np.cumsum(rng.normal(size=(int(rng.integers(2, 7)), 2)) * 0.3, axis=0) for _ in range(n)]
    else:  # ends on a coarse lattice: many ties, loops and lines of one point
        lines = [np.round(rng.uniform([100, 30], [101, 31], (int(rng.integers(1, 4)), 2)), 1) for _ in range(n)]
    return [x[::-1] if rng.random() < 0.5 else x for x in (lines[i] for i in rng.permutation(n))]


@pytest.mark.parametrize("kind", ["chain", "scatter", "lattice"])
@pytest.mark.parametrize("threshold", [0.5, 10.0, 100.0, 2000.0])
def test_grid_equals_walk(kind, threshold):
    rng = np.random.default_rng(17)
    for n in (1, 2, 3, 10, 60, 200):
        lines = made(rng, n, kind)
        assert np.array_equal(t.attached(lines, threshold), walked(lines, threshold)), (n, kind, threshold)


def test_very_many_sub_lines():
    rng = np.random.default_rng(5)
    lines = made(rng, 100_000, "chain")
    start = time.time()
    out = t.attached(lines, 10.0)
    assert len(out) >= 100_000 and time.time() - start < 120  # minutes to hours when each round looks at every end
