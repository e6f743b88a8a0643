"""Walks by parts against the walks in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrovia.operators import scans, trajectories


def _points(seed, routes=4, n=300):
    rng, rows = np.random.default_rng(seed), []
    for r in range(routes):
        step = rng.choice([0.0, 0.0001, 0.0002, 0.0006], (n, 2)) * rng.choice([-1, 1], (n, 2), p=[0.3, 0.7])
        step[100:160] = 0  # stands still over whole parts
        rows += [(f"R{r}", i, float(x), float(y)) for i, (x, y) in enumerate(np.round(np.cumsum(step, axis=0) + 100, 6))]
    return rows


@pytest.mark.parametrize("part_rows", [40, 10_000])
def test_simplify_points(spark, part_rows):
    rows = [*_points(1), ("one", 5, 1.0, 2.0), ("two", 1, 1.0, 2.0), ("two", 2, 1.0, 2.0)]
    got = scans.simplify_points(spark.createDataFrame(rows, "route string, idx long, lng double, lat double"), part_rows=part_rows)
    want = []
    for route in {x[0] for x in rows}:
        xy = trajectories.simplified(np.array([x[2:] for x in sorted(rows) if x[0] == route]))
        want += [(route, i, *p) for i, p in enumerate(xy.tolist())]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert scans.simplify_points(spark.createDataFrame([], "route string, idx long, lng double, lat double")).count() == 0


@pytest.mark.parametrize("part_rows", [25, 10_000])
def test_rebuild_points(spark, part_rows):
    """Ways that jump, turn, repeat and have second tracks; one route with few of them, one along the other axis."""
    rng, rows = np.random.default_rng(7), []
    for r in range(4):
        for i in range(8 if r == 3 else 80):
            at = np.array([100.0, 30.0]) + (np.array([0.004, 0.001]) if r % 2 else np.array([0.001, 0.004])) * i
            n = int(rng.integers(2, 7))
            way = np.round(at + np.cumsum(rng.uniform(0, 0.001, (n, 2)), axis=0), 6)
            way = way[::-1] if rng.random() < 0.5 else way
            rows.append((f"R{r}", len(rows), way))
            if rng.random() < 0.3:
                rows.append((f"R{r}", len(rows), np.round(way + rng.uniform(-0.0008, 0.0008, 2), 6)))
            if rng.random() < 0.1:
                rows.append((f"R{r}", len(rows), way[::-1]))
    rows.append(("short", 0, np.array([[1.0, 2.0]])))
    data = [(r, o, [tuple(map(float, p)) for p in way]) for r, o, way in rows]
    lines = spark.createDataFrame(data, f"route string, ord long, points {trajectories.POINTS}")
    want = trajectories.rebuild_from_lines(lines).select("route", F.posexplode("points").alias("at", "p")).select("route", "at", "p.lng", "p.lat")
    want = sorted(map(tuple, want.collect()))
    assert len({x[0] for x in want}) == 4
    assert sorted(map(tuple, scans.rebuild_points(lines, part_rows=part_rows).collect())) == want
