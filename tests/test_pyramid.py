"""Points in boxes and nearest points by the pyramid, against full comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrovia.operators import network, pyramid


def crowd(seed=3, n=3000):
    """Nine tenths of the points in one cell of a hundredth of a degree, some in one place, others over the globe."""
    rng = np.random.default_rng(seed)
    city = np.array([116.395, 39.905]) + rng.random((n * 9 // 10, 2)) * 0.008
    city[: n // 5] = city[0]
    return np.concatenate([city, rng.uniform([-180, -90], [180, 90], (n // 10, 2))]).round(7)


def boxes_of(rng, points):
    centres = np.concatenate([points[rng.integers(0, len(points), 80)], rng.uniform([-180, -90], [180, 90], (20, 2))])
    half = 10.0 ** rng.uniform(-5, 1.5, (len(centres), 2))
    half[:10] = 0.0  # a box of one point
    half[10:14] = [40.0, 0.0005]  # long and thin, across the city
    return [(i, float(x - w), float(x + w), float(y - h), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(centres.tolist(), half.tolist()))]


@pytest.mark.parametrize("most", [40, 100_000])
def test_boxed_equals_full_comparison(spark, most):
    points = crowd()
    boxes = boxes_of(np.random.default_rng(9), points)
    rows = [(i, *xy, i % 3) for i, xy in enumerate(points.tolist())] + [(-1, None, 1.0, 0), (-2, 1.0, None, 0)]
    df = spark.createDataFrame(rows, "id long, lng double, lat double, kind int")
    asked = spark.createDataFrame([*boxes, (999, None, 1.0, 1.0, 1.0)], "box int, west double, east double, south double, north double")
    inside = {(b, i) for b, w, e, s, n in boxes for i in np.flatnonzero((points[:, 0] >= w) & (points[:, 0] <= e) & (points[:, 1] >= s) & (points[:, 1] <= n)).tolist()}
    got = [(r.box, r.id) for r in pyramid.boxed(asked, df, most=most).select("box", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == inside and len(inside) > 20_000
    own = pyramid.boxed(asked.withColumn("kind", F.lit(1)), df, ["kind"], most=most)
    assert {(r.box, r.id) for r in own.collect()} == {x for x in inside if x[1] % 3 == 1}


def test_boxed_of_nothing(spark):
    none = spark.createDataFrame([], "id long, lng double, lat double")
    box = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0)], "box int, west double, east double, south double, north double")
    assert pyramid.boxed(box, none).count() == 0 and pyramid.boxed(box.limit(0), none).count() == 0
    assert pyramid.boxed(box.limit(0), spark.createDataFrame([(1, 0.5, 0.5)], none.schema)).columns == ["box", "west", "east", "south", "north", "id", "lng", "lat"]


def test_no_key_of_the_join_is_hot(spark):
    """Nine tenths of the points lie in one cell, a fifth in one place, and as many boxes: keys stay near the bound on both sides."""
    points = crowd(n=6000)
    df = spark.createDataFrame([(i, *xy) for i, xy in enumerate(points.tolist())], "id long, lng double, lat double")
    asked = pyramid.around(df.where("id % 2 = 0").select("lng", "lat", F.col("id").alias("place")), 0.05)
    sides = pyramid.dealt(asked, df, most=256)
    fullest = [x.groupBy(*pyramid.KEY).count().agg(F.max("count")).first()[0] for x in sides]
    assert max(fullest) < 1.5 * 256  # chunks are dealt by a hash
    points_of = sides[1].groupBy(*pyramid.KEY[:3]).agg(F.count_distinct("id").alias("n"))
    assert points_of.agg(F.max("n")).first()[0] >= 1080  # one place can't be split, only dealt


def test_near_operators_on_a_crowd(spark):
    points = crowd(n=1500)
    points = points[(points[:, 0] > 60) & (np.abs(points[:, 1]) < 70)]
    rng = np.random.default_rng(2)
    places = np.concatenate([points[::40] + rng.normal(size=(len(points[::40]), 2)) * 0.02, [[0.0, 0.0], [116.4, 39.95]]])
    rows = spark.createDataFrame([(f"r{i % 4}", i, *xy) for i, xy in enumerate(points.tolist())], "route string, idx long, lng double, lat double")
    named = spark.createDataFrame([(f"p{i}", *xy) for i, xy in enumerate(places.tolist())], "place string, lng double, lat double")
    got = {(r.place, r.route): r.km for r in network.routes_near_point(named, rows).collect()}
    want = {}
    for i, (x, y) in enumerate(places):
        km = np.hypot((points[:, 1] - y) * 111, (points[:, 0] - x) * 111 * np.cos(np.radians(y)))
        for k in range(4):
            if km[k::4].min() < 15:
                want[f"p{i}", f"r{k}"] = km[k::4].min()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nearest_node_equals_full_comparison(spark):
    points = crowd(n=900)
    rng = np.random.default_rng(6)
    places = np.concatenate([points[::50], points[::70] + rng.normal(size=(len(points[::70]), 2)) * 0.3, rng.uniform([-180, -90], [180, 90], (30, 2)), [[-179.9, 89.0]]])
    named = spark.createDataFrame([(f"p{i}", *xy) for i, xy in enumerate(places.tolist())] + [("none", None, 1.0)], "name string, lng double, lat double")
    nodes = spark.createDataFrame(points.tolist() + points[:5].tolist(), "lng double, lat double")
    got = {r.name: (r.degrees, r.lng, r.lat) for r in network.nearest_node(named, nodes).collect()}
    assert len(got) == len(places)
    for i, (x, y) in enumerate(places):
        d = np.sqrt((points[:, 0] - x) ** 2 + (points[:, 1] - y) ** 2)
        best = min(zip(d.tolist(), points[:, 0].tolist(), points[:, 1].tolist()))
        assert abs(got[f"p{i}"][0] - best[0]) < 1e-12 and got[f"p{i}"][1:] == best[1:]
    assert network.nearest_node(named, nodes.limit(0)).count() == 0
