"""Places near lines looked up by every task, against the pyramid; tables kept as columns."""

import numpy as np

from ferrovia.operators import near, network, segments
from ferrovia.sources import stored


def rails(spark):
    rng = np.random.default_rng(5)
    rows = []
    for r in range(6):
        way = np.cumsum(rng.normal([0.004, 0.0], 0.004, (700, 2)), axis=0) + [100, 30 + r * 0.05]
        rows += [(f"R{r}", i, float(x), float(y)) for i, (x, y) in enumerate(way)]
    places = [(f"p{i}", float(100 + rng.uniform(0, 3)), float(30 + rng.uniform(-0.2, 0.5))) for i in range(60)]
    return spark.createDataFrame(rows, "route string, idx long, lng double, lat double").repartition(5), spark.createDataFrame(places, "name string, lng double, lat double")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_every_way_finds_the_same(spark, monkeypatch):
    points, places = rails(spark)
    asked = places.withColumnRenamed("name", "place")
    ways = lambda chunk: [rows_of(segments.nearby_vertices(asked, points, 15.0, chunk=chunk)), rows_of(network.stations_on_route(places, points)), rows_of(network.routes_near_point(asked, points))]
    whole, cut = ways(near.CHUNK), ways(130)
    monkeypatch.setattr(near, "MOST_HELD", 10)
    assert whole == cut == ways(near.CHUNK) and all(len(x) > 50 for x in whole)


def test_pairs_that_share_a_route_stay(spark, monkeypatch):
    on = spark.createDataFrame([("a", "R1"), ("a", "R2"), ("b", "R2"), ("c", "R3")], "name string, route string")
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "b", 3), ("x", "a", 4)], "a string, b string, n long")
    assert [r[2] for r in rows_of(segments.sharing(pairs, on))] == [1, 3]
    monkeypatch.setattr(segments, "MOST_SHARED", 1)
    assert segments.sharing(pairs, on).count() == 4


def test_kept_is_the_table_and_puts_the_setting_back(spark):
    table = stored.kept(spark.range(5000).selectExpr("id % 1000 AS k", "id").groupBy("k").sum("id"))
    assert table.count() == 1000 and spark.conf.get(stored.CLEANUP) == "false"


def test_with_some_is_a_left_join(spark):
    big = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (3, None)], "k long, v string")
    some = spark.createDataFrame([(2, 7), (9, 8)], "k long, n long")
    want = {(1, "x", None), (2, "y", 7), (2, "z", 7), (3, None, None)}
    for most in (0, 10):
        assert set(map(tuple, stored.with_some(big, some, ["k"], most).collect())) == want
