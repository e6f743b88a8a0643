"""Points in boxes by a pyramid of cells, each level's half as wide as those of the level above.

A box goes to the level whose cells are as wide as it is, so four of them cover it at most. A cell of more than
`most` points is split into those below it, down to the deepest level, and a box that meets a split cell goes on to those of its parts
that it touches: a long box over a city meets the streets that it covers, not the city. Every point
has one leaf of this tree. What can't be split (points of one place, boxes of one cell) is dealt over chunks, so no
key of the join has more than `most` points and `most` boxes. All steps are joins of columns; the driver gets the levels of the boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEGREE
from ..sources.stored import stored

#: Width of a cell of level 0 in degrees, and the deepest level.
WIDTH, DEEPEST = 16.0, 14
#: The top level: a cell and those beside it hold the globe.
TOP = -5
#: Points, and boxes, of a key of the join.
MOST = 2048
#: Split cells, and their parts, are broadcast up to this many (about 40 bytes each).
BROADCAST_CELLS = 500_000


def width(level: Column) -> Column:
    return F.lit(WIDTH) / F.pow(F.lit(2.0), level)


def cell(value: Column, level: Column) -> Column:
    return F.floor(value / width(level)).cast("long")


def above(at: Column, levels: Column) -> Column:
    """The cell so many levels above."""
    return F.floor(at / F.pow(F.lit(2.0), levels)).cast("long")


def level_of(side: Column) -> Column:
    """The deepest level whose cells are at least as wide as side."""
    deep = F.when(side > 0, F.floor(F.log2(F.lit(WIDTH) / side))).otherwise(DEEPEST)
    return F.least(F.greatest(deep, F.lit(TOP)), F.lit(DEEPEST)).cast("int")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else df


def occupied(points: DataFrame) -> DataFrame:
    """(x, y, n): the deepest cells that hold points."""
    return stored(points.groupBy(cell(F.col("lng"), F.lit(DEEPEST)).alias("x"), cell(F.col("lat"), F.lit(DEEPEST)).alias("y")).agg(F.count(F.lit(1)).alias("n")))


def _up(level: Column) -> list[Column]:
    """The cell of a level over the deepest cell (x, y)."""
    return [above(F.col(c), F.lit(DEEPEST) - level).alias(c) for c in ("x", "y")]


#: What boxes and points meet by: their cell, and the chunks of a cell that is full.
KEY = ["_level", "_cx", "_cy", "_b", "_p"]


def boxed(boxes: DataFrame, points: DataFrame, on: list[str] | None = None, most: int = MOST) -> DataFrame:
    """Pairs of boxes (west, east, south, north, ...) and points (lng, lat, ...) inside, edges included, that agree in the
    columns `on`: all columns of both. Other columns of boxes and points have different names; boxes or points with a null coordinate meet none."""
    on = on or []
    left, right = dealt(boxes, points, most)
    inside = F.col("lng").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    return left.join(right, [*KEY, *on]).where(inside).select(*boxes.columns, *[c for c in points.columns if c not in on])


def dealt(boxes: DataFrame, points: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Boxes and points with the columns of KEY: a box and a point inside it agree in them once."""
    boxes = boxes.where(F.col("west").isNotNull() & F.col("east").isNotNull() & F.col("south").isNotNull() & F.col("north").isNotNull())
    points = points.where(F.col("lng").isNotNull() & F.col("lat").isNotNull())
    box_columns = boxes.columns
    boxes = boxes.withColumn("_own", level_of(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))))
    levels = sorted(r[0] for r in boxes.select("_own").distinct().collect())  # DEEPEST - TOP + 1 at most
    if not levels:
        levels = [DEEPEST]
    cells = occupied(points)
    span = F.sequence(F.lit(levels[0]), F.lit(DEEPEST))
    deeper = cells.withColumn("level", F.explode(span))
    rolled = deeper.groupBy("level", *_up(F.col("level"))).agg(F.sum("n").alias("n"))
    dense = stored(rolled.where(F.col("n") > most))
    crowd = dense.limit(1).count() > 0
    by = [F.col("_x"), F.col("_y")]
    placed = points.withColumns({"_x": cell(F.col("lng"), F.lit(DEEPEST)), "_y": cell(F.col("lat"), F.lit(DEEPEST))})
    own, below = F.array(*[F.lit(x) for x in levels]), None
    if crowd:
        few, below = _leaves(deeper, dense, levels)
        placed = placed.join(few, ["_x", "_y"], "left")
        own = F.array_distinct(F.transform(own, lambda x: F.greatest(x, F.coalesce("leaf", F.lit(levels[0])))))
    placed = placed.withColumn("_level", F.explode(own)).select(*points.columns, "_level", *[above(c, F.lit(DEEPEST) - F.col("_level")).alias(n) for c, n in zip(by, ("_cx", "_cy"), strict=True)])

    covers = lambda low, high: F.explode(F.sequence(cell(F.col(low), F.col("_own")), cell(F.col(high), F.col("_own"))))
    seated = boxes.withColumn("_x", covers("west", "east")).withColumn("_y", covers("south", "north"))
    if below is None:
        seated = seated.select(*box_columns, F.col("_own").alias("_level"), F.col("_x").alias("_cx"), F.col("_y").alias("_cy"))
    else:
        leaf_width = width(F.col("leaf"))
        touches = (F.col("px") * leaf_width <= F.col("east")) & ((F.col("px") + 1) * leaf_width >= F.col("west")) & (F.col("py") * leaf_width <= F.col("north")) & ((F.col("py") + 1) * leaf_width >= F.col("south"))
        seated = seated.join(below, ["_own", "_x", "_y"], "left").where(F.col("leaf").isNull() | touches)
        seated = seated.select(*box_columns, F.coalesce("leaf", "_own").alias("_level"), F.coalesce("px", "_x").alias("_cx"), F.coalesce("py", "_y").alias("_cy"))
    seated = stored(seated)

    key = ["_level", "_cx", "_cy"]
    crowded = seated.groupBy(*key).agg(F.count(F.lit(1)).alias("b")).where(F.col("b") > most)
    packed = dense.where(F.col("level") == DEEPEST).select(F.col("level").alias("_level"), F.col("x").alias("_cx"), F.col("y").alias("_cy"), "n")
    chunks = lambda c: F.coalesce(F.ceil(F.col(c) / most), F.lit(1)).cast("int")
    hot = _few(stored(crowded.join(packed, key, "full").select(*key, chunks("b").alias("_nb"), chunks("n").alias("_np"))))
    one = F.lit(1)
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    nb, np_ = F.coalesce("_nb", one), F.coalesce("_np", one)
    left = seated.join(hot, key, "left").withColumns({"_b": deal(nb, *box_columns), "_p": every(np_)}).drop("_nb", "_np")
    right = placed.join(hot, key, "left").withColumns({"_p": deal(np_, *points.columns), "_b": every(nb)}).drop("_nb", "_np")
    return left, right


def _leaves(deeper: DataFrame, dense: DataFrame, levels: list[int]) -> tuple[DataFrame, DataFrame]:
    """(leaf of each deepest cell (_x, _y) under a split cell, the leaves (leaf, px, py) under each split cell (_own, _x, _y) of levels)."""
    split = _few(dense.where(F.col("level") < DEEPEST).select("level", F.col("x").alias("sx"), F.col("y").alias("sy")))
    # a deepest cell's leaf lies below the deepest split cell over it
    up = deeper.where(F.col("level") < DEEPEST).select("level", F.col("x").alias("_x"), F.col("y").alias("_y"), *[c.alias(n) for c, n in zip(_up(F.col("level")), ("sx", "sy"), strict=True)])
    deep = stored(up.join(split, ["level", "sx", "sy"]).groupBy("_x", "_y").agg((F.max("level") + 1).alias("leaf")))
    parts = deep.select("leaf", *[above(F.col(c), F.lit(DEEPEST) - F.col("leaf")).alias(n) for c, n in (("_x", "px"), ("_y", "py"))]).distinct()
    below = parts.withColumn("_own", F.explode(F.array(*[F.lit(x) for x in levels]))).where(F.col("_own") < F.col("leaf"))
    below = stored(below.select("_own", *[above(F.col(c), F.col("leaf") - F.col("_own")).alias(n) for c, n in (("px", "_x"), ("py", "_y"))], "leaf", "px", "py"))
    return _few(deep), _few(below)


def around(places: DataFrame, max_km: float, km_per_degree: float = KM_PER_DEGREE, shift: float = 0.0) -> DataFrame:
    """places (lng, lat, ...) as boxes that hold all points within max_km, longitude by the cosine of the place's or of the mean latitude; the
    place's own coordinates become plng and plat."""
    renamed = places.withColumnsRenamed({"lng": "plng", "lat": "plat"})
    lng, lat = F.col("plng"), F.col("plat")
    tall = max_km / km_per_degree * (1 + 1e-9) + shift
    # by the farthest latitude that a point within max_km can have; at the poles every longitude
    wide = F.least(F.lit(max_km / km_per_degree) / F.cos(F.radians(F.least(F.abs(lat) + tall, F.lit(89.9)))), F.lit(360.0)) * (1 + 1e-9) + shift
    return renamed.withColumns({"west": lng - wide, "east": lng + wide, "south": lat - tall, "north": lat + tall})


def nearest(places: DataFrame, points: DataFrame) -> DataFrame:
    """places (plng, plat, ...) with the nearest of points (lng, lat) by Euclid in degrees, ties by coordinates, and degrees.

    Best first: of every second level, the deepest at which a place's cell or one beside it holds a point gives a bound by
    that point, and only points inside it are compared."""
    names = places.columns
    cells = points.groupBy(cell(F.col("lng"), F.lit(DEEPEST)).alias("x"), cell(F.col("lat"), F.lit(DEEPEST)).alias("y")).agg(F.min(F.struct("lng", "lat")).alias("one"))
    levels = F.array(*[F.lit(x) for x in range(TOP, DEEPEST + 1, 2)])
    held = stored(stored(cells).withColumn("level", F.explode(levels)).groupBy("level", *_up(F.col("level"))).agg(F.min("one").alias("one")))
    todo = stored(places.where(F.col("plng").isNotNull() & F.col("plat").isNotNull()))
    at = todo.select("plng", "plat").distinct().withColumn("level", F.explode(levels))
    for c, of in (("x", "plng"), ("y", "plat")):
        at = at.withColumn(c, F.explode(F.array(*[cell(F.col(of), F.col("level")) + d for d in (-1, 0, 1)])))
    far = lambda lng, lat: F.sqrt(F.pow(lng - F.col("plng"), 2) + F.pow(lat - F.col("plat"), 2))
    bound = at.join(held, ["level", "x", "y"]).groupBy("plng", "plat").agg(F.min(far(F.col("one.lng"), F.col("one.lat"))).alias("bound"))
    reach = F.col("bound") * (1 + 1e-9) + 1e-12
    boxes = bound.select("plng", "plat", (F.col("plng") - reach).alias("west"), (F.col("plng") + reach).alias("east"), (F.col("plat") - reach).alias("south"), (F.col("plat") + reach).alias("north"))
    met = boxed(stored(boxes), points.select("lng", "lat"))
    best = met.groupBy("plng", "plat").agg(F.min(F.struct(far(F.col("lng"), F.col("lat")).alias("degrees"), "lng", "lat")).alias("b"))
    return todo.join(best.select("plng", "plat", "b.lng", "b.lat", "b.degrees"), ["plng", "plat"]).select(*names, "lng", "lat", "degrees")
