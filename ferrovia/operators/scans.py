"""Walks over the rows of a route in which each step hangs on the one before it, by parts of rows over many tasks: a part tells what it
makes of each state in which it can be entered, and states are handed on from part to part. However long a route is, a task holds one part."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance_km
from ..sources.stored import stored
from .trajectories import dedup_reversed_sublines, km_between

#: Rows in a part, about.
PART = 100_000


def in_parts(rows: DataFrame, order: list[Column | str], part_rows: int = PART) -> DataFrame:
    """rows (route, ...) stored in ranges of route and order, which must tell the rows of a route apart, with part and at: at rises in that
    order, and a part is the rows of one range."""
    kept = stored(rows)
    ranged = kept.repartitionByRange(max(1, -(-kept.count() // part_rows)), "route", *order).sortWithinPartitions("route", *order)
    at = F.monotonically_increasing_id()
    return stored(ranged.withColumn("at", at).withColumn("part", F.shiftright("at", 33).cast("int")))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (route, part, at, ...) with at from 0 in each route, without gaps, in place of part and at."""
    counts = rows.groupBy("route", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("route").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("route", "part").orderBy("at")) - 1
    return rows.withColumn("own", own).join(counts.select("route", "part", before.alias("before")), ["route", "part"]).withColumn("at", (F.col("own") + F.col("before")).cast("long")).drop("own", "before", "part")


Far = Callable[[np.ndarray, np.ndarray], np.ndarray]


def far_by_degrees(limit: float) -> Far:
    """Whether points are limit or more from one in either axis."""
    return lambda one, xy: np.abs(xy - one).max(axis=-1) >= limit


def far_by_km(limit: float) -> Far:
    return lambda one, xy: km_between(one, xy) >= limit


def _first_far(xy: np.ndarray, start: int, one: np.ndarray, far: Far) -> int:
    """The first place from start on that is far from one; len(xy) if there is none."""
    width = 16
    while start < len(xy):
        found = far(one, xy[start : start + width])
        if found.any():
            return start + int(found.argmax())
        start, width = start + width, min(width * 4, 1 << 16)
    return len(xy)


def _exits(xy: np.ndarray, far: Far) -> list[int]:
    """The places from which nothing in the part is far: in those a walk can leave it."""
    out, corners = [], np.empty((0, 2))
    for i in range(len(xy) - 1, -1, -1):
        # the outermost of the later rows are looked at first, as most rows are far from one of them
        if not far(xy[i], corners).any() and _first_far(xy, i + 1, xy[i], far) == len(xy):
            out.append(i)
        if not len(corners) or ((xy[i] < low) | (xy[i] > high)).any():
            rest = np.concatenate([corners, xy[i : i + 1]])
            low, high = rest.min(axis=0), rest.max(axis=0)
            corners = rest[np.unique(np.concatenate([rest.argmin(axis=0), rest.argmax(axis=0)]))]
    return out


def _left(xy: np.ndarray, start: int, far: Far, seen: dict[int, int]) -> int:
    """The last place of the walk from start; seen keeps it for each place on the way."""
    way, i = [], start
    while i not in seen:
        way.append(i)
        step = _first_far(xy, i + 1, xy[i], far)
        if step == len(xy):
            seen[i] = i
            break
        i = step
    for j in way:
        seen[j] = seen[i]
    return seen[i]


def leaders(rows: DataFrame, far: Far) -> DataFrame:
    """rows (route, part, at, lng, lat) of in_parts with leader: the at of the last row at or before it that the walk stops at. It stops at
    the first row of a route and at each that is far from the last one it stopped at.

    Of a route in several parts, each part tells in which rows a walk can leave it; for each of those the next part tells where it would leave
    that one (or that it passes it by: then the part after that is asked, one round for each part that a walk can pass by whole). Which of
    them are met is found along these few rows."""
    rows = rows.select("route", "part", "at", "lng", "lat")
    route = rows.schema["route"].dataType.simpleString()
    state = "from_at long, from_lng double, from_lat double"
    per_part = rows.groupBy("route", "part").agg(F.min("at").alias("first"))
    line = Window.partitionBy("route")
    ahead = F.lead("part").over(line.orderBy("part"))
    parts = stored(per_part.select("route", "part", ahead.alias("next_part"), (F.row_number().over(line.orderBy("part")) == 1).alias("begins"), F.count(F.lit(1)).over(line).alias("parts")))
    long = parts.where("parts > 1").select("route", "part", "next_part", "begins")
    entries = None
    if long.limit(1).count():
        held = stored(rows.join(long.select("route").distinct(), "route", "left_semi"))

        def told(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("at")
            xy = pdf[["lng", "lat"]].to_numpy(float)
            out = pdf.iloc[_exits(xy, far)]
            return pd.DataFrame({"route": out["route"], "part": out["part"], "from_at": out["at"], "from_lng": out["lng"], "from_lat": out["lat"]})

        def answered(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("at")
            xy, at, seen, out = pdf[["lng", "lat"]].to_numpy(float), pdf["at"].to_numpy(), {}, []
            for _, x in asked.iterrows() if len(pdf) else ():
                begins = pd.isna(x["from_at"])
                start = 0 if begins else _first_far(xy, 0, np.array([x["from_lng"], x["from_lat"]], float), far)
                gone = None if start == len(xy) else _left(xy, start, far, seen)
                out.append((x["route"], x["part"], None if begins else int(x["from_at"]), x["from_lng"], x["from_lat"], None if gone is None else int(at[gone])))
            return pd.DataFrame(out, columns=["route", "part", "from_at", "from_lng", "from_lat", "to_at"]).astype({"from_at": "Int64", "to_at": "Int64"})

        exits = held.groupBy("route", "part").applyInPandas(told, f"route {route}, part int, {state}")
        onward = long.where("next_part IS NOT NULL").select("route", "part", "next_part")
        hand_on = lambda x: x.join(onward, ["route", "part"]).select("route", F.col("next_part").alias("part"), "from_at", "from_lng", "from_lat")
        null = lambda kind: F.lit(None).cast(kind)
        asked = hand_on(exits).union(long.where("begins").select("route", "part", null("long"), null("double"), null("double")))
        answers = None
        while True:
            schema = f"route {route}, part int, {state}, to_at long"
            now = stored(held.groupBy("route", "part").cogroup(asked.groupBy("route", "part")).applyInPandas(answered, schema))
            answers = now if answers is None else answers.union(now)
            asked = hand_on(now.where("to_at IS NULL"))
            if not asked.limit(1).count():
                break

        def met(pdf: pd.DataFrame) -> pd.DataFrame:
            out, last = [], None
            for part, own in pdf.groupby("part", sort=True):
                own = own[own["from_at"].isna() if last is None else own["from_at"] == last].iloc[0]
                out.append((own["route"], int(part), None if last is None else int(last), own["from_lng"], own["from_lat"]))
                last = last if pd.isna(own["to_at"]) else int(own["to_at"])
            return pd.DataFrame(out, columns=["route", "part", "from_at", "from_lng", "from_lat"]).astype({"from_at": "Int64"})

        entries = answers.groupBy("route").applyInPandas(met, f"route {route}, part int, {state}")

    def walked(xy: np.ndarray, at: np.ndarray, start: int, before) -> np.ndarray:
        out, i = np.full(len(at), -1 if before is None else before), start
        while i < len(at):
            step = _first_far(xy, i + 1, xy[i], far)
            out[i:step] = at[i]
            i = step
        return out

    def first_walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        return pdf.assign(leader=walked(pdf[["lng", "lat"]].to_numpy(float), pdf["at"].to_numpy(), 0, None))

    def later_walk(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pdf.assign(leader=[])
        pdf, x = pdf.sort_values("at"), entry.iloc[0]
        xy, begins = pdf[["lng", "lat"]].to_numpy(float), pd.isna(x["from_at"])
        start = 0 if begins else _first_far(xy, 0, np.array([x["from_lng"], x["from_lat"]], float), far)
        return pdf.assign(leader=walked(xy, pdf["at"].to_numpy(), start, None if begins else int(x["from_at"])))

    schema = f"route {route}, part int, at long, lng double, lat double, leader long"
    if entries is None:
        return rows.groupBy("route", "part").applyInPandas(first_walk, schema)
    short = rows.join(long.select("route").distinct(), "route", "left_anti").groupBy("route", "part").applyInPandas(first_walk, schema)
    return short.union(held.groupBy("route", "part").cogroup(entries.groupBy("route", "part")).applyInPandas(later_walk, schema))


def _simplified(parts: DataFrame, limit: float) -> DataFrame:
    """(route, at, lng, lat) of rows of in_parts."""
    last = parts.groupBy("route").agg(F.max("at").alias("last"))
    kept = leaders(parts, far_by_degrees(limit)).join(last, "route").where((F.col("at") == F.col("leader")) | (F.col("at") == F.col("last")))
    return numbered(kept.select("route", "part", "at", "lng", "lat"))


def simplify_points(points: DataFrame, limit: float = 0.0005, part_rows: int = PART) -> DataFrame:
    """trajectories.simplified of routes whose vertices are rows: points (route, idx, lng, lat) to (route, at, lng, lat), the vertices at least
    limit (in either axis) from the last one kept, and both ends; at counts them from 0. idx tells the vertices of a route apart. An empty
    table stays empty."""
    return _simplified(in_parts(points.select("route", "idx", "lng", "lat"), ["idx"], part_rows), limit)


def turns(ways: DataFrame) -> DataFrame:
    """ways (route, part, at, start, end) of in_parts with turned and begins: each is put by its nearer end on the tail of the one before it, the
    first of a route, which begins it, as it is.

    How a way lies is a map of how the one before it lies: always alike, the same way or the other. So it is the last way
    that lies always alike and, since then, how often the other way was taken; of a part that holds none, what the part before it ends in."""
    own = Window.partitionBy("route", "part").orderBy("at")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    line = Window.partitionBy("route").orderBy("part")
    ends = ways.groupBy("route", "part").agg(F.max_by(F.struct("start", "end"), "at").alias("ends"))
    before = ends.select("route", "part", F.lag("ends").over(line).alias("carried"))
    km = lambda p, q: distance_km(p["lng"], p["lat"], q["lng"], q["lat"])
    turned_from = lambda tail: (km(tail, F.col("start")) > km(tail, F.col("end"))).cast("int")
    seen = ways.join(before, ["route", "part"]).withColumn("last", F.coalesce(F.lag(F.struct("start", "end")).over(own), F.col("carried")))
    seen = seen.withColumn("begins", F.col("last").isNull()).drop("carried")
    seen = seen.withColumns({"as_is": F.when(F.col("begins"), 0).otherwise(turned_from(F.col("last.end"))), "if_turned": F.when(F.col("begins"), 0).otherwise(turned_from(F.col("last.start")))})
    flips = F.sum(((F.col("as_is") == 1) & (F.col("if_turned") == 0)).cast("int")).over(so_far)
    seen = seen.withColumn("flips", flips)
    fixed = F.last(F.when(F.col("as_is") == F.col("if_turned"), F.struct("as_is", "flips")), ignorenulls=True).over(so_far)
    seen = stored(seen.withColumn("fixed", fixed).select(*ways.columns, "begins", "flips", "fixed"))
    # the same over parts: what the last row of each makes of it
    tail = seen.groupBy("route", "part").agg(F.max_by(F.struct("flips", "fixed"), "at").alias("t")).select("route", "part", "t.*")
    total = F.sum("flips").over(line.rowsBetween(Window.unboundedPreceding, 0))
    tail = tail.withColumn("total", total)
    base = F.struct(F.col("fixed.as_is").alias("as_is"), (F.col("total") - F.col("flips") + F.col("fixed.flips")).alias("flips"))
    held = F.last(F.when(F.col("fixed").isNotNull(), base), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    tail = tail.withColumn("held", held).withColumn("lies", (F.col("held.as_is") + F.col("total") - F.col("held.flips")) % 2)
    entered = tail.select("route", "part", F.lag("lies").over(line).alias("entered"))
    from_fixed = F.col("fixed.as_is") + F.col("flips") - F.col("fixed.flips")
    lies = F.when(F.col("fixed").isNotNull(), from_fixed).otherwise(F.col("entered") + F.col("flips")) % 2
    return seen.join(entered, ["route", "part"]).select(*ways.columns, "begins", (lies == 1).alias("turned"))


def rebuild_points(lines: DataFrame, near_km: float = 0.2, least: int = 10, limit: float = 0.0005, part_rows: int = PART) -> DataFrame:
    """trajectories.rebuild_from_lines with the vertices as rows, (route, at, lng, lat), and no route in one task: the ways of a route's name, lines
    (route, ord, points), without turned repeats and second tracks, chained and simplified. Ways of fewer than two points count for
    nothing, and a route without any other has no rows; ord tells the ways of a route apart."""
    some = lines.where(F.size("points") >= 2).select("route", "ord", "points")
    ways = stored(dedup_reversed_sublines(some))
    middle = F.get("points", F.floor(F.size("points") / 2).cast("int"))
    heads = ways.select("route", "ord", F.size("points").alias("n"), middle["lng"].alias("lng"), middle["lat"].alias("lat"), F.element_at("points", 1).alias("start"), F.element_at("points", -1).alias("end"))
    placed = in_parts(heads, [F.rint(F.col("lat") * 1000), F.rint(F.col("lng") * 1000), "ord"], part_rows)
    # the longest way of each run of neighbours stays, in the place of the run, where more than `least` runs are left
    led = leaders(placed, far_by_km(near_km)).select("route", "part", "at", "leader").join(placed, ["route", "part", "at"])
    best = stored(led.groupBy("route", "leader").agg(F.max_by(F.struct("ord", "n", "lng", "lat", "start", "end"), F.struct("n", -F.col("at"))).alias("w")))
    enough = best.groupBy("route").count().where(F.col("count") > least).select("route")
    thinned = best.join(enough, "route", "left_semi").select("route", F.struct(F.col("leader").alias("first"), F.lit(0).cast(heads.schema["ord"].dataType).alias("then")).alias("tie"), "w.*")
    whole = heads.join(enough, "route", "left_anti").select("route", F.struct(F.lit(0).cast("long").alias("first"), F.col("ord").alias("then")).alias("tie"), "ord", "n", "lng", "lat", "start", "end")
    used = thinned.union(whole)
    spread = lambda c: F.greatest(F.max(f"start.{c}"), F.max(f"end.{c}")) - F.least(F.min(f"start.{c}"), F.min(f"end.{c}"))
    axis = used.groupBy("route").agg((spread("lat") >= spread("lng")).alias("by_lat"))
    chain = used.join(axis, "route").select("route", "ord", "start", "end", "tie", F.when(F.col("by_lat"), F.col("lat")).otherwise(F.col("lng")).alias("along"))
    laid = turns(in_parts(chain, ["along", "tie"], part_rows)).select("route", "ord", F.col("at").alias("place"), "begins", "turned")
    line = F.when(F.col("turned"), F.reverse("points")).otherwise(F.col("points"))
    line = F.when(F.col("begins"), line).otherwise(F.slice(line, 2, F.size(line)))
    vertices = ways.join(laid, ["route", "ord"]).select("route", "place", F.posexplode(line).alias("seat", "p")).select("route", "place", "seat", "p.lng", "p.lat")
    return _simplified(in_parts(vertices, ["place", "seat"], part_rows), limit)
