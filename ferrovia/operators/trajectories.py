"""Sub-lines of a route to one trajectory. Lines are arrays of (lng, lat) structs; what depends on the
order of vertices is done per row in Arrow batches, which lists of lines of unlike lengths pass whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import distance_km, trajectory_km
from ..functions.wkb import LINE

POINTS = "array<struct<lng:double,lat:double>>"
THRESHOLDS_KM = (10.0, 30.0, 50.0, 100.0)


def _xy(points) -> np.ndarray:
    return np.array([(p["lng"], p["lat"]) for p in points], float).reshape(-1, 2)


def _structs(xy: np.ndarray) -> list[dict]:
    return [{"lng": x, "lat": y} for x, y in xy.tolist()]


def _parts(array: pa.ListArray, items) -> list:
    """items, those of the lists of array one after the other, by list; None for a null list."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False))
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return [items[i:j] if valid else None for i, j, valid in zip(starts, ends, array.is_valid().to_pylist(), strict=True)]


def lines_in(array: pa.ListArray) -> list[np.ndarray | None]:
    """An Arrow array of lines as an (n, 2) array for each."""
    lng, lat = array.flatten().flatten()
    return _parts(array, np.stack([lng.to_numpy(zero_copy_only=False), lat.to_numpy(zero_copy_only=False)], 1))


def line_lists_in(array: pa.ListArray) -> list[list[np.ndarray | None] | None]:
    return _parts(array, lines_in(array.flatten()))


def lines_out(lines: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.cumsum([0] + [0 if x is None else len(x) for x in lines])
    offsets = pa.array([None if i < len(lines) and lines[i] is None else int(e) for i, e in enumerate(ends)], pa.int32())
    xy = np.concatenate([np.zeros((0, 2)), *[x for x in lines if x is not None]])
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["lng", "lat"]))


def km_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b - a
    return np.hypot(d[..., 1] * 111, d[..., 0] * 111 * np.cos(np.radians((a[..., 1] + b[..., 1]) / 2)))


def length_km(xy: np.ndarray) -> float:
    return float(km_between(xy[:-1], xy[1:]).sum())


def simplified(xy: np.ndarray, limit: float = 0.0005) -> np.ndarray:
    """Vertices at least limit (in either axis) from the last one kept; both ends stay."""
    if len(xy) <= 2:
        return xy
    kept = [0]
    for i in range(1, len(xy) - 1):
        if np.abs(xy[i] - xy[kept[-1]]).max() >= limit:
            kept.append(i)
    return xy[[*kept, len(xy) - 1]]


class FreeEnds:
    """Both ends of lines in a grid of about two to a cell, from which lines are taken out; the nearest to a point is found ring by ring."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.xy = np.concatenate([starts, ends])
        self.n, self.alive, self.left = len(starts), np.ones(len(starts), bool), len(starts)
        spread = np.ptp(self.xy, axis=0)
        self.origin = self.xy.min(axis=0)
        self.width = max(float(np.sqrt(max(spread[0], 1e-9) * max(spread[1], 1e-9) / max(1, self.n))), float(spread.max()) / (1 << 20), 1e-9)
        self.cells: dict[tuple[int, int], np.ndarray] = {}
        at = np.floor((self.xy - self.origin) / self.width).astype(np.int64)
        order = np.lexsort((at[:, 1], at[:, 0]))
        edges = np.flatnonzero(np.concatenate(([True], (np.diff(at[order], axis=0) != 0).any(axis=1))))
        for i, j in zip(edges, [*edges[1:], len(order)]):
            self.cells[tuple(at[order[i]].tolist())] = order[i:j]
        self.high = at.max(axis=0)
        # the least km of a degree of longitude anywhere here
        self.km = 111 * min(1.0, float(np.cos(np.radians(min(90.0, np.abs(self.xy[:, 1]).max())))))

    def take(self, line: int) -> None:
        self.alive[line] = False
        self.left -= 1

    def _ring(self, x: int, y: int, r: int):
        if r == 0:
            return [(x, y)] if (x, y) in self.cells else []
        if (2 * r + 1) ** 2 > 4 * len(self.cells):  # fewer cells are left than the ring has
            return [c for c in self.cells if max(abs(c[0] - x), abs(c[1] - y)) == r]
        low, high = max(0, x - r), min(int(self.high[0]), x + r)
        out = [(i, j) for j in (y - r, y + r) if 0 <= j <= self.high[1] for i in range(low, high + 1)]
        out += [(i, j) for i in (x - r, x + r) if 0 <= i <= self.high[0] for j in range(max(0, y - r + 1), min(int(self.high[1]), y + r - 1) + 1)]
        return [c for c in out if c in self.cells]

    def nearest(self, point: np.ndarray, ends_first: bool, most_km: float) -> tuple[float, int, int] | None:
        """(km, which, line) of the nearest end closer than most_km: which is 0 for the kind that goes first of equals (ends or starts), 1 for
        the other, then the first line of equals."""
        if not self.left:
            return None
        x, y = np.floor((point - self.origin) / self.width).astype(np.int64).tolist()
        first, r = max(-x, x - int(self.high[0]), -y, y - int(self.high[1]), 0), 0
        best, limit, r = None, most_km, first
        last = max(x, int(self.high[0]) - x, y, int(self.high[1]) - y)
        while r <= last and (r - 1) * self.width * self.km <= limit:
            for c in self._ring(x, y, r):
                held = self.cells[c]
                live = held[self.alive[held % self.n]]
                if len(live) < len(held):
                    if not len(live):
                        del self.cells[c]
                        continue
                    self.cells[c] = live
                km = km_between(point, self.xy[live])
                which = (live >= self.n) != ends_first
                i = np.lexsort((live % self.n, which, km))[0]
                found = float(km[i]), int(which[i]), int(live[i] % self.n)
                if found[0] < most_km and (best is None or found < best):
                    best, limit = found, found[0]
            r += 1
        return best


def attached(lines: list[np.ndarray], threshold_km: float) -> np.ndarray:
    """To the first line, again and again, the one whose end is closest to a free end is joined while that is
    nearer than the threshold; a joined line loses its meeting vertex. Free ends stand in a grid, what is nearest to either end of
    the line is looked up again only after that end moved or its line was taken, and all are put together once."""
    if len(lines) < 2:
        return lines[0]
    rest = lines[1:]
    free = FreeEnds(np.array([x[0] for x in rest]), np.array([x[-1] for x in rest]))
    before, after = [], [lines[0]]
    head, tail = lines[0][0], lines[0][-1]
    at_tail, at_head = free.nearest(tail, False, threshold_km), free.nearest(head, True, threshold_km)
    while at_tail or at_head:
        on_tail = at_head is None or at_tail is not None and at_tail[0] <= at_head[0]
        _, which, i = at_tail if on_tail else at_head
        line = rest[i] if which == 0 else rest[i][::-1]
        free.take(i)
        if on_tail:
            after.append(line[1:])
            tail = line[-1] if len(line) > 1 else tail
        else:
            before.append(line[:-1])
            head = line[0] if len(line) > 1 else head
        if on_tail or at_tail is not None and at_tail[2] == i:
            at_tail = free.nearest(tail, False, threshold_km)
        if not on_tail or at_head is not None and at_head[2] == i:
            at_head = free.nearest(head, True, threshold_km)
    return np.concatenate([*before[::-1], *after])


def merged(lines: list[np.ndarray], threshold_km: float) -> np.ndarray:
    """Lines attached to the longest of them (by vertices; the first of equals)."""
    return attached(sorted(lines, key=len, reverse=True), threshold_km)


def middles(lines: list[np.ndarray]) -> np.ndarray:
    return np.array([x[len(x) // 2] for x in lines])


def merged_along(lines: list[np.ndarray], threshold_km: float = 30.0) -> np.ndarray:
    """Lines of two vertices and more attached to the outermost of them on the axis in which their middles spread most."""
    lines = [x for x in lines if len(x) >= 2]
    if not lines:
        return np.zeros((0, 2))
    mid = middles(lines)
    lng, lat = np.ptp(mid, axis=0)
    return attached([lines[i] for i in np.argsort(mid[:, int(lat >= lng)], kind="stable")], threshold_km)


def capped(xy: np.ndarray, most_points: int | None) -> np.ndarray:
    """xy, or of more than most_points vertices every (n // most_points)-th and of those the first most_points."""
    return xy[:: len(xy) // most_points][:most_points] if most_points and len(xy) > most_points else xy


def without_neighbours(lines: list[np.ndarray], near_km: float = 0.2, least: int = 10) -> list[np.ndarray]:
    """In order of their middles (3 places; latitude, longitude), lines whose middle is nearer than near_km to that of the
    last one that was new count as its second track: the one with more vertices stays. Where
    that leaves at most `least` lines, all stay."""
    mid = middles(lines)
    kept, last = [], None
    for i in np.lexsort((mid[:, 0].round(3), mid[:, 1].round(3))):
        if last is None or km_between(last, mid[i]) >= near_km:
            kept.append(lines[i])
            last = mid[i]
        elif len(lines[i]) > len(kept[-1]):
            kept[-1] = lines[i]
    return kept if len(kept) > least else lines


def chained(lines: list[np.ndarray]) -> np.ndarray:
    """Lines in order of their middles on the axis in which their ends spread most, each put on by its nearer end."""
    ends = np.array([x[[0, -1]] for x in lines]).reshape(-1, 2)
    lng, lat = np.ptp(ends, axis=0)
    parts: list[np.ndarray] = []
    for i in np.argsort(middles(lines)[:, int(lat >= lng)], kind="stable"):
        line = lines[i]
        if parts:
            tail = parts[-1][-1]
            line = (line if km_between(tail, line[0]) <= km_between(tail, line[-1]) else line[::-1])[1:]
        parts.append(line)
    return np.concatenate(parts)


def parallel(sub: np.ndarray, main: np.ndarray, near_km: float = 1.5, share: float = 0.3, every: int = 1) -> bool:
    """Whether a line of at least `share` of main has start, middle and end nearer than near_km to vertices of main; with `every`
    above 1 only each so-manieth of them counts where there are over 500."""
    if len(sub) < 2 or not len(main) or length_km(sub) < share * length_km(main):
        return False
    seen = main[::every] if len(main) > 500 else main
    return all(km_between(seen, sub[i]).min() < near_km for i in (0, len(sub) // 2, -1))


def denoised(lines: list[np.ndarray], most_points: int | None = None) -> np.ndarray:
    """Lines of 5 km and more (else the five longest) merged with growing thresholds until the result has
    70 % of their length; the longest result is simplified, and capped if most_points says so."""
    lines = [x for x in lines if len(x) >= 2]
    if not lines:
        return np.zeros((0, 2))
    long = [x for x in lines if length_km(x) >= 5]
    total = sum(map(length_km, long))
    use, best = long or sorted(lines, key=length_km, reverse=True)[:5], None
    for threshold in THRESHOLDS_KM:
        found = merged(use, threshold)
        if best is None or length_km(found) > length_km(best):
            best = found
        if length_km(best) >= 0.7 * total:
            break
    return capped(simplified(best), most_points)


def downsampled(xy: np.ndarray, per_100_km: int = 25) -> np.ndarray:
    """About so many vertices for 100 km: one at each step along the line, and both ends."""
    steps = km_between(xy[:-1], xy[1:]) if len(xy) > 1 else np.zeros(0)
    km, n = float(steps.sum()), len(xy)
    target = max(2, int(km * per_100_km / 100))
    if target >= n or km < 0.01:
        return xy
    # the k-th of the kept is the first vertex at k steps along, or the one after the (k - 1)-th if that is farther on
    wanted = np.cumsum(np.full(target + 1, km / (target - 1)))
    number = np.arange(1, target + 2)
    kept = number + np.maximum.accumulate(np.searchsorted(np.cumsum(steps), wanted) + 1 - number)
    return xy[[0, *kept[kept < n - 1], n - 1]]


def _each(f, values: list) -> pa.ListArray:
    return lines_out([None if x is None else f(x) for x in values])


def denoise_route(sublines: Column | str, most_points: int | None = None) -> Column:
    """denoised() of arrays of lines; the tables of national maps were made with most_points of 15,000."""

    @F.arrow_udf(LINE)
    def denoise(lists: pa.Array) -> pa.Array:
        return _each(lambda lines: denoised([x for x in lines if x is not None], most_points), line_lists_in(lists))

    return denoise(sublines)


@F.arrow_udf(LINE)
def merge_sublines(sublines: pa.Array, threshold_km: pa.Array) -> pa.Array:
    """merged() of arrays of lines, within a distance of its own for each."""
    both = zip(line_lists_in(sublines), threshold_km.to_pylist(), strict=True)
    kept = [(None if x is None else [line for line in x if line is not None and len(line)], km) for x, km in both]
    return lines_out([None if x is None or km is None else merged(x, km) if x else np.zeros((0, 2)) for x, km in kept])


@F.arrow_udf(LINE)
def merge_sublines_spatial(sublines: pa.Array) -> pa.Array:
    return _each(lambda lines: merged_along([x for x in lines if x is not None]), line_lists_in(sublines))


def is_parallel(sub: Column | str, main: Column | str, every: int = 1) -> Column:
    """parallel() of pairs of lines; false where one is null."""

    @F.arrow_udf(T.BooleanType())
    def found(subs: pa.Array, mains: pa.Array) -> pa.Array:
        return pa.array([a is not None and b is not None and parallel(a, b, every=every) for a, b in zip(lines_in(subs), lines_in(mains), strict=True)], pa.bool_())

    return found(sub, main)


@F.arrow_udf(LINE)
def simplify_trajectory(points: pa.Array) -> pa.Array:
    return _each(simplified, lines_in(points))


@F.arrow_udf(LINE)
def downsample(points: pa.Array) -> pa.Array:
    return _each(downsampled, lines_in(points))


def stitched(legs: list[np.ndarray | None]) -> np.ndarray:
    line = np.zeros((0, 2))
    for leg in legs:
        if leg is None or not len(leg):
            continue
        xy = downsampled(leg)
        line = np.concatenate([line, xy[1:] if len(line) and np.abs(xy[0] - line[-1]).max() < 0.001 else xy])
    return line


@F.arrow_udf(LINE)
def stitch_legs(parts: pa.Array) -> pa.Array:
    return _each(stitched, line_lists_in(parts))


def dedup_reversed_sublines(sublines: DataFrame) -> DataFrame:
    """(route, ord, points) without lines whose ends, rounded to 3 places and in either order, an earlier
    line of the route has; lines of fewer than two points stay."""
    def end(i: int) -> Column:
        p = F.element_at("points", i)
        return F.struct(F.round(p["lng"], 3).alias("lng"), F.round(p["lat"], 3).alias("lat"))

    short = F.size("points") < 2
    key = F.when(short, F.col("ord").cast("string")).otherwise(F.concat_ws("|", F.least(end(1), end(-1)).cast("string"), F.greatest(end(1), end(-1)).cast("string")))
    first = F.row_number().over(Window.partitionBy("route", key, short).orderBy("ord"))
    return sublines.withColumn("first", first).where("first = 1").drop("first")


def filter_sublines_by_bbox(routes: DataFrame, boxes: DataFrame, margin: float = 0.08) -> DataFrame:
    """routes (route, sublines) with the sub-lines whose middle vertex is in the route's box and a margin; if
    none is, all stay. removed is their number."""
    joined = routes.join(boxes, "route", "left")

    def inside(line):
        mid = F.get(line, F.floor(F.size(line) / 2).cast("int"))
        return mid["lng"].between(F.col("minx") - margin, F.col("maxx") + margin) & mid["lat"].between(F.col("miny") - margin, F.col("maxy") + margin)

    kept = F.filter("sublines", inside)
    out = F.when(F.col("minx").isNull() | (F.size(kept) == 0), F.col("sublines")).otherwise(kept)
    return joined.select("route", out.alias("kept"), (F.size("sublines") - F.size(out)).alias("removed")).withColumnRenamed("kept", "sublines")


def rebuild_from_lines(lines: DataFrame, most_lines: int | None = None, most_points: int | None = None) -> DataFrame:
    """(route, points) put together from the ways of a route's name, lines (route, ord, points): turned repeats and second
    tracks go, the others are chained and simplified. All ways count, or the first most_lines of a route by ord, and all
    vertices, or at most most_points; routes that come to fewer than two points are left out. A route's ways are one task's, as
    each is put on the end that the ones before it make."""
    few = lines.where(F.size("points") >= 2).select("route", "ord", "points")
    if most_lines:
        first = F.row_number().over(Window.partitionBy("route").orderBy("ord"))
        few = few.withColumn("first", first).where(F.col("first") <= most_lines).drop("first")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_xy(p) for p in pdf.sort_values("ord")["points"]]
        xy = capped(simplified(chained(without_neighbours(parts))), most_points)
        return pd.DataFrame({"route": pdf["route"].iloc[:1], "points": [_structs(xy)]})

    once = dedup_reversed_sublines(few)
    name = lines.schema["route"].dataType.simpleString()
    return once.groupBy("route").applyInPandas(build, f"route {name}, points {POINTS}").where(F.size("points") >= 2)


def complete_route(routes: DataFrame, boxes: DataFrame, lines: DataFrame, most_lines: int | None = None, most_points: int | None = None) -> DataFrame:
    """routes (route, points) with rebuilt: a trajectory that spans less than half of its route's box (route, minx, maxx, miny,
    maxy) on an axis gives way to the one rebuilt from lines if that is more than 1.2 times as long.
    Only such routes are rebuilt. Routes of fewer than two points go."""
    axis = lambda c: F.transform("points", lambda p: p[c])
    span = lambda c: F.array_max(axis(c)) - F.array_min(axis(c))
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(1.0)
    seen = routes.select("route", "points").join(boxes, "route", "left")
    short = (ratio(span("lng"), F.col("maxx") - F.col("minx")) < 0.5) | (ratio(span("lat"), F.col("maxy") - F.col("miny")) < 0.5)
    poor = seen.where((F.size("points") > 0) & short).select("route")
    anew = rebuild_from_lines(lines.join(poor, "route", "left_semi"), most_lines, most_points).withColumnRenamed("points", "anew")
    both = routes.select("route", "points").join(anew, "route", "left")
    better = F.coalesce(trajectory_km(F.col("anew")) > trajectory_km(F.col("points")) * 1.2, F.lit(False))
    out = both.select("route", F.when(better, F.col("anew")).otherwise(F.col("points")).alias("points"), better.alias("rebuilt"))
    return out.where(F.size("points") >= 2)


def direct_segments(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs (a, b) with the shortest stored segment (station_a, station_b, points), turned round if needed."""
    there = segments.select(F.col("station_a").alias("a"), F.col("station_b").alias("b"), "points")
    back = segments.select(F.col("station_b").alias("a"), F.col("station_a").alias("b"), F.reverse("points").alias("points"))
    shortest = there.union(back).groupBy("a", "b").agg(F.min_by("points", F.struct(trajectory_km(F.col("points")), "points")).alias("points"))
    return pairs.join(shortest, ["a", "b"], "left")


def stitch_trip(legs: DataFrame) -> DataFrame:
    """Legs (train_code, seq, points) to a line per train: legs are thinned out and put together, the first vertex
    of a leg left out where it is within 0.001 degrees of the last one; km is along the whole line."""
    ordered = legs.groupBy("train_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "points"))), lambda x: x["points"]).alias("parts"))
    lines = ordered.select("train_code", F.size("parts").alias("legs"), stitch_legs("parts").alias("points"))
    return lines.withColumn("km", trajectory_km(F.col("points")))


def straight_legs(legs: DataFrame) -> DataFrame:
    """Legs with the coordinates of both ends to (train_code, seq, points, km)."""
    points = F.array(F.struct(F.col("lng_a").alias("lng"), F.col("lat_a").alias("lat")), F.struct(F.col("lng_b").alias("lng"), F.col("lat_b").alias("lat")))
    return legs.select("train_code", F.col("ord").alias("seq"), points.alias("points"), distance_km(F.col("lng_a"), F.col("lat_a"), F.col("lng_b"), F.col("lat_b")).alias("km"))
