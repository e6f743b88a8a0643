"""Places near lines: the vertices of a line go to a task in chunks, and every task holds all the places.

Where places fit into tasks (MOST_HELD), no pair of place and vertex is shuffled: a task looks up the places about each block of
consecutive vertices and sends on what is wanted of a place and a line. More places go through the pyramid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import few, kept

#: Consecutive vertices of a line that one task has, and of these, those that are compared at once.
CHUNK, BLOCK = 100_000, 256
#: Places that a task holds, about 40 bytes each, and pairs of place and vertex that it compares at once.
MOST_HELD, PAIRS = 2_000_000, 1 << 21
#: Vertices of a line.
LINE = ["route", "idx", "lng", "lat"]


class Held(NamedTuple):
    """Places by latitude, with half the height and width of what is looked at about each."""

    name: pa.Array
    lng: np.ndarray
    lat: np.ndarray
    tall: float
    wide: np.ndarray


class Met(NamedTuple):
    """Pairs of a place (its number) and a vertex (its place in the chunk), by vertex within each place's block."""

    place: np.ndarray
    vertex: np.ndarray


def hold(boxes: DataFrame, name: str, most: int | None = None) -> Held | None:
    """boxes (name, plng, plat, west, east, south, north: see pyramid.around) for tasks; None if there are more than `most`."""
    most = MOST_HELD if most is None else most
    rows = boxes.where(known("plng", "plat")).select(name, "plng", "plat", (F.col("east") - F.col("plng")).alias("wide"), (F.col("north") - F.col("plat")).alias("tall"))
    if rows.limit(most + 1).count() > most:
        return None
    table = rows.toArrow().combine_chunks()
    column = lambda c: table.column(c).to_numpy()
    order = np.argsort(column("plat"), kind="stable")
    tall = float(column("tall").max()) if len(order) else 0.0
    names = table.column(name).combine_chunks() if len(order) else pa.array([], table.schema.field(name).type)
    return Held(names.take(pa.array(order)), column("plng")[order], column("plat")[order], tall, column("wide")[order])


def known(*columns: str) -> Column:
    """Rows that have all of these, as numbers."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c)
    return out


def met(held: Held, lng: np.ndarray, lat: np.ndarray, near: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[Met, np.ndarray]]:
    """Vertices in order against the places about them: pairs for which near(plng, plat, wide, lng, lat) isn't NaN, and what it gives."""
    for at in range(0, len(lng), BLOCK):
        x, y = lng[at : at + BLOCK], lat[at : at + BLOCK]
        low, high = np.searchsorted(held.lat, [y.min() - held.tall, y.max() + held.tall], side="left")
        high = np.searchsorted(held.lat, y.max() + held.tall, side="right")
        px, wide = held.lng[low:high], held.wide[low:high]
        about = low + np.nonzero((px + wide >= x.min()) & (px - wide <= x.max()))[0]
        step = max(1, PAIRS // len(x))
        for i in range(0, len(about), step):
            own = about[i : i + step]
            found = near(held.lng[own, None], held.lat[own, None], held.wide[own, None], x[None], y[None])
            r, c = np.nonzero(~np.isnan(found))
            yield Met(own[r], at + c), found[r, c]


def over_chunks(held: Held, points: DataFrame, run: Callable[[Held, np.ndarray, np.ndarray, np.ndarray], dict], found: str, name_as: str, chunk: int = CHUNK) -> DataFrame:
    """(route, place, *found): run gets the places and the idx, lng, lat of a chunk in order, and gives arrays, `place` being numbers; `along`,
    where points have it and found names it, is that of the vertices `at`."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(held)
    route = points.schema["route"].dataType.simpleString()
    name = "string" if pa.types.is_string(held.name.type) or pa.types.is_large_string(held.name.type) else ("bigint" if pa.types.is_int64(held.name.type) else "int")
    fields = [x.strip().split(" ")[0] for x in found.split(",")]

    def one(table: pa.Table) -> pa.Table:
        idx, lng, lat = (table.column(c).to_numpy() for c in ("idx", "lng", "lat"))
        order = np.argsort(idx, kind="stable")
        got = run(shared.value, idx[order], lng[order], lat[order])
        if "along" in fields:
            got["along"] = table.column("along").to_numpy()[order][got["at"]]
        n = len(got["place"])
        columns = [pa.array([table.column("route")[0].as_py()] * n, table.schema.field("route").type), shared.value.name.take(pa.array(got["place"], pa.int64())), *[pa.array(got[c]) for c in fields]]
        return pa.Table.from_arrays(columns, ["route", name_as, *fields])

    rows = points.where(known("lng", "lat")).select("route", F.col("idx").cast("long").alias("idx"), "lng", "lat", *(["along"] if "along" in fields else []), F.greatest(F.floor(F.col("idx") / chunk), F.lit(0)).alias("chunk"))
    return rows.groupBy("route", "chunk").applyInArrow(lambda table: one(table), f"route {route}, {name_as} {name}, {found}")


def own_places(boxes: DataFrame, points: DataFrame, near: Callable[..., np.ndarray], chunk: int = CHUNK) -> DataFrame:
    """boxes (route, name, plng, plat, west, east, south, north) with the nearest vertex (idx, lng, lat) of each chunk of their own route by
    near (see met), the first of equals; places without one are left out."""
    at = F.greatest(F.floor(F.col("idx") / chunk), F.lit(0)).alias("chunk")
    rows = points.where(known("lng", "lat")).select("route", F.col("idx").cast("long").alias("idx"), "lng", "lat", at)
    asked = boxes.where(known("plng", "plat")).select("route", "name", "plng", "plat", (F.col("east") - F.col("plng")).alias("wide"), (F.col("north") - F.col("plat")).alias("tall"))
    asked = kept(asked.join(few(rows.select("route", "chunk").distinct()), "route"))

    def run(places: pa.Table, line: pa.Table) -> pa.Table:
        of = lambda t, c: t.column(c).to_numpy()
        order, ordered = np.argsort(of(line, "idx"), kind="stable"), np.argsort(of(places, "plat"), kind="stable")
        held = Held(places.column("name").combine_chunks().take(pa.array(ordered)), of(places, "plng")[ordered], of(places, "plat")[ordered], float(of(places, "tall").max(initial=0.0)), of(places, "wide")[ordered])
        idx, lng, lat = (of(line, c)[order] for c in ("idx", "lng", "lat"))
        place, vertex, _ = fewest(met(held, lng, lat, near))
        route = pa.array((line if line.num_rows else places).column("route").slice(0, 1).to_pylist() * len(place), line.schema.field("route").type)
        columns = [route, held.name.take(pa.array(place)), pa.array(held.lng[place]), pa.array(held.lat[place]), pa.array(idx[vertex]), pa.array(lng[vertex]), pa.array(lat[vertex])]
        return pa.Table.from_arrays(columns, ["route", "name", "plng", "plat", "idx", "lng", "lat"])

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((points, "route"), (boxes, "name"))]
    return asked.groupBy("route", "chunk").cogroup(rows.groupBy("route", "chunk")).applyInArrow(lambda places, line: run(places, line), ", ".join([*kinds, "plng double, plat double, idx bigint, lng double, lat double"]))


def least(place: np.ndarray, key: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Which rows have the least key (then the least `then`) of their place."""
    order = np.lexsort((then, key, place))
    first = np.ones(len(order), bool)
    first[1:] = place[order][1:] != place[order][:-1]
    return order[first]


def gathered(parts: list[tuple[Met, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of all blocks as (place, vertex, value)."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate([m.place for m, _ in parts]), np.concatenate([m.vertex for m, _ in parts]), np.concatenate([v for _, v in parts])


def fewest(found: Iterator[tuple[Met, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest vertex of each place, the first of equals, block by block."""
    best = []
    for m, value in found:
        keep = least(m.place, value, m.vertex)
        best.append((Met(m.place[keep], m.vertex[keep]), value[keep]))
    place, vertex, value = gathered(best)
    keep = least(place, value, vertex)
    return place[keep], vertex[keep], value[keep]


def by_mean_latitude(max_km: float, km_per_degree: float):
    """km as functions.geo.distance_km takes it, NaN beyond max_km."""

    def km(plng, plat, wide, lng, lat):
        north = (lat - plat) * km_per_degree
        east = (lng - plng) * km_per_degree * np.cos(np.radians((plat + lat) / 2))
        d = np.sqrt(north * north + east * east)
        return np.where(d <= max_km, d, np.nan)

    return km


def spaced(place: np.ndarray, idx: np.ndarray, km: np.ndarray, most: int, gap: int) -> np.ndarray:
    """Which rows are taken: of those that are the nearest of themselves and their neighbours by idx, the nearest of a place first, at most
    `most` of a place and more than `gap` apart."""
    order = np.lexsort((idx, place))
    place, idx, km = place[order], idx[order], km[order]
    n, marked = len(order), np.zeros(len(order), bool)
    beside = (place[1:] == place[:-1]) & (idx[1:] - idx[:-1] == 1)
    inf = np.full(n, np.inf)
    before, after = inf.copy(), inf.copy()
    before[1:][beside], after[:-1][beside] = km[:-1][beside], km[1:][beside]
    at = np.arange(n)
    marked[np.where((before <= km) & (before <= after), at - 1, np.where(km <= after, at, at + 1))] = True
    left = np.nonzero(marked)[0]
    left = left[np.lexsort((idx[left], km[left], place[left]))]
    taken = []
    for _ in range(most):
        if not len(left):
            break
        p = place[left]
        first = np.ones(len(left), bool)
        first[1:] = p[1:] != p[:-1]
        taken.append(left[first])
        pick = idx[left[first]][np.cumsum(first) - 1]
        left = left[np.abs(idx[left] - pick) > gap]
    return order[np.concatenate(taken)] if taken else np.zeros(0, np.int64)
