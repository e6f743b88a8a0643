"""Stations, route trajectories, adjacency and segments. Points of routes are rows (route, idx, lng, lat)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEGREE, distance_km, geodesic_m, in_bounds
from ..functions.text import alt_line_name, normalize_station_name
from . import near, pyramid


def locate_stations(stations: DataFrame, points: DataFrame, max_km: float = 5.0) -> DataFrame:
    """(route, name, idx, km): the nearest vertex, in km, of its own route to each of stations (route, name, lng, lat),
    the first of equals; stations farther than max_km from their route are left out."""
    asked = pyramid.around(stations.select("route", "name", "lng", "lat"), max_km)
    km = distance_km(F.col("plng"), F.col("plat"), F.col("lng"), F.col("lat")).alias("km")
    met = near.own_places(asked, points.select("route", "idx", "lng", "lat"), near.by_mean_latitude(max_km, KM_PER_DEGREE)).select("route", "name", "idx", km)
    best = met.groupBy("route", "name").agg(F.min(F.struct("km", "idx")).alias("b"))
    return best.where(F.col("b.km") <= max_km).select("route", "name", "b.idx", "b.km")


def stations_near_lines(routes: DataFrame, lines: DataFrame, stations: DataFrame, margin: float = 0.015) -> DataFrame:
    """(route, stations): from_station and to_station of routes (route, from_station, to_station), then the stations inside the
    box (route, fid, minx, maxx, miny, maxy) and margin of a line of the route, by fid and name, each name once. Routes
    without ends have no stations. See first_lines for a limit on lines."""
    ended = routes.where(F.concat_ws("", "from_station", "to_station") != "")
    sides = {"west": F.col("minx") - margin, "east": F.col("maxx") + margin, "south": F.col("miny") - margin, "north": F.col("maxy") + margin}
    boxes = lines.join(ended.select("route"), "route", "left_semi").select("route", "fid", *[x.alias(c) for c, x in sides.items()])
    first = pyramid.boxed(boxes, stations.select("name", "lng", "lat")).groupBy("route", "name").agg(F.min("fid").alias("fid"))
    found = first.groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("fid", "name"))), lambda x: x["name"]).alias("found"))
    ends = F.filter(F.array("from_station", "to_station"), lambda x: F.coalesce(x, F.lit("")) != "")
    with_found = routes.join(found, "route", "left")
    return with_found.select("route", F.array_distinct(F.concat(ends, F.coalesce("found", F.array().cast("array<string>")))).alias("stations"))


def line_bboxes(points: DataFrame) -> DataFrame:
    box = points.groupBy("route").agg(F.min("lng").alias("minx"), F.max("lng").alias("maxx"), F.min("lat").alias("miny"), F.max("lat").alias("maxy"))
    return box.where(in_bounds(F.col("minx"), F.col("miny")) & in_bounds(F.col("maxx"), F.col("maxy")))


def cumulative_km(points: DataFrame) -> DataFrame:
    """points with step_km and km from the start of their route."""
    line = Window.partitionBy("route").orderBy("idx")
    step = F.coalesce(distance_km(F.lag("lng").over(line), F.lag("lat").over(line), F.col("lng"), F.col("lat")), F.lit(0.0))
    return points.withColumn("step_km", step).withColumn("km", F.sum("step_km").over(line.rowsBetween(Window.unboundedPreceding, 0)))


def route_quality(points: DataFrame) -> DataFrame:
    """Points, length and points out of bounds of each route."""
    odd = F.count_if(~in_bounds(F.col("lng"), F.col("lat")))
    return cumulative_km(points).groupBy("route").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("step_km"), 1).alias("km"), odd.alias("abnormal"))


def count_abnormal_coords(points: DataFrame) -> DataFrame:
    """Points out of bounds of each route."""
    return points.groupBy("route").agg(F.count_if(~in_bounds(F.col("lng"), F.col("lat"))).alias("abnormal"))


def longest_routes(points: DataFrame, n: int = 30, ascending: bool = False) -> DataFrame:
    km = route_quality(points)
    return km.orderBy(F.col("km").asc() if ascending else F.col("km").desc(), "route").limit(n).select("route", "km")


def point_count_histogram(points: DataFrame, width: int = 100) -> DataFrame:
    counted = points.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    low = (F.floor(F.col("n") / width) * width).cast("long")
    return counted.groupBy(F.concat_ws("-", low, low + width - 1).alias("bucket")).agg(F.count(F.lit(1)).alias("routes"))


def _nearest_by_degrees(held: near.Held, idx: np.ndarray, lng: np.ndarray, lat: np.ndarray) -> dict:
    def d2(plng, plat, wide, x, y):
        inside = (x >= plng - wide) & (x <= plng + wide) & (y >= plat - wide) & (y <= plat + wide)
        return np.where(inside, (x - plng) * (x - plng) + (y - plat) * (y - plat), np.nan)

    place, at, value = near.fewest(near.met(held, lng, lat, d2))
    return {"place": place, "idx": idx[at], "plng": held.lng[place], "plat": held.lat[place], "lng": lng[at], "lat": lat[at], "d2": value}


def stations_on_route(stations: DataFrame, points: DataFrame, max_km: float = 5.0, margin: float = 0.03, most_points: int | None = None) -> DataFrame:
    """(route, name, idx, km): stations in a route's bounds (with a margin) whose nearest vertex, by squared
    degrees, is nearer than max_km. Every vertex counts; with most_points, of a longer route every (n // most_points)-th.

    A vertex nearer than max_km is in the station's box, and so is one that is nearer by squared degrees: of a station that is kept the box is
    as wide and tall as the degrees from it to its nearest vertex can be.
    """
    thin = points
    if most_points:
        n = F.count(F.lit(1)).over(Window.partitionBy("route"))
        thin = points.withColumn("n", n).where((F.col("n") <= most_points) | (F.col("idx") % F.greatest(F.floor(F.col("n") / most_points), F.lit(1)) == 0)).drop("n")
    asked = pyramid.around(stations.select("name", "lng", "lat"), max_km)
    square = asked.withColumns({"south": F.col("plat") - (F.col("east") - F.col("plng")), "north": F.col("plat") + (F.col("east") - F.col("plng"))})
    held = near.hold(square, "name")
    if held is None:
        met = pyramid.boxed(square, thin.select("route", "idx", "lng", "lat"))
        met = met.withColumn("d2", F.pow(F.col("lng") - F.col("plng"), 2) + F.pow(F.col("lat") - F.col("plat"), 2))
    else:
        met = near.over_chunks(held, thin, _nearest_by_degrees, "idx bigint, plng double, plat double, lng double, lat double, d2 double", "name")
    best = met.groupBy("route", "name").agg(F.min_by(F.struct("idx", "plng", "plat", "lng", "lat"), F.struct("d2", "idx")).alias("b"))
    km = distance_km(F.col("b.plng"), F.col("b.plat"), F.col("b.lng"), F.col("b.lat"))
    box = points.groupBy("route").agg(F.min("lng").alias("w"), F.max("lng").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    inside = F.col("b.plng").between(F.col("w") - margin, F.col("e") + margin) & F.col("b.plat").between(F.col("s") - margin, F.col("n") + margin)
    return best.withColumn("km", km).where(F.col("km") < max_km).join(box, "route").where(inside).select("route", "name", F.col("b.idx").alias("idx"), F.round("km", 2).alias("km"))


def _by_place(max_km: float):
    """km with longitude by the place's latitude, NaN from max_km on."""

    def km(plng, plat, wide, lng, lat):
        north = (lat - plat) * KM_PER_DEGREE
        east = (lng - plng) * KM_PER_DEGREE * np.cos(np.radians(plat))
        d = np.sqrt(north * north + east * east)
        return np.where(d < max_km, d, np.nan)

    return km


def routes_near_point(places: DataFrame, points: DataFrame, max_km: float = 15.0) -> DataFrame:
    """(place, route, km): routes with a vertex nearer than max_km to a place, longitude by the place's latitude."""
    asked = pyramid.around(places.select("place", "lng", "lat"), max_km)
    held = near.hold(asked, "place") if "idx" in points.columns else None
    if held is not None:

        def nearest(held: near.Held, idx: np.ndarray, lng: np.ndarray, lat: np.ndarray) -> dict:
            place, _, km = near.fewest(near.met(held, lng, lat, _by_place(max_km)))
            return {"place": place, "km": km}

        return near.over_chunks(held, points, nearest, "km double", "place").groupBy("place", "route").agg(F.min("km").alias("km")).where(F.col("km") < max_km)
    met = pyramid.boxed(asked, points.select("route", "lng", "lat"))
    north = (F.col("lat") - F.col("plat")) * KM_PER_DEGREE
    east = (F.col("lng") - F.col("plng")) * KM_PER_DEGREE * F.cos(F.radians("plat"))
    return met.groupBy("place", "route").agg(F.min(F.sqrt(north * north + east * east)).alias("km")).where(F.col("km") < max_km)


def station_match_stats(matches: DataFrame, routes: DataFrame) -> DataFrame:
    per = routes.select("route").distinct().join(matches.groupBy("route").agg(F.count(F.lit(1)).alias("n")), "route", "left").fillna(0, ["n"])
    return per.agg(F.round(F.avg("n"), 1).alias("mean"), F.max("n").alias("most"), F.min("n").alias("least"), F.count_if(F.col("n") == 0).alias("without"))


def build_adjacency(pairs: DataFrame) -> DataFrame:
    """pairs (route, station_a, station_b) of consecutive stations to (station_a, station_b, entries): the different routes of each ordered
    pair by name, with direction 1, as routes run forward only."""
    entries = F.transform(F.array_sort(F.collect_set("route")), lambda r: F.struct(r.alias("route_name"), F.lit(1).alias("direction")))
    return pairs.groupBy("station_a", "station_b").agg(entries.alias("entries"))


def adjacency_stats(pairs: DataFrame) -> DataFrame:
    """Of pairs (route, station_a, station_b): different pairs, edges (pair and route), pairs of several routes, and the stations of
    the longest route."""
    per_pair = pairs.groupBy("station_a", "station_b").agg(F.count_distinct("route").alias("n"))
    counts = per_pair.agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("edges"), F.count_if(F.col("n") > 1).alias("shared"))
    longest = pairs.groupBy("route").agg((F.count(F.lit(1)) + 1).alias("n")).agg(F.max("n").alias("longest"))
    return counts.join(F.broadcast(longest))


def consecutive_stations(matches: DataFrame, points: DataFrame) -> DataFrame:
    """(station_a, station_b, route, i, j, direct_km, km) of stations that follow each other on a route (by vertex, then name)."""
    km = cumulative_km(points)
    at = matches.join(km.select("route", "idx", "lng", "lat", F.col("km").alias("at")), ["route", "idx"])
    line = Window.partitionBy("route").orderBy("idx", "name")
    both = at.select("route", F.col("name").alias("station_a"), F.col("idx").alias("i"), "lng", "lat", "at", *[F.lead(c).over(line).alias(x) for c, x in (("name", "station_b"), ("idx", "j"), ("lng", "lng_b"), ("lat", "lat_b"), ("at", "at_b"))])
    both = both.withColumn("direct_km", distance_km(F.col("lng"), F.col("lat"), F.col("lng_b"), F.col("lat_b"))).withColumn("km", F.col("at_b") - F.col("at"))
    return both.where(F.col("station_b").isNotNull()).select("station_a", "station_b", "route", "i", "j", "direct_km", "km")


def _segment_kind(min_km: float, most: float) -> Column:
    return F.when(F.col("j") <= F.col("i"), "same_vertex").when(F.col("direct_km") < min_km, "too_near").when(F.col("km") > most * F.col("direct_km"), "too_long").otherwise("kept")


def build_segments(matches: DataFrame, points: DataFrame, min_km: float = 0.1, most: float = 3.0) -> DataFrame:
    """consecutive_stations without those on one vertex, nearer than min_km or longer than `most` times the direct way."""
    return consecutive_stations(matches, points).where(_segment_kind(min_km, most) == "kept")


def segment_counters(matches: DataFrame, points: DataFrame, min_km: float = 0.1, most: float = 3.0) -> DataFrame:
    """How many pairs that follow each other are kept and why the others go; stations and routes that kept ones cover."""
    kinds = consecutive_stations(matches, points).withColumn("kind", _segment_kind(min_km, most))
    kept = F.col("kind") == "kept"
    return kinds.agg(
        F.count_if(kept).alias("kept"), F.count_if(F.col("kind") == "same_vertex").alias("same_vertex"), F.count_if(F.col("kind") == "too_near").alias("too_near"),
        F.count_if(F.col("kind") == "too_long").alias("too_long"), F.count_distinct(F.when(kept, F.col("route"))).alias("routes"),
    )


def route_counters(routes: DataFrame) -> DataFrame:
    """routes (route, sublines as read, removed by their boxes, points of the trajectory) counted: without geometry, empty
    (fewer than two points), successful; all sub-lines, those removed, and points of successful routes."""
    lines, n = F.coalesce(F.size("sublines"), F.lit(0)), F.coalesce(F.size("points"), F.lit(0))
    return routes.agg(
        F.count_if((lines > 0) & (n >= 2)).alias("success"), F.count_if(lines <= 0).alias("no_geom"), F.count_if((lines > 0) & (n < 2)).alias("empty"),
        F.coalesce(F.sum(F.greatest(lines, F.lit(0))), F.lit(0)).alias("sublines"), F.coalesce(F.sum("removed"), F.lit(0)).cast("long").alias("removed"),
        F.coalesce(F.sum(F.when((lines > 0) & (n >= 2), n)), F.lit(0)).alias("points"),
    )


def build_station_index(segments: DataFrame) -> DataFrame:
    """Sorted routes of each station that a segment begins or ends at."""
    ends = segments.select(F.explode(F.array("station_a", "station_b")).alias("station"), "route").distinct()
    return ends.groupBy("station").agg(F.array_sort(F.collect_list("route")).alias("routes"))


def build_pair_index(segments: DataFrame) -> DataFrame:
    """Sorted routes of each pair of stations, both ways."""
    back = segments.select(F.col("station_b").alias("station_a"), F.col("station_a").alias("station_b"), "route")
    return segments.select("station_a", "station_b", "route").union(back).groupBy("station_a", "station_b").agg(F.array_sort(F.collect_set("route")).alias("routes"))


def most_shared_pairs(index: DataFrame, n: int = 10) -> DataFrame:
    return index.where(F.size("routes") > 1).orderBy(F.size("routes").desc(), "station_a", "station_b").limit(n).select("station_a", "station_b", F.size("routes").cast("long").alias("n"))


def graph_edges(points: DataFrame) -> DataFrame:
    """Undirected different edges between consecutive vertices, with their length in km, and in metres on the ellipsoid."""
    line = Window.partitionBy("route").orderBy("idx")
    u, v = F.struct("lng", "lat"), F.struct(F.lead("lng").over(line).alias("lng"), F.lead("lat").over(line).alias("lat"))
    both = points.select(u.alias("u"), v.alias("v")).where(F.col("v.lng").isNotNull())
    edges = both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return edges.select(F.col("u.lng").alias("u_lng"), F.col("u.lat").alias("u_lat"), F.col("v.lng").alias("v_lng"), F.col("v.lat").alias("v_lat")).withColumns({"km": distance_km(F.col("u_lng"), F.col("u_lat"), F.col("v_lng"), F.col("v_lat")), "meters": geodesic_m("u_lng", "u_lat", "v_lng", "v_lat")})


def graph_counts(edges: DataFrame) -> DataFrame:
    """Different nodes, edges and metres of graph_edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u_lng").alias("lng"), F.col("u_lat").alias("lat")), F.struct(F.col("v_lng").alias("lng"), F.col("v_lat").alias("lat")))).alias("n")).distinct()
    nodes = ends.agg(F.count(F.lit(1)).alias("nodes"))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.sum("meters").alias("meters")).join(F.broadcast(nodes))


def nearest_node(stations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, lng, lat, degrees): the nearest of nodes (lng, lat) to each station, by Euclid in degrees, ties by coordinates. Stations
    without coordinates are left out; nodes that repeat count once."""
    asked = stations.select("name", F.col("lng").alias("plng"), F.col("lat").alias("plat")).distinct()
    return pyramid.nearest(asked, nodes.select("lng", "lat").distinct()).select("name", "lng", "lat", "degrees")


def station_coords(features: DataFrame) -> DataFrame:
    """features (fid, name, point) of stations to one coordinate per normalized name: the first by fid, in bounds."""
    named = features.withColumn("name", normalize_station_name(F.col("name"))).where((F.col("name") != "") & in_bounds(F.col("point.lng"), F.col("point.lat")))
    return named.groupBy("name").agg(F.min_by("point", "fid").alias("p")).select("name", "p.lng", "p.lat")


def station_coord_counters(features: DataFrame) -> DataFrame:
    """features (fid, name, point) counted: valid (a named point in bounds that is the first of its name), failed (without a name or point, or
    out of bounds) and duplicate (a later one of a name)."""
    name = F.coalesce(normalize_station_name(F.col("name")), F.lit(""))
    good = (name != "") & F.coalesce(in_bounds(F.col("point.lng"), F.col("point.lat")), F.lit(False))
    per_name = features.groupBy(F.when(good, name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("name").isNotNull()
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return per_name.agg(
        F.count_if(known).alias("valid"), zero(F.sum(F.when(~known, F.col("n")))).alias("failed"), zero(F.sum(F.when(known, F.col("n") - 1))).alias("duplicate")
    )


def route_geometries(routes: DataFrame) -> DataFrame:
    """routes (fid, name, points) of two points and more: the last by fid of each name."""
    return routes.where(F.size("points") >= 2).groupBy("name").agg(F.max_by("points", "fid").alias("points"))


def match_routes_to_lines(routes: DataFrame, lines: DataFrame) -> DataFrame:
    """(route, line): lines of the route's name, else of its name without the sign for line."""
    names = lines.select(F.col("name").alias("line")).distinct()
    exact = routes.select(F.col("name").alias("route")).distinct().join(names, F.col("route") == F.col("line"))
    rest = routes.select(F.col("name").alias("route")).distinct().join(exact.select("route"), "route", "left_anti")
    return exact.select("route", "line").union(rest.withColumn("alt", alt_line_name(F.col("route"))).join(names, F.col("alt") == F.col("line")).select("route", "line"))


def route_line_points(routes: DataFrame, coords: DataFrame) -> DataFrame:
    """routes (route, stations) to (route, at, name, lng, lat) of the stations with coordinates, in order."""
    return routes.select("route", F.posexplode("stations").alias("at", "name")).join(coords.select("name", "lng", "lat"), "name").select("route", "at", "name", "lng", "lat")


def routes_in_common(pairs: DataFrame, station_routes: DataFrame) -> DataFrame:
    """pairs (a, b) with the routes that pass both; station_routes: (name, route)."""
    one = station_routes.select(F.col("name").alias("a"), "route").distinct()
    two = station_routes.select(F.col("name").alias("b"), "route").distinct()
    return pairs.select("a", "b").distinct().join(one, "a").join(two, ["b", "route"]).select("a", "b", "route")


def routes_by_name(points: DataFrame, keyword: str) -> DataFrame:
    """Points, km and span of latitude of the routes whose name has the keyword."""
    own = cumulative_km(points.where(F.col("route").contains(keyword)))
    return own.groupBy("route").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("step_km"), 1).alias("km"), F.min("lat").alias("south"), F.max("lat").alias("north"))


def first_lines(lines: DataFrame, n: int = 10) -> DataFrame:
    """The first n lines (route, fid, ...) of each route."""
    return lines.withColumn("at", F.row_number().over(Window.partitionBy("route").orderBy("fid"))).where(F.col("at") <= n).drop("at")
