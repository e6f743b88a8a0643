"""Registered rail queries, each over its whole tables, beside SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import chat, journeys, lines, network, profile, retrieval, segments as track, timetable, trajectories
from ..sources import files, text_export
from ..sources.stored import kept, scratch, spread, stored
from ..streaming import pages
from .views import also, duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def coded_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timetable.attach_train_code(view(spark, sf_dir, "v_stops"), view(spark, sf_dir, "v_train_codes"))


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timetable.build_trains(coded_stops(spark, sf_dir))


def train_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stops of the trains, one number for each code."""
    rows = trains(spark, sf_dir).select("train_code", F.posexplode("station_details").alias("at", "s"))
    return rows.select("train_code", (F.col("at") + 1).cast("long").alias("ord"), F.col("s.name").alias("station"), "s.depart")


CODED = duck("v_stops", "v_train_codes") + """,
codes AS (SELECT train_no, arg_max(train_code, ord) AS train_code FROM v_train_codes GROUP BY train_no),
coded AS (SELECT s.*, coalesce(c.train_code, CAST(s.train_no AS VARCHAR)) AS train_code FROM v_stops s LEFT JOIN codes c ON s.train_no = c.train_no),
stops AS (SELECT * FROM coded WHERE (train_code, train_ord) IN (SELECT (train_code, max(train_ord)) FROM coded GROUP BY train_code)),
trains AS (SELECT train_code, max(train_ord) AS ord, arg_min(start_station, ord) AS from_station, arg_min(end_station, ord) AS to_station, arg_min(train_class, ord) AS train_class,
  string_agg(station, '|' ORDER BY ord) AS stations, string_agg(concat(CAST(station_no AS VARCHAR), ' ', station, ' ', arrive, ' ', depart), '|' ORDER BY ord) AS details, CAST(count(*) AS BIGINT) AS n_stops
  FROM stops GROUP BY train_code)
"""  # fmt: skip
PREFIX = "CASE WHEN regexp_matches(train_code, '^[A-Za-z]') THEN substr(train_code, 1, 1) ELSE 'P' END"
RANK = "CASE substr(train_code, 1, 1) WHEN 'G' THEN 0 WHEN 'D' THEN 1 WHEN 'C' THEN 2 WHEN 'Z' THEN 3 WHEN 'T' THEN 4 WHEN 'K' THEN 5 ELSE 9 END"


@query(CODED + "SELECT train_code, ord, from_station, to_station, train_class, stations, details, n_stops FROM trains")
def a1_build_trains(spark, sf_dir):
    details = F.transform("station_details", lambda x: F.concat_ws(" ", x["no"].cast("string"), x["name"], x["arrive"], x["depart"]))
    return trains(spark, sf_dir).select("train_code", "ord", "from_station", "to_station", "train_class", F.array_join("stations", "|").alias("stations"), F.array_join(details, "|").alias("details"), "n_stops")


@query(CODED + "SELECT train_code, ord, station FROM coded")
def j1_attach_train_code(spark, sf_dir):
    return coded_stops(spark, sf_dir).select("train_code", "ord", "station")


@query(CODED + """, k AS (SELECT *, least(from_station, to_station) AS a, greatest(from_station, to_station) AS b, CASE WHEN regexp_matches(train_code, '^[A-Za-z]') THEN substr(train_code, 1, 1) ELSE 'Z' END AS letter FROM trains),
g AS (SELECT a, b, CAST(count(*) AS BIGINT) AS train_count, arg_min(from_station, ord) AS f, arg_min(to_station, ord) AS t, count(DISTINCT from_station) AS ways FROM k GROUP BY a, b),
o AS (SELECT a, b, train_code, row_number() OVER (PARTITION BY a, b ORDER BY letter, train_code) AS no FROM k),
e AS (SELECT a, b, string_agg(train_code, '|' ORDER BY no) AS example_codes FROM o WHERE no <= 5 GROUP BY a, b),
w AS (SELECT o.a, o.b, s.station, min(o.no * 1000000 + s.ord) AS place FROM o JOIN stops s ON o.train_code = s.train_code GROUP BY o.a, o.b, s.station),
n AS (SELECT a, b, string_agg(station, '|' ORDER BY place) AS stations FROM w GROUP BY a, b)
SELECT concat(f, CASE WHEN ways > 1 THEN '/' ELSE '→' END, t) AS route_name, train_count, stations, example_codes FROM g JOIN e USING (a, b) JOIN n USING (a, b)""")
def a2_group_routes(spark, sf_dir):
    found = timetable.group_routes(trains(spark, sf_dir))
    return found.select("route_name", "train_count", F.array_join("stations", "|").alias("stations"), F.array_join("example_codes", "|").alias("example_codes"))


@query(CODED + f"SELECT {PREFIX} AS prefix, CAST(count(*) AS BIGINT) AS n FROM trains GROUP BY 1")
def a3_class_distribution(spark, sf_dir):
    return timetable.class_distribution(trains(spark, sf_dir))


MERGED = duck("v_train_codes") + """,
f AS (SELECT CAST(train_no % 1000 AS VARCHAR) AS train_code, train_class AS kind, CAST(substr(train_class, 1, 1) AS INT) AS file_rank FROM v_train_codes),
m AS (SELECT train_code, min(kind) AS kind, count(DISTINCT kind) > 1 AS conflict FROM f GROUP BY train_code)
"""


def merged_files(spark, sf_dir):
    codes = view(spark, sf_dir, "v_train_codes")
    rows = codes.select((F.col("train_no") % 1000).cast("string").alias("train_code"), F.col("train_class").alias("kind"), F.substring("train_class", 1, 1).cast("int").alias("file_rank"))
    return timetable.merge_train_files(rows)


@query(MERGED + "SELECT * FROM m")
def a5_merge_train_files(spark, sf_dir):
    return merged_files(spark, sf_dir)


@query(MERGED + "SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN conflict THEN 1 ELSE 0 END) AS BIGINT) AS conflicts FROM m GROUP BY kind")
def a4_type_stats(spark, sf_dir):
    return timetable.type_stats(merged_files(spark, sf_dir))


@query(CODED + "SELECT train_code, n_stops FROM trains ORDER BY n_stops DESC, train_code LIMIT 10")
def t1_longest_trains(spark, sf_dir):
    return timetable.longest_trains(trains(spark, sf_dir))


@query(CODED + "SELECT train_code, n_stops FROM trains WHERE train_code LIKE 'G%' AND n_stops >= 10 ORDER BY n_stops DESC, train_code LIMIT 15")
def t2_major_g_trains(spark, sf_dir):
    return timetable.major_g_trains(trains(spark, sf_dir))


@query(duck("v_stops") + "SELECT DISTINCT station FROM v_stops WHERE station <> ''")
def s2_station_vocabulary(spark, sf_dir):
    return timetable.station_vocabulary(view(spark, sf_dir, "v_stops"))


@query(CODED + "SELECT * FROM (SELECT train_code, ord, station AS station_a, lead(station) OVER (PARTITION BY train_code ORDER BY ord) AS station_b FROM stops) x WHERE station_b IS NOT NULL")
def w1_adjacent_pairs(spark, sf_dir):
    return timetable.adjacent_pairs(train_stops(spark, sf_dir))


PAIRS = CODED + ", p AS (SELECT * FROM (SELECT train_code AS route, station AS station_a, lead(station) OVER (PARTITION BY train_code ORDER BY ord) AS station_b FROM stops) x WHERE station_b IS NOT NULL),\nadj AS (SELECT station_a, station_b, count(DISTINCT route) AS n, string_agg(DISTINCT concat(route, ':1'), ',' ORDER BY concat(route, ':1')) AS entries FROM p GROUP BY station_a, station_b)\n"


def route_pairs(spark, sf_dir):
    return timetable.adjacent_pairs(train_stops(spark, sf_dir)).withColumnRenamed("train_code", "route")


@query(PAIRS + "SELECT station_a, station_b, entries FROM adj")
def a7_build_adjacency(spark, sf_dir):
    shown = F.array_sort(F.transform("entries", lambda e: F.concat_ws(":", e["route_name"], e["direction"].cast("string"))))
    return network.build_adjacency(route_pairs(spark, sf_dir)).select("station_a", "station_b", F.array_join(shown, ",").alias("entries"))


@query(PAIRS + ", l AS (SELECT route, count(*) + 1 AS n FROM p GROUP BY route)\nSELECT CAST(count(*) AS BIGINT) AS pairs, CAST(sum(n) AS BIGINT) AS edges, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS shared, (SELECT CAST(max(n) AS BIGINT) FROM l) AS longest FROM adj")
def a8_adjacency_stats(spark, sf_dir):
    return network.adjacency_stats(route_pairs(spark, sf_dir))


@query(CODED + f"""SELECT from_station, to_station, CAST(rank AS BIGINT) AS rank, train_code FROM (
SELECT from_station, to_station, train_code, row_number() OVER (PARTITION BY from_station, to_station ORDER BY {RANK}, train_code) AS rank FROM trains) x WHERE rank <= 3""")
def j3_trains_by_terminals(spark, sf_dir):
    every = trains(spark, sf_dir)
    return journeys.trains_by_terminals(every.select("from_station", "to_station"), every)


@query(CODED + f"SELECT train_code, CAST({RANK} AS INT) AS priority FROM trains")
def t5_priority_order(spark, sf_dir):
    return trains(spark, sf_dir).select("train_code", journeys.priority(F.col("train_code")).alias("priority"))


@query(CODED + """, l AS (SELECT train_code, station, max(ord) AS ord, arg_max(depart, ord) AS depart FROM stops GROUP BY train_code, station),
r AS (SELECT DISTINCT from_station, to_station FROM trains WHERE from_station <> to_station)
SELECT r.from_station, r.to_station, a.train_code, a.depart, b.ord - a.ord AS hops
FROM r JOIN l a ON a.station = r.from_station JOIN l b ON b.station = r.to_station AND b.train_code = a.train_code WHERE b.ord > a.ord""")
def j4_trains_passing(spark, sf_dir):
    every = kept(trains(spark, sf_dir).select("train_code", "from_station", "to_station", "station_details"))
    asked = every.where("from_station <> to_station").select("from_station", "to_station")
    rows = every.select("train_code", F.posexplode("station_details").alias("at", "s"))
    return journeys.trains_passing(asked, rows.select("train_code", (F.col("at") + 1).cast("long").alias("ord"), F.col("s.name").alias("station"), "s.depart"))


LOOKUP = CODED + ", asked AS (SELECT DISTINCT upper(trim(concat(' g', CAST(train_no AS VARCHAR)))) AS train_code FROM v_train_codes)\n"


def asked(spark, sf_dir):
    return view(spark, sf_dir, "v_train_codes").select(F.concat(F.lit(" g"), F.col("train_no").cast("string")).alias("code"))


@query(LOOKUP + "SELECT a.train_code, t.n_stops, CASE WHEN t.n_stops >= 3 THEN 'details' ELSE 'basic' END AS source FROM asked a JOIN trains t ON a.train_code = t.train_code")
def j2_lookup_trains(spark, sf_dir):
    every = trains(spark, sf_dir).select("train_code", "n_stops")
    return journeys.lookup_trains(asked(spark, sf_dir), every.where("n_stops >= 3"), every)


@query(LOOKUP + "SELECT train_code FROM asked WHERE train_code NOT IN (SELECT train_code FROM trains)")
def s4_codes_not_found(spark, sf_dir):
    return journeys.codes_not_found(asked(spark, sf_dir), trains(spark, sf_dir))


KM = "sqrt(pow(({lat2} - {lat1}) * 111e0, 2) + pow(({lng2} - {lng1}) * 111e0 * cos(radians(({lat1} + {lat2}) / 2)), 2))"
NAMED = duck("v_stops", "v_coords") + ", named AS (SELECT CAST(train_no AS VARCHAR) AS train_code, ord, replace(station, '站', '') AS station FROM v_stops)\n"


def named_stops(spark, sf_dir):
    return view(spark, sf_dir, "v_stops").select(F.col("train_no").cast("string").alias("train_code"), "ord", text.normalize_station_name(F.col("station")).alias("station"))


@query(NAMED + f""", l AS (SELECT train_code, ord, station AS a, lead(station) OVER (PARTITION BY train_code ORDER BY ord) AS b FROM named)
SELECT l.train_code, l.ord, l.a, l.b, round({KM.format(lng1="x.lng", lat1="x.lat", lng2="y.lng", lat2="y.lat")}, 6) AS km FROM l JOIN v_coords x ON l.a = x.name JOIN v_coords y ON l.b = y.name""")
def j5_train_legs_with_coords(spark, sf_dir):
    return journeys.train_legs_with_coords(named_stops(spark, sf_dir), view(spark, sf_dir, "v_coords")).select("train_code", "ord", "a", "b", F.round("km", 6).alias("km"))


@query(NAMED + """, n AS (SELECT DISTINCT station FROM named WHERE station <> ''), h AS (SELECT count(*) AS total, count(c.name) AS found FROM n LEFT JOIN v_coords c ON n.station = c.name)
SELECT CAST(total AS BIGINT) AS total, CAST(found AS BIGINT) AS found, CAST(floor(found * 100e0 / total) AS BIGINT) AS percent FROM h""")
def j6_station_coverage(spark, sf_dir):
    return journeys.station_coverage(named_stops(spark, sf_dir), view(spark, sf_dir, "v_coords"))


ASKED = "SELECT DISTINCT concat(CASE WHEN ord % 3 = 0 THEN '北京' ELSE '' END, substr(station, 1, 3), CASE WHEN ord % 2 = 0 THEN ' ' ELSE '' END, substr(station, 4), CASE WHEN ord % 5 = 0 THEN '站' ELSE '' END) AS name FROM v_stops"


@query(NAMED + f""", d AS ({ASKED}), c AS (SELECT name, CASE WHEN name LIKE '%7' THEN concat(name, '站') ELSE name END AS own FROM v_coords),
t AS (SELECT name, replace(name, ' ', '') AS plain, rtrim(replace(name, ' ', ''), '站') AS bare FROM d)
SELECT t.name, coalesce(c1.own, c2.own, c3.own, c4.own) AS resolved FROM t LEFT JOIN c c1 ON c1.own = plain LEFT JOIN c c2 ON c2.own = concat(plain, '站') LEFT JOIN c c3 ON c3.own = bare
LEFT JOIN c c4 ON starts_with(bare, '北京') AND c4.own = substr(bare, 3)""")
def p12_resolve_station(spark, sf_dir):
    """Names with spaces, signs and a city in front; of the stations with coordinates those that end in 7 have the sign."""
    names = spark.sql(ASKED.replace("FROM v_stops", "FROM {stops}"), stops=view(spark, sf_dir, "v_stops"))
    own = F.when(F.col("name").endswith("7"), F.concat("name", F.lit("站"))).otherwise(F.col("name"))
    return journeys.resolve_station(names, view(spark, sf_dir, "v_coords").withColumn("name", own))


@query(NAMED + """, k AS (SELECT n.* FROM named n WHERE n.station IN (SELECT name FROM v_coords)), r AS (SELECT *, row_number() OVER (PARTITION BY train_code ORDER BY ord) AS i, count(*) OVER (PARTITION BY train_code) AS n FROM k)
SELECT train_code, ord, station, CASE WHEN i = 1 THEN 'start' WHEN i = n THEN 'end' ELSE 'middle' END AS role FROM r""")
def w6_endpoint_roles(spark, sf_dir):
    return journeys.endpoint_roles(named_stops(spark, sf_dir), view(spark, sf_dir, "v_coords"))


@query(NAMED + "SELECT train_code, min(lng) AS west, max(lng) AS east, min(lat) AS south, max(lat) AS north, round(avg(lng), 9) AS lng, round(avg(lat), 9) AS lat FROM named n JOIN v_coords c ON n.station = c.name GROUP BY train_code")
def a23_trip_bounds(spark, sf_dir):
    return journeys.trip_bounds(named_stops(spark, sf_dir), view(spark, sf_dir, "v_coords")).withColumns({"lng": F.round("lng", 9), "lat": F.round("lat", 9)})


@query(duck("v_stops") + "SELECT DISTINCT station, replace(station, '站', '') AS name FROM v_stops")
def p11_normalize_station_name(spark, sf_dir):
    return view(spark, sf_dir, "v_stops").select("station").distinct().withColumn("name", text.normalize_station_name(F.col("station")))


@query(CODED + f"SELECT train_code, {PREFIX} AS prefix FROM trains")
def p13_train_prefix(spark, sf_dir):
    return trains(spark, sf_dir).select("train_code", text.train_prefix(F.col("train_code")).alias("prefix"))


@query(CODED + """, x AS (SELECT train_code, string_agg(CASE WHEN ord <= 5 THEN station END, ' → ' ORDER BY ord) AS head, count(*) AS n, arg_max(station, ord) AS last FROM stops GROUP BY train_code)
SELECT train_code, CASE WHEN n > 5 THEN concat(head, ' ... → ', last) ELSE head END AS line FROM x""")
def p16_format_route_fallback(spark, sf_dir):
    return trains(spark, sf_dir).select("train_code", journeys.format_route_fallback(F.col("stations")).alias("line"))


@query(CODED + """, r AS (SELECT train_code, string_agg(concat('    ', CAST(station_no AS VARCHAR), '. ', station, ' 到:', CASE WHEN arrive = '' THEN '----' ELSE arrive END, ' 发:', depart), chr(10) ORDER BY ord) AS timed,
string_agg(concat('    ', CAST(ord AS VARCHAR), '. ', station), chr(10) ORDER BY ord) AS bare FROM stops GROUP BY train_code),
h AS (SELECT train_code, n_stops, concat('🚄 ', train_code, ' (', train_class, ')', chr(10), '  起讫站: ', from_station, ' → ', to_station, chr(10), '  经停 ', CAST(n_stops AS VARCHAR), ' 站:') AS head FROM trains)
SELECT train_code, concat(head, chr(10), CASE WHEN n_stops % 2 = 0 THEN timed ELSE bare END) AS info FROM h JOIN r USING (train_code)""")
def p15_format_train_info(spark, sf_dir):
    """Trains of an odd number of stops are shown without their times."""
    every = trains(spark, sf_dir)
    details = F.when(F.col("n_stops") % 2 == 0, F.col("station_details"))
    return every.select("train_code", journeys.format_train_info(*[F.col(c) for c in ("train_code", "train_class", "from_station", "to_station", "stations")], details).alias("info"))


POINTS = duck("v_route_points")
STEPS = POINTS + f""", s AS (SELECT route, idx, coalesce({KM.format(lng1="plng", lat1="plat", lng2="lng", lat2="lat")}, 0e0) AS step_km FROM (
SELECT *, lag(lng) OVER (PARTITION BY route ORDER BY idx) AS plng, lag(lat) OVER (PARTITION BY route ORDER BY idx) AS plat FROM v_route_points) x)
"""


@query(STEPS + "SELECT route, idx, round(sum(step_km) OVER (PARTITION BY route ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS km FROM s")
def w2_cumulative_km(spark, sf_dir):
    return network.cumulative_km(view(spark, sf_dir, "v_route_points")).select("route", "idx", F.round("km", 6).alias("km"))


@query(STEPS + "SELECT route, round(sum(step_km), 6) AS km FROM s GROUP BY route")
def a9_trajectory_length(spark, sf_dir):
    points = view(spark, sf_dir, "v_route_points").groupBy("route").agg(F.array_sort(F.collect_list(F.struct("idx", "lng", "lat"))).alias("p"))
    return points.select("route", F.round(geo.trajectory_km(F.col("p")), 6).alias("km"))


@query(POINTS + "SELECT * FROM (SELECT route, min(lng) AS minx, max(lng) AS maxx, min(lat) AS miny, max(lat) AS maxy FROM v_route_points GROUP BY route) b WHERE minx BETWEEN 70 AND 140 AND maxx BETWEEN 70 AND 140 AND miny BETWEEN 15 AND 55 AND maxy BETWEEN 15 AND 55")
def a6_line_bboxes(spark, sf_dir):
    return network.line_bboxes(view(spark, sf_dir, "v_route_points"))


@query(STEPS + ", o AS (SELECT route, CAST(sum(CASE WHEN lng BETWEEN 70 AND 140 AND lat BETWEEN 15 AND 55 THEN 0 ELSE 1 END) AS BIGINT) AS abnormal FROM v_route_points GROUP BY route)\nSELECT s.route, CAST(count(*) AS BIGINT) AS points, round(sum(step_km), 1) AS km, min(o.abnormal) AS abnormal FROM s JOIN o ON s.route = o.route GROUP BY s.route")
def a10_route_quality(spark, sf_dir):
    return network.route_quality(view(spark, sf_dir, "v_route_points"))


@query(STEPS + "SELECT route, round(sum(step_km), 1) AS km FROM s GROUP BY route ORDER BY km DESC, route LIMIT 10")
def t3_longest_routes(spark, sf_dir):
    return network.longest_routes(view(spark, sf_dir, "v_route_points"), 10)


@query(POINTS + "SELECT concat(CAST(n // 100 * 100 AS VARCHAR), '-', CAST(n // 100 * 100 + 99 AS VARCHAR)) AS bucket, CAST(count(*) AS BIGINT) AS routes FROM (SELECT route, count(*) AS n FROM v_route_points GROUP BY route) c GROUP BY 1")
def a14_point_count_histogram(spark, sf_dir):
    return network.point_count_histogram(view(spark, sf_dir, "v_route_points"))


MATCHED = duck("v_route_points", "v_coords") + f""", d AS (SELECT p.route, c.name, p.idx, c.lng, c.lat, p.lng AS plng, p.lat AS plat, pow(p.lng - c.lng, 2) + pow(p.lat - c.lat, 2) AS d2 FROM v_coords c JOIN v_route_points p ON abs(p.lng - c.lng) < 0.3 AND abs(p.lat - c.lat) < 0.3),
n AS (SELECT *, row_number() OVER (PARTITION BY route, name ORDER BY d2, idx) AS rk FROM d),
box AS (SELECT route, min(lng) AS w, max(lng) AS e, min(lat) AS s, max(lat) AS n FROM v_route_points GROUP BY route),
m AS (SELECT n.route, n.name, n.idx, {KM.format(lng1="n.lng", lat1="n.lat", lng2="n.plng", lat2="n.plat")} AS km FROM n JOIN box b ON n.route = b.route
WHERE n.rk = 1 AND n.lng BETWEEN b.w - 0.03e0 AND b.e + 0.03e0 AND n.lat BETWEEN b.s - 0.03e0 AND b.n + 0.03e0)
"""


def matches(spark, sf_dir):
    return stored(network.stations_on_route(view(spark, sf_dir, "v_coords"), kept(view(spark, sf_dir, "v_route_points"))))


@query(MATCHED + "SELECT route, name, idx, round(km, 2) AS km FROM m WHERE km < 5")
def j9_stations_on_route(spark, sf_dir):
    return matches(spark, sf_dir)


@query(MATCHED + ", c AS (SELECT b.route, count(m.name) AS n FROM box b LEFT JOIN (SELECT * FROM m WHERE km < 5) m ON m.route = b.route GROUP BY b.route)\nSELECT round(avg(n), 1) AS mean, CAST(max(n) AS BIGINT) AS most, CAST(min(n) AS BIGINT) AS least, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS without FROM c")
def a18_station_match_stats(spark, sf_dir):
    return network.station_match_stats(matches(spark, sf_dir), view(spark, sf_dir, "v_route_points"))


SEGMENTS = MATCHED + f""", st AS (SELECT route, idx, lng, lat, coalesce({KM.format(lng1="a", lat1="b", lng2="lng", lat2="lat")}, 0e0) AS step FROM (SELECT *, lag(lng) OVER (PARTITION BY route ORDER BY idx) AS a, lag(lat) OVER (PARTITION BY route ORDER BY idx) AS b FROM v_route_points) x),
cu AS (SELECT route, idx, lng, lat, sum(step) OVER (PARTITION BY route ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rkm FROM st),
k AS (SELECT m.route, m.name, m.idx, cu.lng, cu.lat, cu.rkm FROM m JOIN cu ON m.route = cu.route AND m.idx = cu.idx WHERE m.km < 5),
le AS (SELECT route, name AS station_a, idx AS i, lng, lat, rkm, lead(name) OVER w AS station_b, lead(idx) OVER w AS j, lead(lng) OVER w AS lng_b, lead(lat) OVER w AS lat_b, lead(rkm) OVER w AS rkm_b FROM k WINDOW w AS (PARTITION BY route ORDER BY idx, name)),
dk AS (SELECT *, {KM.format(lng1="lng", lat1="lat", lng2="lng_b", lat2="lat_b")} AS direct_km, rkm_b - rkm AS km FROM le WHERE station_b IS NOT NULL),
seg AS (SELECT station_a, station_b, route, i, j, direct_km, km FROM dk WHERE j > i AND direct_km >= 0.1 AND km <= 3 * direct_km)
"""


LOCATED = duck("v_route_points", "v_coords") + f""", d AS (SELECT p.route, c.name, p.idx, {KM.format(lng1="c.lng", lat1="c.lat", lng2="p.lng", lat2="p.lat")} AS km FROM v_coords c JOIN v_route_points p ON abs(p.lng - c.lng) < 0.3 AND abs(p.lat - c.lat) < 0.3),
w AS (SELECT *, row_number() OVER (PARTITION BY route, name ORDER BY km, idx) AS rk FROM d)
"""


def segments(spark, sf_dir):
    return network.build_segments(matches(spark, sf_dir), view(spark, sf_dir, "v_route_points"))


@query(SEGMENTS + "SELECT station_a, station_b, route, i, j, round(direct_km, 6) AS direct_km, round(km, 6) AS km FROM seg")
def g9_build_segments(spark, sf_dir):
    return segments(spark, sf_dir).withColumns({"direct_km": F.round("direct_km", 6), "km": F.round("km", 6)})


@query(SEGMENTS + ", u AS (SELECT station_a, station_b, route FROM seg UNION SELECT station_b, station_a, route FROM seg)\nSELECT station_a, station_b, string_agg(route, ',' ORDER BY route) AS routes FROM u GROUP BY station_a, station_b")
def a17_build_pair_index(spark, sf_dir):
    return network.build_pair_index(segments(spark, sf_dir)).withColumn("routes", F.array_join("routes", ","))


@query(SEGMENTS + ", u AS (SELECT station_a, station_b, route FROM seg UNION SELECT station_b, station_a, route FROM seg)\nSELECT station_a, station_b, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY station_a, station_b HAVING count(*) > 1 ORDER BY n DESC, station_a, station_b LIMIT 10")
def t6_most_shared_pairs(spark, sf_dir):
    return network.most_shared_pairs(network.build_pair_index(segments(spark, sf_dir)))


@query(duck("v_route_points", "v_coords") + """, k AS (SELECT c.name AS place, p.route, sqrt(pow((p.lat - c.lat) * 111e0, 2) + pow((p.lng - c.lng) * 111e0 * cos(radians(c.lat)), 2)) AS km FROM v_coords c JOIN v_route_points p ON abs(p.lng - c.lng) < 0.5 AND abs(p.lat - c.lat) < 0.5)
SELECT place, route, round(min(km), 6) AS km FROM k GROUP BY place, route HAVING min(km) < 15""")
def j11_routes_near_point(spark, sf_dir):
    near = network.routes_near_point(view(spark, sf_dir, "v_coords").withColumnRenamed("name", "place"), view(spark, sf_dir, "v_route_points"))
    return near.withColumn("km", F.round("km", 6))


@query(POINTS + f""", l AS (SELECT lng AS u_lng, lat AS u_lat, lead(lng) OVER (PARTITION BY route ORDER BY idx) AS v_lng, lead(lat) OVER (PARTITION BY route ORDER BY idx) AS v_lat FROM v_route_points),
e AS (SELECT DISTINCT CASE WHEN o THEN u_lng ELSE v_lng END AS u_lng, CASE WHEN o THEN u_lat ELSE v_lat END AS u_lat, CASE WHEN o THEN v_lng ELSE u_lng END AS v_lng, CASE WHEN o THEN v_lat ELSE u_lat END AS v_lat FROM (SELECT *, u_lng < v_lng OR (u_lng = v_lng AND u_lat <= v_lat) AS o FROM l WHERE v_lng IS NOT NULL) y)
SELECT *, round({KM.format(lng1="u_lng", lat1="u_lat", lng2="v_lng", lat2="v_lat")}, 6) AS km FROM e""")
def a25_graph_edges(spark, sf_dir):
    return network.graph_edges(view(spark, sf_dir, "v_route_points")).drop("meters").withColumn("km", F.round("km", 6))


TAGGED = duck("v_tagged_points")


@query(TAGGED + """SELECT fid, regexp_extract(other_tags, '"railway"=>"([^"]*)"', 1) AS railway, regexp_extract(other_tags, '"operator"=>"([^"]*)"', 1) AS operator FROM v_tagged_points""")
def p3_parse_tags(spark, sf_dir):
    points = view(spark, sf_dir, "v_tagged_points").withColumn("tags", text.parse_tags(F.col("other_tags")))
    return points.select("fid", F.col("tags")["railway"].alias("railway"), F.col("tags")["operator"].alias("operator"))


@query(TAGGED + """SELECT fid, name FROM v_tagged_points WHERE (other_tags LIKE '%"railway"=>"station"%' OR other_tags LIKE '%"railway"=>"halt"%') AND name <> ''""")
def p4_station_features(spark, sf_dir):
    return view(spark, sf_dir, "v_tagged_points").where(text.is_station_feature(F.col("name"), F.col("other_tags"))).select("fid", "name")


@query(TAGGED + """SELECT regexp_extract(other_tags, '"operator"=>"([^"]*)"', 1) AS value, CAST(count(*) AS BIGINT) AS n FROM v_tagged_points GROUP BY 1 ORDER BY n DESC, value LIMIT 30""")
def a12_tag_value_counts(spark, sf_dir):
    return profile.tag_value_counts(view(spark, sf_dir, "v_tagged_points"), "operator")


@query(TAGGED + "SELECT name, CAST(count(*) AS BIGINT) AS n FROM v_tagged_points GROUP BY name HAVING count(*) > 1")
def a11_duplicate_names(spark, sf_dir):
    return profile.duplicate_names(view(spark, sf_dir, "v_tagged_points"))


@query(TAGGED + "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN name <> '' THEN 1 ELSE 0 END) AS BIGINT) AS named, 'fid:bigint,name:string,other_tags:string' AS columns FROM v_tagged_points")
def a13_table_profile(spark, sf_dir):
    return profile.table_profile(view(spark, sf_dir, "v_tagged_points"))


#: White space as RE2 names it.
_SPACE = r"\t\n\x{0B}\f\r \x{85}\p{Z}"


#: What cleaning does, written out for RE2 on its own, so that a wrong or missing rule of the library shows; {s} is a class of white space.
_HEADED = ((r"(?m)^##{s}*(.+)$", r"concat(chr(10), '=== \1 ===', chr(10))"), (r"(?m)^###{s}*(.+)$", r"concat(chr(10), '--- \1 ---', chr(10))"), (r"(?m)^####{s}*(.+)$", r"concat(chr(10), '*** \1 ***', chr(10))"))
_BARE = ((r"(?m)^#{{1,6}}{s}*", "''"),)
_STEPS = (
    (r"\[([^\]]+)\]\(https?://[^)]+\)", r"'\1'"), (r"\[!\[[^\]]*\]\([^)]+\)\]\([^)]+\)", "''"), (r"\[!\[[^\]]*\]\([^)]+\)", "''"), (r"!\[[^\]]*\]\([^)]+\)", "''"),
    (r"\[\[\p{{Nd}}+\]\]\(https?://[^)]+\)", "''"), (r"\[\[\p{{Nd}}+\]\]", "''"), (r"<[^>]+>", "''"), (r"[\x{{200B}}-\x{{200D}}\x{{FEFF}}]", "''"), (r" {{2,}}", "' '"), (r"\t", "'    '"),
    (r"\n{{3,}}", "concat(chr(10), chr(10))"), (r"(?m)^-{s}*\[\p{{Nd}}+\.?\p{{Nd}}*{s}*[^\]]*\]\(https?://[^)]+\){s}*$", "''"), (r"(?m)^-{s}*\[\p{{Nd}}+\.?\p{{Nd}}*{s}*[^\]]*\]{s}*$", "''"),
)


def _clean_sql(heads) -> str:
    out, space = "text", f"[{_SPACE}]"
    for pattern, new in (*heads, *_STEPS):
        out = f"regexp_replace({out}, '{pattern.format(s=space)}', {new}, 'g')"
    lines = f"list_filter(string_split({out}, chr(10)), lambda x: NOT regexp_matches(x, '^[{_SPACE}|*=#-]*\\z') AND NOT regexp_matches(x, '^{space}*https?://[^{_SPACE}]+{space}*\\z'))"
    return f"regexp_replace(array_to_string({lines}, chr(10)), '^{space}+|{space}+\\z', '', 'g')"


def _cleaned(heads) -> str:
    return duck("v_dirty_docs") + f""", c AS (SELECT doc_id, text AS old, {_clean_sql(heads)} AS text FROM v_dirty_docs),
z AS (SELECT doc_id, CAST(length(old) AS BIGINT) AS original_size, text, CAST(length(text) AS BIGINT) AS new_size FROM c)
"""


CLEANED = _cleaned(_HEADED)
REDUCTION = "CASE WHEN original_size > 0 THEN (1 - new_size / original_size) * 100 ELSE 0e0 END"


def cleaned_docs(spark, sf_dir):
    return profile.cleaned(spread(view(spark, sf_dir, "v_dirty_docs")))


@query(CLEANED + f"SELECT doc_id, original_size, text, new_size, round({REDUCTION}, 6) AS reduction FROM z")
def p19_clean_text(spark, sf_dir):
    return cleaned_docs(spark, sf_dir).withColumn("reduction", F.round("reduction", 6))


@query(_cleaned(_BARE) + "SELECT doc_id, text FROM z")
def p19_clean_text_plain(spark, sf_dir):
    """Cleaned without the structure: signs of headings go."""
    return spread(view(spark, sf_dir, "v_dirty_docs")).select("doc_id", text.clean_text(F.col("text"), keep_structure=False).alias("text"))


@query(CLEANED + f"""SELECT CAST(count(*) AS BIGINT) AS files, CAST(count(text) AS BIGINT) AS ok, CAST(count(*) - count(text) AS BIGINT) AS failed, 100e0 AS success, CAST(sum(original_size) AS BIGINT) AS original_size,
CAST(sum(new_size) AS BIGINT) AS new_size, round((1 - sum(new_size) / sum(original_size)) * 100, 4) AS reduction, round(avg({REDUCTION}), 4) AS mean_reduction FROM z""")
def a19_cleaning_report(spark, sf_dir):
    return profile.cleaning_report(cleaned_docs(spark, sf_dir))


@query(CLEANED + f"SELECT doc_id, true AS ok, original_size, new_size, round({REDUCTION}, 2) AS reduction FROM z")
def a19_cleaning_details(spark, sf_dir):
    return profile.cleaning_details(cleaned_docs(spark, sf_dir))


@query("SELECT concat('doc', CAST(doc_id AS VARCHAR), '_清理后.txt') AS file_name, coalesce(text, '') AS text FROM documents")
def io12_text_export(spark, sf_dir):
    """Every document written as a text file, and the files read back; the shared folder must be a mount."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), "text")
    folder = scratch(spark, "documents")
    text_export.write_text_files(docs, folder.removeprefix("file://").removeprefix("file:"))
    return files.read_text_corpus(spark, folder).select("file_name", "text")


MESSAGES = duck("v_messages")


@query(MESSAGES + "SELECT thread_id, CAST(turn AS BIGINT) AS turn, role, content FROM v_messages UNION ALL SELECT thread_id, CAST(max(turn) + 1 AS BIGINT), 'user', 'thanks' FROM v_messages GROUP BY thread_id")
def c1_append_messages(spark, sf_dir):
    history = view(spark, sf_dir, "v_messages")
    new = history.select("thread_id").distinct().select("thread_id", F.lit(0).alias("ord"), F.lit("user").alias("role"), F.lit("thanks").alias("content"))
    return chat.append_messages(history, new)


@query(MESSAGES + "SELECT thread_id, turn FROM v_messages WHERE thread_id NOT IN (SELECT thread_id FROM v_messages WHERE role = 'system')")
def c2_clear_session(spark, sf_dir):
    history = view(spark, sf_dir, "v_messages")
    return chat.clear_session(history, history.where("role = 'system'")).select("thread_id", "turn")


#: A checkpoint after each message; some have a time that can't be read, half a date, a date that isn't one, or an offset.
_TS = """CASE n % 17 WHEN 3 THEN 'none' WHEN 5 THEN '2025-03' WHEN 6 THEN '23:30' WHEN 9 THEN '2025-02-30T01:02:03' WHEN 7 THEN '2025-01-01T23:30:00+08:00' WHEN 8 THEN '2024-12-31 00:10:00.5Z'
ELSE concat('2025-0', CAST(n % 9 + 1 AS STRING), '-1', CAST(n % 7 AS STRING), 'T0', CAST(n % 5 AS STRING), ':3', CAST(turn % 10 AS STRING), ':1', CAST(n % 6 AS STRING)) END"""
CHECKPOINTS = MESSAGES + f""", c AS (SELECT thread_id, turn AS seq, CASE WHEN role = 'user' THEN 'input' ELSE 'loop' END AS source, {_TS} AS ts, role, content
FROM (SELECT *, length(thread_id) * 31 + length(content) AS n FROM v_messages) x),
f AS (SELECT thread_id, arg_min(ts, seq) AS created_at, min(seq) AS seq FROM c WHERE source = 'input' GROUP BY thread_id),
s AS (SELECT f.thread_id, f.created_at, CASE WHEN x.content = '' THEN '新对话' ELSE substr(x.content, 1, 100) END AS preview FROM f JOIN (SELECT thread_id, arg_min(content, seq) AS content FROM c GROUP BY thread_id) x ON f.thread_id = x.thread_id)
"""


def checkpoints(spark, sf_dir):
    """A thread's checkpoint after each of its messages. The last one holds all of them; of the others nothing reads more than the first
    message, so they hold that alone."""
    message = F.struct("role", "content", (F.col("role").eqNullSafe("assistant") & (F.length("content") % 3 == 0)).alias("has_tool_calls"))
    rows = view(spark, sf_dir, "v_messages").withColumn("n", F.length("thread_id") * 31 + F.length("content")).withColumn("message", message)
    threads = rows.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("turn", "message"))).alias("all"), F.max("turn").alias("last"))
    held = F.transform("all", lambda x: x["message"])
    messages = F.when(F.col("turn") == F.col("last"), held).otherwise(F.slice(held, 1, 1)).alias("messages")
    source = F.when(F.col("role") == "user", "input").otherwise("loop").alias("source")
    return rows.join(threads, "thread_id").select("thread_id", F.col("turn").cast("long").alias("seq"), F.expr(_TS).alias("ts"), source, messages)


@query(CHECKPOINTS + "SELECT thread_id, created_at, preview FROM s")
def c3_first_input_per_thread(spark, sf_dir):
    return chat.first_input_per_thread(checkpoints(spark, sf_dir))


@query(CHECKPOINTS + """SELECT CASE WHEN bad THEN '未知日期' ELSE substr(created_at, 1, 10) END AS date, CASE WHEN bad THEN '' ELSE substr(created_at, 12, 5) END AS time, thread_id, created_at, preview
FROM (SELECT *, created_at IN ('none', '2025-03', '23:30', '2025-02-30T01:02:03') AS bad FROM s) x""")
def c4_sessions_by_date(spark, sf_dir):
    return chat.sessions_by_date(chat.first_input_per_thread(checkpoints(spark, sf_dir)))


@query(MESSAGES + "SELECT thread_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY turn) AS BIGINT) AS place, role, content FROM v_messages WHERE role IN ('user', 'assistant') AND content <> ''")
def c5_session_messages(spark, sf_dir):
    numbered = F.row_number().over(Window.partitionBy("thread_id").orderBy("at")).cast("long")
    return chat.session_messages(checkpoints(spark, sf_dir)).select("thread_id", numbered.alias("place"), "role", "content")


@query(MESSAGES + "SELECT thread_id FROM (SELECT thread_id, arg_max(role, turn) AS role, arg_max(content, turn) AS content FROM v_messages GROUP BY thread_id) x WHERE role = 'assistant' AND length(content) % 3 = 0")
def c6_pending_tool_calls(spark, sf_dir):
    return chat.pending_tool_calls(checkpoints(spark, sf_dir))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.e, c.embedding) AS similarity FROM q CROSS JOIN embeddings c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 6) DESC, chunk_id) AS rank FROM s WHERE similarity >= 0)
SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5""")
def j15_retrieve_topk(spark, sf_dir):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    hits = retrieval.retrieve_topk(rows.select(F.col("vec_id").alias("chunk_id"), "embedding"), rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), places=6, single=True)
    return hits.select("query_id", "chunk_id", "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.e, c.embedding) AS similarity FROM q JOIN embeddings c ON c.vec_id % 20 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 6) DESC, chunk_id) AS rank FROM s WHERE similarity >= 0.4),
t AS (SELECT query_id, string_agg(concat(CAST(rank AS VARCHAR), '. chunk ', CAST(chunk_id AS VARCHAR), CASE chunk_id % 3 WHEN 0 THEN concat('（来源: file ', CAST(chunk_id % 7 AS VARCHAR), '）') ELSE '' END), concat(chr(10), chr(10)) ORDER BY rank) AS text FROM r WHERE rank <= 5 GROUP BY query_id)
SELECT q.query_id, coalesce(t.text, '未找到相关消息') AS text FROM q LEFT JOIN t ON q.query_id = t.query_id""")
def j15_hit_texts(spark, sf_dir):
    """What each query is told; queries find no chunk among themselves, some none at all, and some chunks have no source or an empty one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    chunks, asked = rows.where("vec_id % 20 <> 0").withColumnRenamed("vec_id", "chunk_id"), rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    source = F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("file "), (F.col("chunk_id") % 7).cast("string"))).when(F.col("chunk_id") % 3 == 1, "")
    texts = chunks.select("chunk_id", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")).alias("content"), source.alias("source"))
    return retrieval.format_hits(retrieval.retrieve_topk(chunks, asked, threshold=0.4, places=6, single=True), texts, asked)


@query()
def g17_match_lines(spark, sf_dir):
    """Lines are the routes with the stations that J9 finds on them; trains ride over normalized names."""
    ordered = matches(spark, sf_dir).groupBy(F.col("route").alias("line_name")).agg(F.array_sort(F.collect_list(F.struct("idx", "name"))).alias("s"))
    table = ordered.select("line_name", F.hash("line_name").alias("line_ord"), F.transform("s", lambda x: x["name"]).alias("stations"))
    return lines.match_lines(train_stations(spark, sf_dir), table)


AT = POINTS + ", v AS (SELECT route, idx, lng, lat, CAST(row_number() OVER (PARTITION BY route ORDER BY idx) - 1 AS BIGINT) AS at FROM v_route_points)\n"


def by_vertex(lines):
    """(route, points) to a row per vertex."""
    return lines.select("route", F.posexplode("points").alias("at", "p")).select("route", F.col("at").cast("long").alias("at"), "p.lng", "p.lat")


def route_lines(spark, sf_dir):
    """Each route as sub-lines of 50 vertices, every third turned round and one repeated."""
    points = view(spark, sf_dir, "v_route_points")
    part = points.groupBy("route", F.floor(F.col("idx") / 50).cast("int").alias("ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lng", "lat"))), lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("points"))
    part = part.withColumn("points", F.when(F.col("ord") % 3 == 2, F.reverse("points")).otherwise(F.col("points")))
    return part.union(part.where("ord = 4").select("route", F.lit(99_999).alias("ord"), F.reverse("points")))


@query(STEPS + """, w AS (SELECT route, idx // 50 AS ord, sum(CASE WHEN idx % 50 = 0 THEN 0 ELSE step_km END) AS km FROM s GROUP BY route, idx // 50),
k AS (SELECT v.* FROM v_route_points v JOIN w ON v.route = w.route AND v.idx // 50 = w.ord WHERE w.km >= 5 AND (v.idx % 50 > 0 OR v.idx = 0))
SELECT route, CAST(row_number() OVER (PARTITION BY route ORDER BY idx) - 1 AS BIGINT) AS at, lng, lat FROM k""")
def g3_denoise_route(spark, sf_dir):
    """Sub-lines without repeats, denoised to one trajectory: all vertices in order but those at which a line meets the one before it,
    and but a last line of less than 5 km."""
    once = trajectories.dedup_reversed_sublines(route_lines(spark, sf_dir))
    whole = once.groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "points"))), lambda x: x["points"]).alias("sublines"))
    return by_vertex(whole.select("route", trajectories.denoise_route("sublines").alias("points")))


@query(NAMED + f""", l AS (SELECT train_code, ord, station AS a, lead(station) OVER (PARTITION BY train_code ORDER BY ord) AS b FROM named),
g AS (SELECT l.train_code, l.ord, x.lng AS lng1, x.lat AS lat1, y.lng AS lng2, y.lat AS lat2 FROM l JOIN v_coords x ON l.a = x.name JOIN v_coords y ON l.b = y.name),
e AS (SELECT *, lag(lng2) OVER (PARTITION BY train_code ORDER BY ord) AS lng0, lag(lat2) OVER (PARTITION BY train_code ORDER BY ord) AS lat0 FROM g),
p AS (SELECT train_code, ord * 2 AS o, lng1 AS lng, lat1 AS lat FROM e WHERE lng0 IS NULL OR greatest(abs(lng1 - lng0), abs(lat1 - lat0)) >= 0.001 UNION ALL SELECT train_code, ord * 2 + 1, lng2, lat2 FROM e),
q AS (SELECT *, lag(lng) OVER (PARTITION BY train_code ORDER BY o) AS plng, lag(lat) OVER (PARTITION BY train_code ORDER BY o) AS plat FROM p),
m AS (SELECT train_code, count(*) AS points, sum(coalesce({KM.format(lng1="plng", lat1="plat", lng2="lng", lat2="lat")}, 0e0)) AS km FROM q GROUP BY train_code)
SELECT m.train_code, CAST(c.legs AS BIGINT) AS legs, CAST(m.points AS BIGINT) AS points, round(m.km, 3) AS km FROM m JOIN (SELECT train_code, count(*) AS legs FROM g GROUP BY train_code) c ON m.train_code = c.train_code""")
def g14_stitch_trip(spark, sf_dir):
    """Trips of all trains over stations with coordinates, as straight legs put together."""
    legs = journeys.train_legs_with_coords(named_stops(spark, sf_dir), view(spark, sf_dir, "v_coords"))
    trips = trajectories.stitch_trip(trajectories.straight_legs(legs))
    return trips.select("train_code", F.col("legs").cast("long").alias("legs"), F.size("points").cast("long").alias("points"), F.round("km", 3).alias("km"))


@query("""SELECT page_id, string_agg(concat(CAST(i AS VARCHAR), '. ', trim(x)), chr(10) ORDER BY i) AS items FROM (
SELECT page_id, unnest(regexp_extract_all(list, '<li>(?:<a [^>]*>)?([^<]*)(?:</a>)?</li>', 1)) AS x, generate_subscripts(regexp_extract_all(list, '<li>(?:<a [^>]*>)?([^<]*)(?:</a>)?</li>', 1), 1) AS i
FROM (SELECT page_id, regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1) AS list FROM pages) a) b GROUP BY page_id""")
def h2_extract_list_items(spark, sf_dir):
    """The items of the pages' menus, which get the classes of lists of trains; other lists don't."""
    marked = F.replace("html", F.lit("<nav><ul>"), F.lit('<nav><div class="box train_index_cz"><ul class="clearfix">'))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("items", pages.extract_list_items(marked)).where(F.size("items") > 0)
    return rows.select("page_id", F.array_join(pages.numbered_items(F.col("items")), "\n").alias("items"))


@query(TAGGED + "SELECT name, CAST(count(*) AS BIGINT) AS n FROM v_tagged_points WHERE name <> '' GROUP BY name ORDER BY n DESC, name LIMIT 30")
def t4_top_names(spark, sf_dir):
    return profile.top_names(view(spark, sf_dir, "v_tagged_points"))


@query(duck("v_route_points", "v_coords") + """, d AS (SELECT c.name, p.lng, p.lat, sqrt(pow(p.lng - c.lng, 2) + pow(p.lat - c.lat, 2)) AS degrees FROM v_coords c CROSS JOIN v_route_points p)
SELECT name, round(degrees, 6) AS degrees, lng, lat FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY degrees, lng, lat) AS rk FROM d) x WHERE rk = 1""")
def j10_nearest_node(spark, sf_dir):
    found = network.nearest_node(view(spark, sf_dir, "v_coords"), view(spark, sf_dir, "v_route_points"))
    return found.select("name", F.round("degrees", 6).alias("degrees"), "lng", "lat")


@query(STEPS + ", k AS (SELECT route, CAST(count(*) AS BIGINT) AS points, round(sum(step_km), 1) AS km FROM s WHERE contains(route, '2') GROUP BY route)\nSELECT k.route, k.points, k.km, min(p.lat) AS south, max(p.lat) AS north FROM k JOIN v_route_points p ON k.route = p.route GROUP BY k.route, k.points, k.km")
def a27_routes_by_name(spark, sf_dir):
    return network.routes_by_name(view(spark, sf_dir, "v_route_points"), "2")


@query(POINTS + "SELECT route, idx FROM v_route_points WHERE idx < 10")
def w5_first_lines(spark, sf_dir):
    points = view(spark, sf_dir, "v_route_points").select("route", "idx", F.col("idx").alias("fid"))
    return network.first_lines(points).select("route", "idx")


LEGS_NAMED = also("v_stops") + """, named AS (SELECT CAST(train_no AS VARCHAR) AS train_code, ord, replace(station, '站', '') AS station FROM v_stops),
leg AS (SELECT train_code, ord, station AS a, b FROM (SELECT *, lead(station) OVER (PARTITION BY train_code ORDER BY ord) AS b FROM named) x WHERE b IS NOT NULL)
"""


@query(MATCHED + LEGS_NAMED + ", k AS (SELECT route, name FROM m WHERE km < 5)\nSELECT DISTINCT leg.a, leg.b, x.route FROM leg JOIN k x ON leg.a = x.name JOIN k y ON leg.b = y.name AND x.route = y.route")
def s3_routes_in_common(spark, sf_dir):
    """Routes that pass both stations of a leg of a train."""
    return network.routes_in_common(named_legs(spark, sf_dir).select("a", "b"), matches(spark, sf_dir).select("name", "route"))


@query(NAMED + "SELECT n.train_code AS route, n.ord - 1 AS at, n.station AS name, c.lng, c.lat FROM named n JOIN v_coords c ON n.station = c.name")
def j16_route_line_points(spark, sf_dir):
    routes = named_stops(spark, sf_dir).groupBy(F.col("train_code").alias("route")).agg(F.array_sort(F.collect_list(F.struct("ord", "station"))).alias("s"))
    placed = network.route_line_points(routes.select("route", F.transform("s", lambda x: x["station"]).alias("stations")), view(spark, sf_dir, "v_coords"))
    return placed.withColumn("at", F.col("at").cast("long"))


def both_ways(spark, sf_dir):
    found = segments(spark, sf_dir)
    return found.select(F.col("station_a").alias("a"), F.col("station_b").alias("b")).union(found.select("station_b", "station_a")).distinct()


def stored_segments(spark, sf_dir):
    kept = segments(spark, sf_dir).select("station_a", "station_b", "route", "i", "j")
    return track.segment_points(kept, view(spark, sf_dir, "v_route_points")).select("station_a", "station_b", "route", "points")


@query(SEGMENTS + ", u AS (SELECT station_a AS a, station_b AS b, km FROM seg UNION ALL SELECT station_b, station_a, km FROM seg)\nSELECT a, b, round(min(km), 6) AS km FROM u GROUP BY a, b")
def j12_direct_segment(spark, sf_dir):
    found = trajectories.direct_segments(both_ways(spark, sf_dir), stored_segments(spark, sf_dir))
    return found.select("a", "b", F.round(geo.trajectory_km(F.col("points")), 6).alias("km"))


def route_stations(spark, sf_dir):
    order = Window.partitionBy("route").orderBy("idx", "name")
    return matches(spark, sf_dir).select("route", "name", F.row_number().over(order).alias("at"))


def train_stations(spark, sf_dir):
    rides = numbered_stops(spark, sf_dir).groupBy("train_no").agg(F.array_sort(F.collect_list(F.struct("ord", "station"))).alias("s"))
    return rides.select(F.col("train_no").cast("string").alias("train_code"), F.transform("s", lambda x: x["station"]).alias("stations"))


def numbered_stops(spark, sf_dir):
    """named_stops by number: the stops of a train are together already, and aren't shuffled again."""
    return view(spark, sf_dir, "v_stops").select("train_no", "ord", text.normalize_station_name(F.col("station")).alias("station"))


def named_legs(spark, sf_dir):
    line = Window.partitionBy("train_no").orderBy("ord")
    legs = numbered_stops(spark, sf_dir).select(F.col("train_no").cast("string").alias("train_code"), F.col("ord").alias("seq"), F.col("station").alias("a"), F.lead("station").over(line).alias("b"))
    return legs.where("b IS NOT NULL")


@query(MATCHED + LEGS_NAMED + """, k AS (SELECT route, name, row_number() OVER (PARTITION BY route ORDER BY idx, name) AS at FROM m WHERE km < 5),
asked AS (SELECT DISTINCT train_code, a, b FROM leg WHERE a <> b),
cov AS (SELECT n.train_code, k.route, count(DISTINCT k.name) AS cov FROM named n JOIN k ON n.station = k.name GROUP BY n.train_code, k.route),
r AS (SELECT l.train_code, l.a, l.b, x.route, x.at AS i, y.at AS j, row_number() OVER (PARTITION BY l.train_code, l.a, l.b ORDER BY 100 * c.cov - abs(x.at - y.at) - 1 DESC, x.route) AS rk
FROM asked l JOIN k x ON l.a = x.name JOIN k y ON l.b = y.name AND x.route = y.route JOIN cov c ON c.train_code = l.train_code AND c.route = x.route)
SELECT r.train_code, r.a, r.b, r.route, string_agg(k.name, '|' ORDER BY CASE WHEN i > j THEN -k.at ELSE k.at END) AS stations FROM r JOIN k ON k.route = r.route AND k.at BETWEEN least(i, j) AND greatest(i, j) WHERE rk = 1 GROUP BY r.train_code, r.a, r.b, r.route""")
def j13_common_routes(spark, sf_dir):
    found = track.common_routes(named_legs(spark, sf_dir), train_stations(spark, sf_dir), route_stations(spark, sf_dir))
    return found.withColumn("stations", F.array_join("stations", "|"))


def found_legs(spark, sf_dir):
    """Every leg of every train by reference, and the points that the references are into."""
    points = kept(track.with_along(view(spark, sf_dir, "v_route_points")))
    near = stored(network.stations_on_route(view(spark, sf_dir, "v_coords"), points))
    at = near.select("route", "name", F.row_number().over(Window.partitionBy("route").orderBy("idx", "name")).alias("at"))
    segs = stored(network.build_segments(near, points).select("station_a", "station_b", "route", "i", "j", "km"))
    return track.find_references(named_legs(spark, sf_dir), train_stations(spark, sf_dir), stored(view(spark, sf_dir, "v_coords")), segs, stored(at), points), points


def _near_sql(km: int, name: str) -> str:
    """Vertices near each station, at most 8 of a route and over 50 apart, as a table of that name (place, route, idx, km)."""
    return f""",
{name}_d AS (SELECT c.name AS place, p.route, p.idx, c.lng, c.lat, {KM.format(lng1="c.lng", lat1="c.lat", lng2="p.lng", lat2="p.lat")} AS km FROM v_coords c JOIN v_route_points p ON abs(p.lng - c.lng) < {km / 30:g} AND abs(p.lat - c.lat) < {km / 30:g}),
{name}_m AS (SELECT x.place, x.route, x.idx, x.km FROM {name}_d x JOIN (SELECT route, min(lng) AS w, max(lng) AS e, min(lat) AS s, max(lat) AS n FROM v_route_points GROUP BY route) y ON x.route = y.route
  WHERE x.km <= {km} AND x.lng BETWEEN y.w - {km} / 111e0 AND y.e + {km} / 111e0 AND x.lat BETWEEN y.s - {km} / 111e0 AND y.n + {km} / 111e0),
{name}_v AS (SELECT DISTINCT place, route, min({{'km': km, 'idx': idx}}) OVER (PARTITION BY place, route ORDER BY idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM {name}_m),
{name} AS (SELECT place, route, v.idx AS idx, v.km AS km FROM (SELECT place, route, unnest(list_reduce(list_transform(list_sort(list(v)), lambda x: [x]),
  lambda kept, x: CASE WHEN len(kept) < 8 AND len(list_filter(kept, lambda k: abs(k.idx - x[1].idx) <= 50)) = 0 THEN list_concat(kept, x) ELSE kept END)) AS v FROM {name}_v GROUP BY place, route) x)"""


def _stretch_sql(pairs: str, near: str, name: str) -> str:
    """The best stretch for each of pairs (a, b, direct_km), as a table of that name (a, b, route, i, j, km)."""
    return f""",
{name} AS (SELECT a, b, route, i, j, km FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY gain - off_a - off_b - km * 0.01e0 DESC, route, i, j) AS rk FROM (
  SELECT *, CASE WHEN direct_km <= 0.1e0 THEN 0e0 WHEN km <= 1.5e0 * direct_km THEN 100e0 WHEN km <= 2 * direct_km THEN 50e0 WHEN km <= 3 * direct_km THEN 20e0 ELSE 0e0 END AS gain FROM (
  SELECT q.a, q.b, q.direct_km, x.route, x.idx AS i, y.idx AS j, x.km AS off_a, y.km AS off_b, abs(u.rkm - w.rkm) AS km FROM {pairs} q JOIN {near} x ON x.place = q.a JOIN {near} y ON y.place = q.b AND y.route = x.route
  JOIN cu u ON u.route = x.route AND u.idx = x.idx JOIN cu w ON w.route = y.route AND w.idx = y.idx WHERE x.idx <> y.idx) o
  WHERE direct_km <= 0.1e0 OR km BETWEEN 0.5e0 * direct_km AND 4 * direct_km) g) r WHERE rk = 1)"""


_DIRECT = KM.format(lng1="x.lng", lat1="x.lat", lng2="y.lng", lat2="y.lat")
FOUND = SEGMENTS + LEGS_NAMED + f""",
rides AS (SELECT DISTINCT train_code, a, b FROM leg WHERE a IN (SELECT name FROM v_coords) AND b IN (SELECT name FROM v_coords)),
pr AS (SELECT p.a, p.b, x.lng AS lng1, x.lat AS lat1, y.lng AS lng2, y.lat AS lat2, {_DIRECT} AS direct_km FROM (SELECT DISTINCT a, b FROM rides) p JOIN v_coords x ON p.a = x.name JOIN v_coords y ON p.b = y.name),
both_ways AS (SELECT station_a AS a, station_b AS b, route, i, j, km FROM seg UNION ALL SELECT station_b, station_a, route, j, i, km FROM seg),
sh AS (SELECT a, b, route, i, j, km FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY km, route, i, j) AS rk FROM both_ways) x WHERE rk = 1),
held AS (SELECT sh.* FROM pr JOIN sh ON pr.a = sh.a AND pr.b = sh.b WHERE pr.direct_km < 0.1e0 OR sh.km <= 3 * pr.direct_km),
lf AS (SELECT r.* FROM rides r LEFT JOIN held h ON r.a = h.a AND r.b = h.b WHERE h.a IS NULL),
num AS (SELECT route, name, row_number() OVER (PARTITION BY route ORDER BY idx, name) AS no FROM k),
ix AS (SELECT DISTINCT n.route, n.name, n.no FROM num n JOIN (SELECT station_a AS name, route FROM seg UNION SELECT station_b, route FROM seg) s ON n.route = s.route AND n.name = s.name),
cov AS (SELECT n.train_code, k.route, count(DISTINCT k.name) AS cov FROM named n JOIN k ON n.station = k.name GROUP BY n.train_code, k.route),
way AS (SELECT train_code, a, b, route, i, j FROM (SELECT l.train_code, l.a, l.b, x.route, x.no AS i, y.no AS j, row_number() OVER (PARTITION BY l.train_code, l.a, l.b ORDER BY 100 * c.cov - abs(x.no - y.no) - 1 DESC, x.route) AS rk
  FROM lf l JOIN ix x ON l.a = x.name JOIN ix y ON l.b = y.name AND x.route = y.route JOIN cov c ON c.train_code = l.train_code AND c.route = x.route WHERE l.a <> l.b) r WHERE rk = 1),
hop AS (SELECT w.train_code, w.a, w.b, abs(n.no - w.i) AS "at", n.name AS x, m.name AS y FROM way w JOIN num n ON n.route = w.route AND n.no BETWEEN least(w.i, w.j) AND greatest(w.i, w.j) JOIN num m ON m.route = w.route AND m.no = n.no + CASE WHEN w.i <= w.j THEN 1 ELSE -1 END AND m.no BETWEEN least(w.i, w.j) AND greatest(w.i, w.j)),
piece AS (SELECT h.train_code, h.a, h.b, h."at", s.route, s.i, s.j, coalesce(s.km, {_DIRECT}) AS km, coalesce(u.lng, x.lng) AS plng, coalesce(u.lat, x.lat) AS plat, coalesce(w.lng, y.lng) AS qlng, coalesce(w.lat, y.lat) AS qlat
  FROM hop h JOIN v_coords x ON h.x = x.name JOIN v_coords y ON h.y = y.name LEFT JOIN sh s ON s.a = h.x AND s.b = h.y LEFT JOIN cu u ON u.route = s.route AND u.idx = s.i LEFT JOIN cu w ON w.route = s.route AND w.idx = s.j),
joint AS (SELECT *, lag(qlng) OVER w AS blng, lag(qlat) OVER w AS blat FROM piece WINDOW w AS (PARTITION BY train_code, a, b ORDER BY piece."at")),
own AS (SELECT train_code, a, b, count(*) AS pieces, string_agg(coalesce(concat(route, ':', CAST(i AS VARCHAR), '-', CAST(j AS VARCHAR)), '-'), ' ' ORDER BY joint."at") AS line,
  sum(CASE WHEN route IS NULL THEN 2 ELSE abs(i - j) + 1 END - CASE WHEN blng IS NOT NULL AND (route IS NULL OR (abs(blng - plng) < 0.001e0 AND abs(blat - plat) < 0.001e0)) THEN 1 ELSE 0 END) AS points,
  sum(km + CASE WHEN blng IS NULL THEN 0e0 ELSE {KM.format(lng1="blng", lat1="blat", lng2="plng", lat2="plat")} END) AS km FROM joint GROUP BY train_code, a, b),
op AS (SELECT DISTINCT pr.* FROM pr JOIN lf ON pr.a = lf.a AND pr.b = lf.b LEFT JOIN own ON own.train_code = lf.train_code AND own.a = lf.a AND own.b = lf.b WHERE own.a IS NULL)""" + _near_sql(15, "n15") + _stretch_sql("op", "n15", "t15") + """,
op2 AS (SELECT op.* FROM op LEFT JOIN t15 ON op.a = t15.a AND op.b = t15.b WHERE t15.a IS NULL)""" + _near_sql(30, "n30") + _stretch_sql("op2", "n30", "t30") + """,
one AS (SELECT a, b, 'cache' AS source, route, i, j, km FROM held UNION ALL SELECT a, b, 'trajectory', route, i, j, km FROM t15 UNION ALL SELECT a, b, 'trajectory_wide', route, i, j, km FROM t30),
every AS (SELECT pr.a, pr.b, coalesce(one.source, 'fallback') AS source, one.route, one.i, one.j, coalesce(one.km, pr.direct_km) AS km FROM pr LEFT JOIN one ON pr.a = one.a AND pr.b = one.b),
found AS (SELECT leg.train_code, leg.ord AS seq, leg.a, leg.b, CASE WHEN e.a IS NULL THEN 'no_station' WHEN o.a IS NOT NULL THEN 'intermediate' ELSE e.source END AS source,
  CASE WHEN o.a IS NOT NULL THEN o.line WHEN e.route IS NOT NULL THEN concat(e.route, ':', CAST(e.i AS VARCHAR), '-', CAST(e.j AS VARCHAR)) WHEN e.a IS NOT NULL THEN '-' END AS pieces,
  CAST(CASE WHEN o.a IS NOT NULL THEN o.points WHEN e.route IS NOT NULL THEN abs(e.i - e.j) + 1 WHEN e.a IS NOT NULL THEN 2 END AS BIGINT) AS points, CASE WHEN o.a IS NOT NULL THEN o.km ELSE e.km END AS km
  FROM leg LEFT JOIN every e ON leg.a = e.a AND leg.b = e.b LEFT JOIN own o ON o.train_code = leg.train_code AND o.a = leg.a AND o.b = leg.b)
"""


@query(FOUND + "SELECT train_code, seq, a, b, source, pieces, points, round(km, 6) AS km FROM found")
def g13_find_segments(spark, sf_dir):
    """Every leg of every train with what its track was found by: its pieces as line:i-j (- is straight), their vertices and km."""
    found, _ = found_legs(spark, sf_dir)
    spelled = F.transform("pieces", lambda x: F.coalesce(F.concat(x["route"], F.lit(":"), x["i"].cast("string"), F.lit("-"), x["j"].cast("string")), F.lit("-")))
    there = F.col("pieces").isNotNull()
    told = found.withColumns({"points": F.when(there, track.vertices_of(F.col("pieces"))), "km": F.when(there, F.round(track.km_of(F.col("pieces")), 6))})
    return told.withColumn("pieces", F.when(there, F.array_join(spelled, " "))).select("train_code", "seq", "a", "b", "source", "pieces", "points", "km")


@query(FOUND + """SELECT train_code, count(*) FILTER (source IN ('cache', 'intermediate', 'trajectory')) AS found, count(*) FILTER (source = 'trajectory_wide') AS wide, count(*) FILTER (source = 'fallback') AS fallback,
count(*) FILTER (source = 'no_station') AS no_station, round(sum(coalesce(km, 0e0)), 4) AS km, coalesce(string_agg(concat(a, '→', b), ',' ORDER BY seq) FILTER (source = 'no_station'), '') AS unmatched FROM found GROUP BY train_code""")
def a22_trip_kinds(spark, sf_dir):
    found, _ = found_legs(spark, sf_dir)
    return track.trip_kinds(found).withColumns({"km": F.round("km", 4), "unmatched": F.array_join("unmatched", ",")})


@query()
def a22_trip_summary(spark, sf_dir):
    return track.trip_totals(*found_legs(spark, sf_dir)).withColumn("km", F.round("km", 3))


@query(duck("v_route_points", "v_coords") + _near_sql(15, "n15") + "\nSELECT place, route, idx, round(km, 6) AS km FROM n15")
def g10_nearby_vertices(spark, sf_dir):
    near = track.nearby_vertices(view(spark, sf_dir, "v_coords").withColumnRenamed("name", "place"), view(spark, sf_dir, "v_route_points"))
    return near.withColumn("km", F.round("km", 6))


@query(SEGMENTS + LEGS_NAMED + f""",
pr AS (SELECT p.a, p.b, {_DIRECT} AS direct_km FROM (SELECT DISTINCT a, b FROM leg WHERE a <> b) p JOIN v_coords x ON p.a = x.name JOIN v_coords y ON p.b = y.name)""" + _near_sql(15, "n15") + _stretch_sql("pr", "n15", "t15") + "\nSELECT a, b, route, i, j, round(km, 6) AS km FROM t15")
def g11_trajectory_segment(spark, sf_dir):
    """The best stretch between the stations of every leg."""
    pairs = named_legs(spark, sf_dir).where("a <> b").select("a", "b").distinct()
    found = track.trajectory_segment(kept(pairs), view(spark, sf_dir, "v_coords"), kept(track.with_along(view(spark, sf_dir, "v_route_points"))))
    return found.withColumn("km", F.round("km", 6))


@query(LOCATED + "SELECT route, name, idx, round(km, 6) AS km FROM w WHERE rk = 1 AND km <= 5")
def w4_locate_stations(spark, sf_dir):
    """Every station on each of the routes that come within 15 km of it, by the nearest vertex."""
    points, coords = kept(view(spark, sf_dir, "v_route_points")), view(spark, sf_dir, "v_coords")
    near = network.routes_near_point(coords.withColumnRenamed("name", "place"), points).select("route", F.col("place").alias("name"))
    return network.locate_stations(near.join(coords, "name"), points).withColumn("km", F.round("km", 6))


@query(duck("v_route_points", "v_coords") + """, b AS (SELECT route, idx // 50 AS fid, min(lng) AS minx, max(lng) AS maxx, min(lat) AS miny, max(lat) AS maxy FROM v_route_points GROUP BY route, idx // 50),
f AS (SELECT b.route, c.name, min(b.fid) AS fid FROM b JOIN v_coords c ON c.lng BETWEEN minx - 0.015e0 AND maxx + 0.015e0 AND c.lat BETWEEN miny - 0.015e0 AND maxy + 0.015e0 GROUP BY b.route, c.name),
s AS (SELECT route, string_agg(name, ',' ORDER BY fid, name) AS names FROM f GROUP BY route), r AS (SELECT DISTINCT route FROM v_route_points)
SELECT r.route, concat_ws(',', concat(r.route, '-from'), concat(r.route, '-to'), s.names) AS stations FROM r LEFT JOIN s ON r.route = s.route""")
def j8_stations_near_lines(spark, sf_dir):
    """Routes in lines of 50 vertices, with the stations in the lines' boxes."""
    points = view(spark, sf_dir, "v_route_points")
    routes = points.select("route", F.concat("route", F.lit("-from")).alias("from_station"), F.concat("route", F.lit("-to")).alias("to_station")).distinct()
    boxes = points.groupBy("route", F.floor(F.col("idx") / 50).alias("fid")).agg(F.min("lng").alias("minx"), F.max("lng").alias("maxx"), F.min("lat").alias("miny"), F.max("lat").alias("maxy"))
    return network.stations_near_lines(routes, boxes, view(spark, sf_dir, "v_coords")).withColumn("stations", F.array_join("stations", ","))


@query(SEGMENTS + """, kind AS (SELECT route, CASE WHEN j <= i THEN 'v' WHEN direct_km < 0.1 THEN 'n' WHEN km > 3 * direct_km THEN 'l' ELSE 'k' END AS k FROM dk)
SELECT CAST(sum(CASE WHEN k = 'k' THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN k = 'v' THEN 1 ELSE 0 END) AS BIGINT) AS same_vertex, CAST(sum(CASE WHEN k = 'n' THEN 1 ELSE 0 END) AS BIGINT) AS too_near,
CAST(sum(CASE WHEN k = 'l' THEN 1 ELSE 0 END) AS BIGINT) AS too_long, CAST(count(DISTINCT CASE WHEN k = 'k' THEN route END) AS BIGINT) AS routes FROM kind""")
def a26_segment_counters(spark, sf_dir):
    return network.segment_counters(matches(spark, sf_dir), view(spark, sf_dir, "v_route_points"))


@query(SEGMENTS + ", u AS (SELECT station_a AS station, route FROM seg UNION SELECT station_b, route FROM seg)\nSELECT station, string_agg(route, ',' ORDER BY route) AS routes FROM u GROUP BY station")
def a17_build_station_index(spark, sf_dir):
    return network.build_station_index(segments(spark, sf_dir)).withColumn("routes", F.array_join("routes", ","))


@query(AT + "SELECT route, v.at, lng, lat FROM v")
def g5_rebuild_from_lines(spark, sf_dir):
    """Ways of 5 vertices that share their ends, some turned round and one repeated, chained to the whole route again."""
    points = view(spark, sf_dir, "v_route_points")
    seats = points.withColumn("ord", F.explode(F.array(F.floor(F.col("idx") / 4), F.floor((F.col("idx") - 1) / 4)))).where("ord >= 0").distinct()
    ways = seats.groupBy("route", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lng", "lat"))), lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("points"))
    ways = ways.withColumn("points", F.when(F.col("ord") % 3 == 2, F.reverse("points")).otherwise(F.col("points")))
    ways = ways.union(ways.where("ord = 4").select("route", F.lit(9_999_999).alias("ord"), F.reverse("points")))
    return by_vertex(trajectories.rebuild_from_lines(ways))


LEGS = NAMED + ", l AS (SELECT train_code, ord, station AS a, lead(station) OVER (PARTITION BY train_code ORDER BY ord) AS b FROM named), p AS (SELECT DISTINCT l.a, l.b, x.lng AS lng1, x.lat AS lat1, y.lng AS lng2, y.lat AS lat2 FROM l JOIN v_coords x ON l.a = x.name JOIN v_coords y ON l.b = y.name)\n"


def leg_ends(spark, sf_dir):
    legs = journeys.train_legs_with_coords(named_stops(spark, sf_dir), view(spark, sf_dir, "v_coords"))
    return legs.select("a", "b", "lng_a", "lat_a", "lng_b", "lat_b").distinct()


@query(LEGS + f"SELECT a, b, round({KM.format(lng1='lng1', lat1='lat1', lng2='lng2', lat2='lat2')}, 6) AS km FROM p")
def p1_distance_km(spark, sf_dir):
    return leg_ends(spark, sf_dir).select("a", "b", F.round(geo.distance_km(F.col("lng_a"), F.col("lat_a"), F.col("lng_b"), F.col("lat_b")), 6).alias("km"))


@query(LEGS + "SELECT a, b, round(2 * 6371008.8e0 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2))), 2) AS meters FROM p")
def p2_haversine_m(spark, sf_dir):
    return leg_ends(spark, sf_dir).select("a", "b", F.round(geo.haversine_m(F.col("lng_a"), F.col("lat_a"), F.col("lng_b"), F.col("lat_b")), 2).alias("meters"))


@query()
def p2_geodesic_m(spark, sf_dir):
    return leg_ends(spark, sf_dir).select("a", "b", F.round(geo.geodesic_m("lng_a", "lat_a", "lng_b", "lat_b"), 3).alias("meters"))


@query(POINTS + "SELECT route, idx FROM v_route_points WHERE lng BETWEEN 75 AND 80 AND lat BETWEEN 15.3 AND 20")
def p7_in_bounds(spark, sf_dir):
    return view(spark, sf_dir, "v_route_points").where(geo.in_bounds(F.col("lng"), F.col("lat"), 75, 80, 15.3, 20)).select("route", "idx")


@query(POINTS + "SELECT route, CAST(sum(CASE WHEN lng BETWEEN 70 AND 140 AND lat BETWEEN 15 AND 55 THEN 0 ELSE 1 END) AS BIGINT) AS abnormal FROM v_route_points GROUP BY route")
def p8_count_abnormal_coords(spark, sf_dir):
    return network.count_abnormal_coords(view(spark, sf_dir, "v_route_points"))


@query(CODED + "SELECT train_code, CASE WHEN substr(train_code, 1, 1) IN ('G', 'D') THEN train_code ELSE concat(train_code, '.') END AS line, CASE WHEN substr(train_code, 1, 1) IN ('G', 'D') THEN train_code END AS number FROM trains")
def p14_parse_train_number(spark, sf_dir):
    """Codes of classes G and D as they are, others with a dot and nothing after it."""
    line = F.when(F.substring("train_code", 1, 1).isin("G", "D"), F.col("train_code")).otherwise(F.concat("train_code", F.lit(".")))
    return trains(spark, sf_dir).select("train_code", line.alias("line"), text.parse_train_number(line).alias("number"))


@query(duck("v_stops") + "SELECT DISTINCT station, replace(replace(station, '站', '线'), '线', '') AS alt FROM v_stops")
def p17_alt_line_name(spark, sf_dir):
    named = view(spark, sf_dir, "v_stops").select("station").distinct()
    return named.select("station", text.alt_line_name(F.translate("station", "站", "线")).alias("alt"))


@query(TAGGED + "SELECT fid, CASE WHEN fid % 3 = 0 THEN name ELSE concat(name, '[', CAST(fid % 3 AS VARCHAR), ']') END AS key FROM v_tagged_points")
def p18_route_key(spark, sf_dir):
    ref = F.when(F.col("fid") % 3 == 0, F.lit("")).otherwise((F.col("fid") % 3).cast("string"))
    return view(spark, sf_dir, "v_tagged_points").select("fid", text.route_key(F.col("name"), ref).alias("key"))


@query(TAGGED + """SELECT fid FROM v_tagged_points WHERE other_tags LIKE '%"railway"=>"station"%' AND name <> ''""")
def p5_route_features(spark, sf_dir):
    """Points tagged as stations, their tags written as those of routes."""
    tags = F.replace("other_tags", F.lit('"railway"=>"station"'), F.lit('"route"=>"railway"'))
    return view(spark, sf_dir, "v_tagged_points").where(text.is_route_feature(F.col("name"), tags)).select("fid")


@query(POINTS + "SELECT route, CAST(20 - idx AS BIGINT) AS at, idx FROM v_route_points WHERE idx BETWEEN 10 AND 20 UNION ALL SELECT concat(route, '+'), CAST(idx - 10 AS BIGINT), idx FROM v_route_points WHERE idx BETWEEN 10 AND 20")
def g7_extract_segment(spark, sf_dir):
    """Vertices 10 to 20 of each route, taken backwards, and forwards (marked +)."""
    whole = view(spark, sf_dir, "v_route_points").groupBy("route").agg(F.array_sort(F.collect_list("idx")).alias("p"))
    both = whole.select("route", geo.segment(F.col("p"), F.lit(20), F.lit(10)).alias("s")).union(whole.select(F.concat("route", F.lit("+")), geo.segment(F.col("p"), F.lit(10), F.lit(20))))
    return both.select("route", F.posexplode("s").alias("at", "idx")).withColumn("at", F.col("at").cast("long"))


def whole_routes(spark, sf_dir):
    ordered = view(spark, sf_dir, "v_route_points").groupBy("route").agg(F.array_sort(F.collect_list(F.struct("idx", "lng", "lat"))).alias("p"))
    return ordered.select("route", F.transform("p", lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("points"))


@query(AT + "SELECT route, v.at, lng, lat FROM v UNION ALL SELECT route, v.at + 1, lng, lat FROM v WHERE (route, v.at) IN (SELECT (route, max(v.at)) FROM v GROUP BY route)")
def g4_simplify_trajectory(spark, sf_dir):
    """Every vertex twice: the repeats go but for the last, which is an end."""
    twice = whole_routes(spark, sf_dir).withColumn("points", F.flatten(F.transform("points", lambda p: F.array(p, p))))
    return by_vertex(twice.select("route", trajectories.simplify_trajectory("points").alias("points")))


@query(STEPS + """, cu AS (SELECT s.route, s.idx, p.lng, p.lat, sum(step_km) OVER (PARTITION BY s.route ORDER BY s.idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM s JOIN v_route_points p ON s.route = p.route AND s.idx = p.idx),
r AS (SELECT route, count(*) AS n, max(cum) AS km, greatest(2, CAST(floor(max(cum) * 25 / 100) AS BIGINT)) AS target FROM cu GROUP BY route),
w AS (SELECT route, n, k, k * km / (target - 1) AS wanted FROM (SELECT *, unnest(generate_series(1, target + 1)) AS k FROM r WHERE target < n AND km >= 0.01e0) x),
v AS (SELECT w.route, w.n, w.k, coalesce(cu.idx, w.n) AS v FROM w ASOF LEFT JOIN cu ON w.route = cu.route AND w.wanted <= cu.cum),
h AS (SELECT route, n, k + max(v - k) OVER (PARTITION BY route ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS idx FROM v),
e AS (SELECT route, idx FROM h WHERE idx < n - 1 UNION SELECT route, 0 FROM r UNION SELECT route, n - 1 FROM r UNION SELECT cu.route, cu.idx FROM cu JOIN r ON cu.route = r.route WHERE r.target >= r.n OR r.km < 0.01e0)
SELECT cu.route, CAST(row_number() OVER (PARTITION BY cu.route ORDER BY cu.idx) - 1 AS BIGINT) AS at, cu.lng, cu.lat FROM e JOIN cu ON e.route = cu.route AND e.idx = cu.idx""")
def g8_downsample(spark, sf_dir):
    return by_vertex(whole_routes(spark, sf_dir).select("route", trajectories.downsample("points").alias("points")))


@query(POINTS + """, e AS (SELECT route, idx // 50 AS ord, arg_min(lng, idx) AS west, arg_max(lng, idx) AS east, count(*) AS n FROM v_route_points GROUP BY route, idx // 50)
SELECT route, CAST(ord AS BIGINT) AS ord, CAST(n AS BIGINT) AS points, CASE WHEN ord % 3 = 2 THEN east ELSE west END AS lng FROM e""")
def w3_dedup_reversed_sublines(spark, sf_dir):
    """Which sub-lines stay, their vertices and where they begin."""
    kept = trajectories.dedup_reversed_sublines(route_lines(spark, sf_dir))
    return kept.select("route", F.col("ord").cast("long").alias("ord"), F.size("points").cast("long").alias("points"), F.element_at("points", 1)["lng"].alias("lng"))


@query(MATCHED + LEGS_NAMED + """, k AS (SELECT route, name, row_number() OVER (PARTITION BY route ORDER BY idx, name) AS at, count(*) OVER (PARTITION BY route) AS n FROM m WHERE km < 5),
cov AS (SELECT n.train_code, k.route, count(DISTINCT k.name) AS cov FROM named n JOIN k ON n.station = k.name GROUP BY n.train_code, k.route)
SELECT l.train_code, CAST(l.ord - 1 AS BIGINT) AS at, l.a, l.b, x.route AS line_name, CAST(x.n AS BIGINT) AS line_length, CAST(abs(x.at - y.at) AS BIGINT) AS distance, round(c.cov / x.n, 9) AS coverage
FROM leg l JOIN k x ON l.a = x.name JOIN k y ON l.b = y.name AND x.route = y.route JOIN cov c ON c.train_code = l.train_code AND c.route = x.route WHERE l.a <> l.b""")
def j14_candidate_lines(spark, sf_dir):
    """Lines as in g17_match_lines."""
    lists = route_stations(spark, sf_dir).groupBy(F.col("route").alias("line_name")).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("s"))
    table = lists.select("line_name", F.hash("line_name").alias("line_ord"), F.transform("s", lambda x: x["name"]).alias("stations"))
    found = lines.candidate_lines(train_stations(spark, sf_dir), table)
    return found.select("train_code", F.col("at").cast("long").alias("at"), "a", "b", "line_name", F.col("line_length").cast("long").alias("line_length"), F.col("distance").cast("long").alias("distance"), F.round("coverage", 9).alias("coverage"))


@query(duck("v_coords") + "SELECT name, lng, lat FROM v_coords WHERE lng BETWEEN 70 AND 140 AND lat BETWEEN 15 AND 55")
def a15_station_coords(spark, sf_dir):
    """Each station twice, the second time as one with the station sign and elsewhere: the first by fid stays."""
    coords = view(spark, sf_dir, "v_coords")
    first = coords.select(F.lit(1).alias("fid"), "name", F.struct("lng", "lat").alias("point"))
    second = coords.select(F.lit(2).alias("fid"), F.concat("name", F.lit("站")).alias("name"), F.struct((F.col("lng") + 1).alias("lng"), "lat").alias("point"))
    return network.station_coords(first.union(second))


@query(duck("v_coords") + "SELECT CAST(count(*) FILTER (lng BETWEEN 70 AND 140 AND lat BETWEEN 15 AND 55) AS BIGINT) AS valid, CAST(2 * count(*) FILTER (NOT (lng BETWEEN 70 AND 140 AND lat BETWEEN 15 AND 55)) + 1 AS BIGINT) AS failed, CAST(count(*) FILTER (lng BETWEEN 70 AND 140 AND lat BETWEEN 15 AND 55) AS BIGINT) AS duplicate FROM v_coords")
def a15_station_coord_counters(spark, sf_dir):
    """Each station twice, the second time with the station sign, and a point without a name."""
    coords = view(spark, sf_dir, "v_coords")
    first = coords.select(F.lit(1).alias("fid"), "name", F.struct("lng", "lat").alias("point"))
    second = coords.select(F.lit(2).alias("fid"), F.concat("name", F.lit("站 ")).alias("name"), F.struct("lng", "lat").alias("point"))
    nameless = coords.agg(F.lit(3).alias("fid"), F.lit(" ").alias("name"), F.struct(F.max("lng").alias("lng"), F.max("lat").alias("lat")).alias("point"))
    return network.station_coord_counters(first.union(second).union(nameless))


@query(AT + ", b AS (SELECT route, max(v.at) AS n FROM v GROUP BY route)\nSELECT v.route AS name, v.at, v.lng, v.lat FROM v JOIN b ON v.route = b.route WHERE v.at < b.n")
def a16_route_geometries(spark, sf_dir):
    """Each route by fid: the whole of it, all but its last vertex, and a single one, which doesn't count."""
    whole = whole_routes(spark, sf_dir).withColumn("n", F.size("points"))
    parts = [whole.select(F.lit(fid).alias("fid"), F.col("route").alias("name"), F.slice("points", F.lit(1), n).alias("points")) for fid, n in ((1, F.col("n")), (2, F.col("n") - 1), (3, F.lit(1)))]
    return by_vertex(network.route_geometries(parts[0].union(parts[1]).union(parts[2])).withColumnRenamed("name", "route")).withColumnRenamed("route", "name")


@query("SELECT CAST(doc_id % 4 + 1 AS VARCHAR) AS run, CASE doc_id % 4 + 1 WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'CANCEL' WHEN 3 THEN 'DONE' ELSE 'FAIL' END AS label, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2 UNION ALL SELECT '0', 'UNSTART', CAST(0 AS BIGINT)")
def a24_parse_status_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return profile.parse_status_counts(docs.select((F.col("doc_id") % 4 + 1).cast("string").alias("run")))


@query("SELECT run, CAST(rank AS BIGINT) AS rank, doc_id FROM (SELECT CAST(doc_id % 4 + 1 AS VARCHAR) AS run, doc_id, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS rank FROM documents) x WHERE rank <= 5")
def a24_parse_status_samples(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return profile.parse_status_samples(docs.select((F.col("doc_id") % 4 + 1).cast("string").alias("run"), "doc_id"))


@query(TAGGED + """SELECT fid, name FROM v_tagged_points WHERE regexp_extract(other_tags, '"railway"=>"([^"]*)"', 1) = 'switch' AND name <> ''""")
def p6_is_rail_line(spark, sf_dir):
    points = view(spark, sf_dir, "v_tagged_points").withColumn("tags", text.parse_tags(F.col("other_tags")))
    return points.where(text.is_rail_line(F.col("name"), F.col("tags")["railway"], "switch")).select("fid", "name")


@query(STEPS + ", k AS (SELECT route, round(sum(step_km), 1) AS km FROM s GROUP BY route)\nSELECT route, km FROM k ORDER BY km, route LIMIT 20")
def t3_shortest_routes(spark, sf_dir):
    return network.longest_routes(view(spark, sf_dir, "v_route_points"), 20, ascending=True)


@query(duck("v_route_points") + """, n AS (SELECT DISTINCT lng, lat FROM v_route_points), l AS (SELECT lng AS u_lng, lat AS u_lat, lead(lng) OVER (PARTITION BY route ORDER BY idx) AS v_lng, lead(lat) OVER (PARTITION BY route ORDER BY idx) AS v_lat FROM v_route_points),
e AS (SELECT DISTINCT least((u_lng, u_lat), (v_lng, v_lat)) AS u, greatest((u_lng, u_lat), (v_lng, v_lat)) AS v FROM l WHERE v_lng IS NOT NULL)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM n) AS nodes, CAST(count(*) AS BIGINT) AS edges FROM e""")
def a25_graph_sizes(spark, sf_dir):
    return network.graph_counts(network.graph_edges(view(spark, sf_dir, "v_route_points"))).drop("meters")


@query()
def a25_graph_counts(spark, sf_dir):
    return network.graph_counts(network.graph_edges(view(spark, sf_dir, "v_route_points"))).withColumn("meters", F.round("meters", 1))
