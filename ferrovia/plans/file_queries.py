"""Registered queries of sources, sinks, geometries and lines: what is read back of files that are written from the driver's tables, beside SQL
over those tables."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wkb
from ..operators import lines, network, scans, trajectories
from ..sources import files, text_export
from ..sources.stored import kept, scratch, stored
from ..streaming import pages
from .queries import AT, CODED, MERGED, NAMED, PAIRS, by_vertex, merged_files, named_stops, query, route_lines, route_pairs, trains, whole_routes
from .views import duck, view

POINT = lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))


def written_texts(spark: SparkSession, docs: DataFrame, name: str) -> str:
    """docs (file_name, text) as files in a new folder of the shared one, which must be a mount."""
    folder, docs = scratch(spark, name), kept(docs)  # the writer looks at the names first
    text_export.write_text_files(docs, folder.removeprefix("file://").removeprefix("file:"), suffix="")
    return folder


@query(AT + ", e AS (SELECT route, max(v.at) AS n FROM v GROUP BY route)\nSELECT v.route, CAST(row_number() OVER (PARTITION BY v.route ORDER BY v.at) - 1 AS BIGINT) AS at, v.lng / 20 AS lng, v.lat / 20 AS lat FROM v JOIN e ON v.route = e.route WHERE v.at % 4 = 0 OR v.at = e.n")
def g4_simplify_points(spark, sf_dir):
    """Routes on a twentieth of their scale: vertices are 0.00015 degrees apart, so every fourth stays, and the last."""
    return scans.simplify_points(view(spark, sf_dir, "v_route_points").withColumns({"lng": F.col("lng") / 20, "lat": F.col("lat") / 20}))


def tracks(spark, sf_dir):
    """Ways of 5 vertices that share their ends, some turned round, one repeated, and beside each of 5 vertices a second track of three whose
    middle is the same."""
    points = view(spark, sf_dir, "v_route_points")
    seats = points.withColumn("ord", F.explode(F.array(F.floor(F.col("idx") / 4), F.floor((F.col("idx") - 1) / 4)))).where("ord >= 0").distinct()
    ways = seats.groupBy("route", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lng", "lat"))), POINT).alias("points"))
    ways = stored(ways.withColumn("points", F.when(F.col("ord") % 3 == 2, F.reverse("points")).otherwise(F.col("points"))))
    beside = lambda p: F.struct(p["lng"].alias("lng"), (p["lat"] + 0.002).alias("lat"))
    mid = F.get("points", F.lit(2))
    second = ways.where(F.size("points") == 5).select("route", F.col("ord") + 10_000_000, F.array(beside(F.get("points", F.lit(1))), mid, beside(F.get("points", F.lit(3)))))
    return ways.union(ways.where("ord = 4").select("route", F.lit(9_999_999), F.reverse("points"))).union(second)


@query(AT + "SELECT route, v.at, lng, lat FROM v")
def g5_rebuild_points(spark, sf_dir):
    """Second tracks and the repeat go, the ways are chained to the whole route again, as rows."""
    return scans.rebuild_points(tracks(spark, sf_dir))


@query(AT + """, c AS (SELECT *, max(v.at) OVER (PARTITION BY route) AS n FROM v)
SELECT route, NOT contains(route, '2') AS rebuilt, CAST(count(*) AS BIGINT) AS points, round(max(lng), 6) AS east FROM c GROUP BY route""")
def g6_complete_route(spark, sf_dir):
    """Routes of which only the first quarter is there, but for those with a 2 in their name, against the box of all of it."""
    points = view(spark, sf_dir, "v_route_points")
    boxes = points.groupBy("route").agg(F.min("lng").alias("minx"), F.max("lng").alias("maxx"), F.min("lat").alias("miny"), F.max("lat").alias("maxy"))
    quarter = F.when(F.col("route").contains("2"), F.col("points")).otherwise(F.slice("points", F.lit(1), F.greatest(F.floor(F.size("points") / 4).cast("int"), F.lit(2))))
    found = trajectories.complete_route(whole_routes(spark, sf_dir).withColumn("points", quarter), boxes, tracks(spark, sf_dir))
    return found.select("route", "rebuilt", F.size("points").cast("long").alias("points"), F.round(F.array_max(F.transform("points", lambda p: p["lng"])), 6).alias("east"))


def sublines(spark, sf_dir):
    """Each route as a list of its lines of 50 vertices, without repeats."""
    once = trajectories.dedup_reversed_sublines(route_lines(spark, sf_dir))
    return once.groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "points"))), lambda x: x["points"]).alias("sublines"))


_JOINED = AT + "SELECT route, CAST(row_number() OVER (PARTITION BY route ORDER BY idx) - 1 AS BIGINT) AS at, lng, lat FROM v WHERE idx % 50 > 0 OR idx = 0"


@query(_JOINED)
def g2_merge_sublines(spark, sf_dir):
    """All vertices in order, but those at which a line meets the one before it."""
    return by_vertex(sublines(spark, sf_dir).select("route", trajectories.merge_sublines("sublines", F.lit(10.0)).alias("points")))


@query(_JOINED)
def g15_merge_sublines_spatial(spark, sf_dir):
    return by_vertex(sublines(spark, sf_dir).select("route", trajectories.merge_sublines_spatial("sublines").alias("points")))


_INSIDE = duck("v_route_points") + """, b AS (SELECT route, min(lng) AS w, max(lng) AS e, min(lat) AS s, max(lat) AS n FROM v_route_points WHERE idx < 1000 GROUP BY route),
c AS (SELECT route, idx // 50 AS ord, min(idx) AS low, count(*) AS k FROM v_route_points GROUP BY route, idx // 50),
m AS (SELECT c.route, c.ord, k, p.lng BETWEEN b.w - 0.08 AND b.e + 0.08 AND p.lat BETWEEN b.s - 0.08 AND b.n + 0.08 AS inside FROM c JOIN b ON c.route = b.route
  JOIN v_route_points p ON p.route = c.route AND p.idx = c.low + CASE WHEN c.ord % 3 = 2 THEN k - 1 - k // 2 ELSE k // 2 END),
g AS (SELECT route, count(*) AS lines, count(*) FILTER (inside) AS held, sum(k) FILTER (inside) AS points FROM m GROUP BY route)
"""


def boxed_sublines(spark, sf_dir):
    """Sub-lines against the box of the first 1,000 vertices of their route."""
    first = view(spark, sf_dir, "v_route_points").where("idx < 1000").groupBy("route")
    boxes = first.agg(F.min("lng").alias("minx"), F.max("lng").alias("maxx"), F.min("lat").alias("miny"), F.max("lat").alias("maxy"))
    whole = sublines(spark, sf_dir)
    return whole, trajectories.filter_sublines_by_bbox(whole, boxes)


@query(_INSIDE + "SELECT route, CAST(held AS BIGINT) AS lines, CAST(points AS BIGINT) AS points, CAST(lines - held AS BIGINT) AS removed FROM g")
def g1_filter_sublines(spark, sf_dir):
    _, kept = boxed_sublines(spark, sf_dir)
    points = F.aggregate("sublines", F.lit(0).cast("long"), lambda n, x: n + F.size(x))
    return kept.select("route", F.size("sublines").cast("long").alias("lines"), points.alias("points"), F.col("removed").cast("long").alias("removed"))


@query(_INSIDE + """, a AS (SELECT *, contains(route, '1') AS bare, contains(route, '3') AS single FROM g)
SELECT CAST(count(*) FILTER (NOT bare AND NOT single) AS BIGINT) AS success, CAST(count(*) FILTER (bare) AS BIGINT) AS no_geom, CAST(count(*) FILTER (single AND NOT bare) AS BIGINT) AS empty,
CAST(sum(CASE WHEN bare THEN 0 ELSE lines END) AS BIGINT) AS sublines, CAST(sum(lines - held) AS BIGINT) AS removed, CAST(coalesce(sum(points) FILTER (NOT bare AND NOT single), 0) AS BIGINT) AS points FROM a""")
def a26_route_counters(spark, sf_dir):
    """Routes with a 1 in their name have no sub-lines, those with a 3 came to one vertex."""
    whole, kept = boxed_sublines(spark, sf_dir)
    both = whole.join(kept.select("route", F.col("sublines").alias("kept"), "removed"), "route")
    points = F.when(F.col("route").contains("3"), F.slice(F.flatten("kept"), 1, 1)).otherwise(F.flatten("kept"))
    found = network.route_counters(both.select("route", F.when(~F.col("route").contains("1"), F.col("sublines")).alias("sublines"), "removed", points.alias("points")))
    return found.select(*[F.col(c).cast("long").alias(c) for c in found.columns])


@query(AT + """, r AS (SELECT route, count(*) AS n FROM v GROUP BY route) SELECT route, true AS half, false AS tenth, false AS moved FROM r""")
def g16_is_parallel(spark, sf_dir):
    """Half of each route runs along it, a tenth is too short, and the half is too far from it when moved 11 km north."""
    cut = lambda part: F.slice("points", F.lit(1), F.greatest(F.floor(F.size("points") * part).cast("int"), F.lit(1)))
    rows = whole_routes(spark, sf_dir).select("route", "points", cut(0.5).alias("half"), cut(0.1).alias("tenth"))
    moved = F.transform("half", lambda p: F.struct(p["lng"].alias("lng"), (p["lat"] + 0.1).alias("lat")))
    asked = rows.withColumn("moved", moved)
    return asked.select("route", *[trajectories.is_parallel(c, "points").alias(c) for c in ("half", "tenth", "moved")])


@F.arrow_udf(T.BinaryType())
def _encoded_points(points: pa.Array) -> pa.Array:
    lng, lat = (x.to_pylist() for x in points.flatten())
    return pa.array([b"GP\0\x01" + struct.pack("<i", 4326) + struct.pack("<BI2d", 1, 1, x, y) for x, y in zip(lng, lat, strict=True)], pa.binary())


@F.arrow_udf(T.BinaryType())
def _encoded_lines(sublines: pa.Array) -> pa.Array:
    """Multilines with an envelope, big-endian in every other row."""
    out = []
    for i, parts in enumerate(trajectories.line_lists_in(sublines)):
        order, mark = ("<", 1) if i % 2 else (">", 0)
        body = b"".join(struct.pack(order + "BII", mark, 2, len(x)) + x.astype(order + "f8").tobytes() for x in parts)
        out.append(b"GP\0\x03" + struct.pack("<i4d", 4326, 0, 0, 0, 0) + struct.pack(order + "BII", mark, 5, len(parts)) + body)
    return pa.array(out, pa.binary())


@query(duck("v_coords") + "SELECT name, lng, lat FROM v_coords")
def p9_decode_point(spark, sf_dir):
    blobs = view(spark, sf_dir, "v_coords").select("name", _encoded_points(F.struct("lng", "lat")).alias("geom"))
    return blobs.select("name", wkb.decode_point("geom").alias("p")).select("name", "p.lng", "p.lat")


@query(duck("v_route_points") + "SELECT route, CAST(idx // 50 AS BIGINT) AS line, CASE WHEN idx // 50 % 3 = 2 THEN count(*) OVER w - 1 - idx % 50 ELSE idx % 50 END AS at, lng, lat FROM v_route_points WINDOW w AS (PARTITION BY route, idx // 50)")
def p10_decode_lines(spark, sf_dir):
    """Lines of 50 vertices, every third turned round, through multilines in both byte orders."""
    blobs = sublines(spark, sf_dir).select("route", _encoded_lines("sublines").alias("geom"))
    parts = blobs.select("route", F.posexplode(wkb.decode_lines("geom")).alias("line", "points")).select("route", "line", F.posexplode("points").alias("at", "p"))
    return parts.select("route", F.col("line").cast("long").alias("line"), F.col("at").cast("long").alias("at"), "p.lng", "p.lat")


_IN_FILES = duck("v_stops") + ", s AS (SELECT *, train_no // 2000 AS part FROM v_stops), o AS (SELECT train_no, row_number() OVER (PARTITION BY part ORDER BY train_no) - 1 AS place FROM (SELECT DISTINCT part, train_no FROM s) x)\n"


@query(_IN_FILES + "SELECT CAST(s.train_no AS VARCHAR) AS train_no, CAST(o.place AS BIGINT) AS train_ord, s.ord - 1 AS ord, trim(s.station) AS station_name, s.arrive, s.depart, CAST(s.station_no AS INT) AS station_no, s.start_station, s.end_station, s.train_class FROM s JOIN o ON s.train_no = o.train_no")
def io1_read_train_list(spark, sf_dir):
    """All trains in files of one object each, a file for every 2,000 numbers, read in blocks."""
    named = {"station_name": "station", "arrive_time": "arrive", "start_time": "depart", "station_no": "station_no", "start_station_name": "start_station", "end_station_name": "end_station", "train_class_name": "train_class"}
    stops = view(spark, sf_dir, "v_stops").groupBy("train_no").agg(F.array_sort(F.collect_list(F.struct("ord", *[F.col(c).cast("string").alias(k) for k, c in named.items()]))).alias("s"))
    entry = F.concat(F.lit('"'), F.col("train_no").cast("string"), F.lit('": '), F.to_json(F.transform("s", lambda x: F.struct(*[x[k].alias(k) for k in named]))))
    parts = stops.groupBy(F.floor(F.col("train_no") / 2000).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("train_no", entry.alias("e")))), lambda x: x["e"]), ",\n ").alias("text"))
    folder = written_texts(spark, parts.select(F.concat("part", F.lit(".json")).alias("file_name"), F.concat(F.lit("{"), F.col("text"), F.lit("}\n")).alias("text")), "train-lists")
    return files.read_train_list(spark, folder).withColumn("ord", F.col("ord").cast("long"))


@query(duck("v_train_codes") + "SELECT train_code, CAST(train_no AS VARCHAR) AS train_no, CAST(row_number() OVER (PARTITION BY train_no // 2000 ORDER BY train_no) - 1 AS INT) AS ord FROM v_train_codes")
def io2_read_train_codes(spark, sf_dir):
    """All codes in files of one object each, a file for every 2,000 numbers."""
    codes = view(spark, sf_dir, "v_train_codes")
    entry = F.concat(F.lit('"'), "train_code", F.lit('": "'), F.col("train_no").cast("string"), F.lit('"'))
    parts = codes.groupBy(F.floor(F.col("train_no") / 2000).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("train_no", entry.alias("e")))), lambda x: x["e"]), ", ").alias("text"))
    folder = written_texts(spark, parts.select(F.concat("part", F.lit(".json")).alias("file_name"), F.concat(F.lit("{"), F.col("text"), F.lit("}")).alias("text")), "train-codes")
    return files.read_train_codes(spark, folder)


@query(duck("v_train_codes") + "SELECT train_code, CASE WHEN train_class LIKE '1%' THEN 'urgent' ELSE 'other' END AS kind, CASE WHEN train_class LIKE '1%' THEN 0 ELSE 1 END AS file_rank FROM v_train_codes")
def io5_read_train_number_files(spark, sf_dir):
    """Codes in numbered lines, or lines without a number, by kind; a third kind has no file."""
    codes = view(spark, sf_dir, "v_train_codes").withColumn("line", F.when(F.col("train_no") % 2 == 0, F.concat(F.col("train_no").cast("string"), F.lit(". "), "train_code")).otherwise(F.col("train_code")))
    folder, urgent = scratch(spark, "numbers"), F.col("train_class").startswith("1")
    codes.where(urgent).select("line").write.text(f"{folder}/urgent")
    codes.where(~urgent).select("line").write.text(f"{folder}/other")
    return files.read_train_number_files(spark, {f"{folder}/urgent": "urgent", f"{folder}/other": "other", f"{folder}/none": "none"})


@query(MERGED + "SELECT train_code, replace(kind, '-', ' ') AS train_class FROM m WHERE kind NOT LIKE '1%'")
def io11_code_class_lines(spark, sf_dir):
    """Kinds with a dash make lines of three parts, which are dropped as they are read (IO6)."""
    path = f"{scratch(spark, 'classes')}"
    merged = merged_files(spark, sf_dir)
    files.write_code_class_lines(merged.withColumn("kind", F.when(F.col("kind").startswith("1"), F.col("kind")).otherwise(F.translate("kind", "-", " "))), path)
    return files.read_code_class_lines(spark, path)


@query(CODED + "SELECT train_code AS name, train_class AS class, CAST(n_stops AS INT) AS station_count, stations AS station_list FROM trains")
def io7_read_train_info(spark, sf_dir):
    """A file for every 2,000 numbers of trains as people write them: a list or under trains, in a fence or not, with items of lists unquoted, or a comma at the end."""
    rows = kept(trains(spark, sf_dir).select("train_code", "train_class", "ord", "n_stops", "stations"))
    pairs = F.array_join(F.transform("stations", lambda x, i: F.concat(F.lit('"'), (i + 1).cast("string"), F.lit('": "'), x, F.lit('"'))), ", ")
    one = F.concat(F.lit('{"name": "'), "train_code", F.lit('", "class": "'), "train_class", F.lit('", "station_count": '), F.col("n_stops").cast("string"), F.lit(', "line_names": [京沪线, "b"], "stations": {'), pairs, F.lit("}}"))
    parts = rows.groupBy(F.floor(F.col("ord") / 2000).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("train_code", one.alias("e")))), lambda x: x["e"]), ",\n").alias("all"))
    listed, under = F.concat(F.lit("["), "all", F.lit("]")), F.concat(F.lit('{"trains": ['), "all", F.lit("]}"))
    text = F.when(F.col("part") % 3 == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).when(F.col("part") % 3 == 1, under).otherwise(F.concat(listed, F.lit(",\n")))
    folder = written_texts(spark, parts.select(F.concat("part", F.lit(".json")).alias("file_name"), text.alias("text")), "train-info")
    return files.read_train_info_lenient(spark, folder).select("name", "class", "station_count", F.array_join("station_list", "|").alias("station_list"))


@query(duck("v_messages") + "SELECT concat(thread_id, '.json') AS thread_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY turn) - 1 AS BIGINT) AS turn, role, content FROM v_messages")
def io8_read_chat_history(spark, sf_dir):
    """A file for each conversation, beside one that can't be read."""
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    message = F.struct(kind.alias("type"), F.struct("content").alias("data"))
    threads = view(spark, sf_dir, "v_messages").groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("all"))
    docs = threads.select(F.concat("thread_id", F.lit(".json")).alias("file_name"), F.to_json(F.transform("all", lambda x: x["m"])).alias("text"))
    broken = threads.agg(F.lit("broken.json").alias("file_name"), F.lit("[{").alias("text"))
    return files.read_chat_history(spark, written_texts(spark, docs.union(broken), "history"))


@query(duck("v_tagged_points") + "SELECT fid, CASE WHEN fid % 2 = 0 THEN name END AS name, other_tags FROM v_tagged_points")
def io9_read_union_shards(spark, sf_dir):
    """Two shards with other columns in another order, and one that isn't there."""
    points, folder = view(spark, sf_dir, "v_tagged_points"), scratch(spark, "shards")
    points.where("fid % 2 = 0").write.parquet(f"{folder}/even")
    points.where("fid % 2 <> 0").select("other_tags", "fid").write.parquet(f"{folder}/odd")
    return files.read_union_shards(spark, [f"{folder}/even", f"{folder}/none", f"{folder}/odd"])


@query(PAIRS + "SELECT concat(station_a, '|', station_b) AS key, CAST(n AS BIGINT) AS n, entries FROM adj")
def io10_write_tables(spark, sf_dir):
    """The adjacency written as JSON lines under keys of pairs, and read back."""
    folder = scratch(spark, "tables")
    entries = F.array_sort(F.transform("entries", lambda e: F.concat_ws(":", e["route_name"], e["direction"].cast("string"))))
    found = network.build_adjacency(route_pairs(spark, sf_dir)).select("station_a", "station_b", F.size("entries").alias("n"), F.array_join(entries, ",").alias("entries"))
    files.write_tables({"adjacency": found}, folder, "json")
    return spark.read.schema("key string, n long, entries string").json(f"{folder}/adjacency")


@query(CODED + "SELECT train_code AS name, n_stops, CASE WHEN n_stops >= 3 THEN concat(from_station, ',', to_station) ELSE '' END AS line_names FROM trains")
def io13_write_line_names(spark, sf_dir):
    """Trains of three stops and more have their ends as lines; the others get an empty list."""
    path, every = scratch(spark, "line-names"), trains(spark, sf_dir)
    found = every.where("n_stops >= 3").select("train_code", F.array("from_station", "to_station").alias("line_names"))
    files.write_line_names(every.select(F.col("train_code").alias("name"), "n_stops"), found, path)
    return spark.read.schema("name string, n_stops long, line_names array<string>").json(path).withColumn("line_names", F.array_join("line_names", ","))


def stop_pages(spark, sf_dir):
    """A page for each train with its stops in a table; of numbers divisible by 5 the table is of another class."""
    row = F.concat(F.lit("<tr><td>"), F.col("ord").cast("string"), F.lit("</td><td> <a href='#'>"), "station", F.lit("</a></td><td>"), "depart", F.lit("</td></tr>"))
    stops = view(spark, sf_dir, "v_stops").groupBy("train_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    name = F.when(F.col("train_no") % 5 == 0, "outer").otherwise("big table-inner")
    return stops.select(F.col("train_no").alias("page_id"), F.concat(F.lit("http://x.example/"), F.col("train_no").cast("string")).alias("url"), F.concat(F.lit("<div class='"), name, F.lit("'><table><thead><tr><td>1</td><td>head</td></tr></thead><tbody>"), "rows", F.lit("</tbody></table></div>")).alias("html"))


@query(duck("v_stops") + "SELECT train_no AS page_id, CAST(ord AS INT) AS seq, station AS name FROM v_stops WHERE train_no % 5 <> 0")
def h1_extract_stop_table(spark, sf_dir):
    return stop_pages(spark, sf_dir).select("page_id", F.explode(pages.extract_stop_table("html")).alias("s")).select("page_id", "s.seq", "s.name")


@query(duck("v_stops") + "SELECT CAST(count(DISTINCT train_no) FILTER (train_no % 5 <> 0) AS BIGINT) AS ok, CAST(count(DISTINCT train_no) FILTER (train_no % 5 = 0) AS BIGINT) AS failed, CAST(count(*) FILTER (train_no % 5 <> 0) AS BIGINT) AS stops FROM v_stops")
def st1_ingest_pages(spark, sf_dir):
    """All pages through the ingest, a half of them in each of two runs, the second at the checkpoint of the first; the counts as they were written, and the stops that are there."""
    folder, every = scratch(spark, "ingest"), stop_pages(spark, sf_dir)
    for half in (0, 1):
        every.where(F.col("page_id") % 2 == half).write.mode("append").parquet(f"{folder}/pages")
        pages.ingest_pages(spark, f"{folder}/pages", f"{folder}/out", f"{folder}/checkpoint")
    stops = spark.read.parquet(f"{folder}/out/stops").agg(F.sum(F.size("stops")).alias("stops"))
    return pages.ingest_totals(spark, f"{folder}/out").select("ok", "failed").join(F.broadcast(stops))


_CITIES = duck("v_stops") + """, s AS (SELECT DISTINCT train_class AS city, station FROM v_stops), c AS (SELECT city, string_agg(station, ',' ORDER BY station) FILTER (station LIKE '%站') AS stations, count(*) FILTER (station LIKE '%站') AS n FROM s GROUP BY city)
"""


def cities(spark, sf_dir):
    """A page for each class of trains as a city, with its stations in a table; those without the station sign don't count."""
    cell = F.concat(F.lit("<td><a href='#'><font>"), "station", F.lit("</font></a></td>"))
    rows = view(spark, sf_dir, "v_stops").select("train_class", "station").distinct().groupBy("train_class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("station", cell.alias("c")))), lambda x: x["c"]), "").alias("cells"))
    head = F.concat(F.lit("<table width='100%' border='0' cellpadding='4' cellspacing='1'><tr><td><b><a href='#'> "), "train_class", F.lit("</a></b></td></tr><tr>"))
    return pages.city_stations(rows.select(F.col("train_class").alias("page_id"), F.concat(head, "cells", F.lit("</tr></table>")).alias("html")))


@query(_CITIES + "SELECT city, stations FROM c WHERE n > 0")
def h3_extract_city_stations(spark, sf_dir):
    return cities(spark, sf_dir).select("city", F.array_join(F.array_sort("stations"), ",").alias("stations"))


@query(_CITIES + "SELECT CAST(count(*) AS BIGINT) AS city_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS station_count FROM c WHERE n > 0")
def a21_city_station_totals(spark, sf_dir):
    found = pages.city_station_totals(cities(spark, sf_dir))
    return found.select(*[F.col(c).cast("long").alias(c) for c in found.columns])


@query(duck("v_stops", "v_coords") + """, r AS (SELECT DISTINCT replace(station, '站', '线') AS route FROM v_stops), l AS (SELECT CASE WHEN name LIKE '%3' THEN concat(name, '线') ELSE name END AS line FROM v_coords)
SELECT route, line FROM r JOIN l ON route = line UNION ALL SELECT route, line FROM r JOIN l ON replace(route, '线', '') = line WHERE route NOT IN (SELECT line FROM l)""")
def j7_match_routes_to_lines(spark, sf_dir):
    """Stations as routes, some with the sign for line; of the lines, those that end in 3 have it."""
    routes = view(spark, sf_dir, "v_stops").select(F.translate("station", "站", "线").alias("name"))
    named = view(spark, sf_dir, "v_coords").select(F.when(F.col("name").endswith("3"), F.concat("name", F.lit("线"))).otherwise(F.col("name")).alias("name"))
    return network.match_routes_to_lines(routes, named)


@query(NAMED + """, t AS (SELECT train_code, list(station) AS e, list(station) FILTER (station IN (SELECT name FROM v_coords)) AS f FROM named GROUP BY train_code),
s AS (SELECT CASE WHEN len(f) IS NULL THEN 'none' WHEN len(e) = len(f) AND len(list_distinct(e)) = len(list_distinct(f)) THEN 'exact' ELSE 'partial' END AS status FROM t)
SELECT status, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM s), 1) AS share FROM s GROUP BY status""")
def a20_line_match_stats(spark, sf_dir):
    """The stations of each train against those of them that have coordinates."""
    known = view(spark, sf_dir, "v_coords").select(F.col("name").alias("station"), F.lit(True).alias("known"))
    rows = named_stops(spark, sf_dir).join(known, "station", "left").groupBy("train_code")
    return lines.line_match_stats(rows.agg(F.collect_list("station").alias("expected"), F.collect_list(F.when(F.col("known"), F.col("station"))).alias("found")))
