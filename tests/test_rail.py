import json
import os
import shutil
import struct

import numpy as np
import pytest

from ferrovia.functions import text, wkb
from ferrovia.operators import chat, journeys, lines, network, retrieval, timetable, trajectories
from ferrovia.sources import files
from ferrovia.streaming import pages
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "keep", "clean"),
    [
        ("## A", True, "=== A ==="), ("### A", True, "=== # A ==="), ("# A\n## B", False, "A\nB"), ("[t](http://u) x", True, "t x"), ("![a](http://u)", True, "!a"),
        ("![a](/r.png)z", True, "z"), ("f [[3]](https://y) [[4]]", True, "f"), ("- [1.1 Title]\nz", True, "z"), ("- [1.1 Title](http://u)\nz", True, "- 1.1 Title\nz"), ("<b>x</b>", True, "x"), ("a   b\tc", True, "a b c"), ("a​b", True, "ab"),
        ("a\n\n\n\nb", True, "a\nb"), ("a\n-----\n| |\nb", True, "a\nb"), ("a\nhttps://z/only\nb", True, "a\nb"), ("", True, ""),
    ],
)
def test_clean_text(spark, raw, keep, clean):
    got = one(spark, raw, lambda c: text.clean_text(c, keep))
    assert got.replace("    ", " ") == clean


def test_names_and_tags(spark):
    assert one(spark, " 北京站站\t", text.normalize_station_name) == "北京站"
    assert [one(spark, x, text.train_prefix) for x in ("G1", "1461", "")] == ["G", "P", "P"]
    assert [one(spark, x, text.parse_train_number) for x in ("1. G65", "G65", "1. ", "", "1.2.G65")] == ["G65", "G65", None, None, "2"]
    assert one(spark, '"a"=>"1","b" => "","a"=>"2"', text.parse_tags) == {"a": "2", "b": ""}
    assert one(spark, None, text.parse_tags) == {}


def blob(order, kind, body, envelope=0):
    return b"GP\0" + bytes([envelope << 1]) + b"\0" * 4 + b"\0" * wkb.ENVELOPE[envelope] + wkb_of(order, kind, body)


def wkb_of(order, kind, body):
    return (b"\1" if order == "<" else b"\0") + struct.pack(order + "I", kind) + body


def line(order, points):
    return struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + "2d", *p) for p in points)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("envelope", [0, 1, 2, 3, 4])
def test_geometry(spark, order, envelope):
    a, b = [(1.0, 2.0), (3.0, 4.0)], [(5.0, 6.0), (7.1234567, 8.0)]
    multi = struct.pack(order + "I", 2) + wkb_of(order, 2, line(order, a)) + wkb_of(order, 2, line(order, b))
    blobs = [blob(order, 1, struct.pack(order + "2d", 116.1234567, 39.0), envelope), blob(order, 2, line(order, a), envelope), blob(order, 5, multi, envelope), blob(order, 5, multi, envelope)[:-3], b"xx", None]
    rows = spark.createDataFrame([(bytearray(x) if x else None,) for x in blobs], "g binary").coalesce(1).select(wkb.decode_point("g").alias("p"), wkb.decode_lines("g").alias("l")).collect()
    assert (rows[0].p.lng, rows[0].p.lat) == (116.123457, 39.0) and all(r.p is None or r.p.lng is None for r in rows[1:])
    assert [[tuple(p) for p in x] for x in rows[1].l] == [a] and [[tuple(p) for p in x] for x in rows[2].l] == [a, [(5.0, 6.0), (7.123457, 8.0)]]
    assert [[tuple(p) for p in x] for x in rows[3].l] == [a, [(5.0, 6.0)]] and rows[4].l == rows[5].l == []


def test_trajectories(spark):
    xy = np.stack([np.linspace(100, 101, 101), np.full(101, 30.0)], 1)
    parts = [xy[:40], xy[39:80][::-1], xy[79:]]
    assert np.allclose(sorted(map(tuple, trajectories.denoised(parts))), sorted(map(tuple, xy)))
    assert len(trajectories.merged([xy[:40], xy[60:]], 1.0)) == 41 and len(trajectories.merged([xy[:40], xy[60:]], 30.0)) == 80
    assert len(trajectories.simplified(np.array([(0, 0), (0.0001, 0), (0.0006, 0), (0.0007, 0)]))) == 3
    thin = trajectories.downsampled(xy)
    assert len(thin) == 24 and (thin[0] == xy[0]).all() and (thin[-1] == xy[-1]).all()
    rows = [("r", 0, [(0.0, 0.0), (1.0, 1.0)]), ("r", 1, [(1.0, 1.0), (0.0, 0.0)]), ("r", 2, [(0.0, 0.0)]), ("r", 3, [(2.0, 0.0), (1.0, 1.0)]), ("s", 1, [(1.0, 1.0), (0.0, 0.0)])]
    frame = spark.createDataFrame(rows, f"route string, ord int, points {trajectories.POINTS}")
    assert sorted((r.route, r.ord) for r in trajectories.dedup_reversed_sublines(frame).collect()) == [("r", 0), ("r", 2), ("r", 3), ("s", 1)]
    legs = spark.createDataFrame([("a", 2, [(1.0, 0.0), (2.0, 0.0)]), ("a", 1, [(0.0, 0.0), (1.0, 0.0)])], f"train_code string, seq int, points {trajectories.POINTS}")
    (trip,) = trajectories.stitch_trip(legs).collect()
    assert [p.lng for p in trip.points] == [0.0, 1.0, 2.0] and abs(trip.km - 222) < 0.1


def test_nearest_stations_equal_brute_force(spark):
    r = np.random.default_rng(4)
    points = [(f"r{k}", i, float(100 + 0.02 * i + r.normal(0, 0.005)), float(30 + k * 0.05 + r.normal(0, 0.01))) for k in range(4) for i in range(120)]
    stations = [(f"s{i}", float(r.uniform(99.9, 102.5)), float(r.uniform(29.9, 30.3))) for i in range(150)]
    got = {(x.route, x.name): (x.idx, x.km) for x in network.stations_on_route(spark.createDataFrame(stations, "name string, lng double, lat double"), spark.createDataFrame(points, "route string, idx long, lng double, lat double")).collect()}
    wanted = {}
    for k in range(4):
        own = np.array([(p[2], p[3]) for p in points if p[0] == f"r{k}"])
        low, high = own.min(0) - 0.03, own.max(0) + 0.03
        for name, lng, lat in stations:
            i = int(((own - (lng, lat)) ** 2).sum(1).argmin())
            km = float(trajectories.km_between(np.array((lng, lat)), own[i]))
            if km < 5 and (low <= (lng, lat)).all() and ((lng, lat) <= high).all():
                wanted[f"r{k}", name] = (i, km)
    assert wanted and set(got) == set(wanted)
    assert all(got[k][0] == i and abs(got[k][1] - km) < 0.0051 for k, (i, km) in wanted.items())


def test_route_groups(spark):
    rows = [("G2", 0, "a", "b", ["a", "x", "b"]), ("D1", 1, "b", "a", ["b", "y", "a"]), ("7", 2, "a", "c", ["a", "c"]), ("K9", 3, "d", "d", ["d", "e", "d"])]
    got = {r.route_name: r for r in timetable.group_routes(spark.createDataFrame(rows, "train_code string, ord int, from_station string, to_station string, stations array<string>")).collect()}
    assert set(got) == {"a/b", "a→c", "d→d"} and got["a/b"].stations == ["b", "y", "a", "x"] and got["a/b"].example_codes == ["D1", "G2"]
    assert got["d→d"].train_count == 1


def test_match_lines(spark):
    table = [("宁西铁路", 0, ["合肥", "六安"]), ("阜六铁路", 1, ["六安", "霍邱", "阜阳"]), ("京九铁路", 2, ["北京丰台", "衡水", "阜阳", "九江"])]
    rides = [("K1", ["合肥", "六安", "霍邱", "阜阳", "衡水", "北京丰台"]), ("K2", ["x", "y"])]
    got = lines.match_lines(spark.createDataFrame(rides, "train_code string, stations array<string>"), spark.createDataFrame(table, "line_name string, line_ord int, stations array<string>")).collect()
    assert [(r.train_code, r.line_names) for r in got] == [("K1", ["宁西铁路", "阜六铁路", "京九铁路"])]


def test_passing_and_resolving(spark):
    stops = spark.createDataFrame([("G1", 1, "a b", "08:00"), ("G1", 2, "c", "09:00"), ("G1", 3, "ab", "10:00"), ("G2", 1, "c", "07:00"), ("G2", 2, "ab", "")], "train_code string, ord long, station string, depart string")
    asked = spark.createDataFrame([("c", "ab"), ("ab", "c")], "from_station string, to_station string")
    assert sorted((r.train_code, r.depart) for r in journeys.trains_passing(asked, stops).collect()) == [("G1", "09:00"), ("G2", "07:00")]
    coords = spark.createDataFrame([("甲",), ("乙站",)], "name string")
    got = journeys.resolve_station(spark.createDataFrame([("甲 站",), ("乙",), ("城甲",), ("丙",)], "name string"), coords, ["城"]).collect()
    assert {r.name: r.resolved for r in got} == {"甲 站": "甲", "乙": "乙站", "城甲": "甲", "丙": None}


def test_histories(spark, tmp_path):
    (tmp_path / "001").write_text(json.dumps([{"type": "human", "data": {"content": "q"}}, {"type": "ai", "data": {"content": "a"}}]))
    (tmp_path / "002").write_text("not json")
    history = files.read_chat_history(spark, str(tmp_path))
    assert [tuple(r) for r in history.orderBy("turn").collect()] == [("001", 0, "user", "q"), ("001", 1, "assistant", "a")]
    new = spark.createDataFrame([("001", 1, "user", "y"), ("001", 0, "user", "x"), ("003", 0, "user", "z")], "thread_id string, ord int, role string, content string")
    assert sorted((r.thread_id, r.turn, r.content) for r in chat.append_messages(history, new).collect()) == [("001", 0, "q"), ("001", 1, "a"), ("001", 2, "x"), ("001", 3, "y"), ("003", 0, "z")]
    ids = spark.createDataFrame([("user_1",), ("user_1_x",), ("user_12_x",)], "thread_id string")
    assert {r.thread_id for r in chat.user_threads(ids, "user_1").collect()} == {"user_1", "user_1_x"}


def test_train_files(spark, tmp_path):
    stop = {"station_name": " 甲 ", "arrive_time": "", "start_time": "08:00", "station_no": "01", "start_station_name": "甲", "end_station_name": "乙", "train_class_name": "G"}
    (tmp_path / "l.json").write_text(json.dumps({"n1": [stop, {**stop, "station_name": "乙", "station_no": "x"}], "n2": []}))
    rows = files.read_train_list(spark, str(tmp_path / "l.json")).orderBy("ord").collect()
    assert [(r.train_no, r.ord, r.station_name, r.station_no) for r in rows] == [("n1", 0, "甲", 1), ("n1", 1, "乙", None)]
    (tmp_path / "a.txt").write_text("1. G1\nG2\n1. \n")
    (tmp_path / "b.txt").write_text("G2\n")
    merged = timetable.merge_train_files(files.read_train_number_files(spark, {str(tmp_path / "a.txt"): "x", str(tmp_path / "none.txt"): "z", str(tmp_path / "b.txt"): "y"}))
    assert sorted(map(tuple, merged.collect())) == [("G1", "x", False), ("G2", "x", True)]
    with pytest.warns(UserWarning, match="none.txt"):
        files.read_train_number_files(spark, {str(tmp_path / "none.txt"): "z"})
    files.write_code_class_lines(merged, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_code_class_lines(spark, str(tmp_path / "out")).collect())) == [("G1", "x"), ("G2", "x")]


def test_retrieval_text(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "chunk_id int, embedding array<double>")
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query_id int, embedding array<double>")
    hits = retrieval.retrieve_topk(chunks, asked, k=2, threshold=0.5)
    texts = spark.createDataFrame([(1, "一", "x.txt"), (2, "二", "y.txt")], "chunk_id int, content string, source string")
    assert retrieval.format_hits(hits, texts).first().text == "1. 一（来源: x.txt）\n\n2. 二（来源: y.txt）"


def test_resumed_ingest_equals_one_run(spark, tmp_path):
    html = '<div class="a table-inner"><table><tbody><tr><td> 1 </td><td> 甲 </td></tr><tr><td>x</td><td>乙</td></tr><tr><td>1</td><td>丙</td></tr></tbody></table></div>'
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([(1, "u", html), (2, "v", "<p>none")], "page_id long, url string, html string").write.parquet(source)
    pages.ingest_pages(spark, source, target, mark, files_at_once=1)
    spark.createDataFrame([(3, "w", html)], "page_id long, url string, html string").write.mode("append").parquet(source)
    pages.ingest_pages(spark, source, target, mark, files_at_once=1)
    assert sorted((r.page_id, [tuple(s) for s in r.stops]) for r in spark.read.parquet(f"{target}/stops").collect()) == [(1, [(1, "丙")]), (3, [(1, "丙")])]
    assert [r.page_id for r in spark.read.parquet(f"{target}/failed").collect()] == [2]
    told = pages.ingest_totals(spark, target).first()
    assert (told.ok, told.failed) == (2, 1) and told.batches > 1
    # a run that stopped before it could say that its last batch was done does that again
    last = told.batches - 1
    shutil.rmtree(f"{target}/counts/batch={last}")
    for x in (f"{mark}/commits/{last}", f"{mark}/commits/.{last}.crc"):
        os.path.exists(x) and os.remove(x)
    pages.ingest_pages(spark, source, target, mark, files_at_once=1)
    assert tuple(pages.ingest_totals(spark, target).first()) == tuple(told)


def test_nearest_node_far_and_near(spark):
    nodes = spark.createDataFrame([(100.0, 30.0), (130.0, 50.0), (130.0, 50.0)], "lng double, lat double")
    places = spark.createDataFrame([("near", 100.1, 30.0), ("far", 120.0, 20.0)], "name string, lng double, lat double")
    assert {r.name: (r.lng, r.lat) for r in network.nearest_node(places, nodes).collect()} == {"near": (100.0, 30.0), "far": (100.0, 30.0)}


def test_first_and_last_of_a_name(spark):
    points = spark.createDataFrame([(2, "甲站", (100.0, 30.0)), (1, "甲", (101.0, 31.0)), (0, "甲", (10.0, 31.0)), (3, "", (100.0, 30.0))], "fid int, name string, point struct<lng:double,lat:double>")
    assert [tuple(r) for r in network.station_coords(points).collect()] == [("甲", 101.0, 31.0)]
    routes = spark.createDataFrame([(1, "r", [1, 2]), (2, "r", [3, 4]), (3, "r", [5])], "fid int, name string, points array<int>")
    assert [tuple(r) for r in network.route_geometries(routes).collect()] == [("r", [3, 4])]
    names = [spark.createDataFrame([(x,) for x in y], "name string") for y in (["京九线", "甲线", "乙"], ["京九线", "甲", "京九"])]
    assert sorted(map(tuple, network.match_routes_to_lines(*names).collect())) == [("京九线", "京九线"), ("甲线", "甲")]


def test_statuses_and_direct_segments(spark):
    from ferrovia.operators import profile

    runs = spark.createDataFrame([("1",), ("3",), ("3",), ("9",)], "run string")
    assert sorted((r.run, r.label, r.n) for r in profile.parse_status_counts(runs).collect()) == [("0", "UNSTART", 0), ("1", "RUNNING", 1), ("2", "CANCEL", 0), ("3", "DONE", 2), ("4", "FAIL", 0)]
    stored = spark.createDataFrame([("a", "b", [(0.0, 0.0), (1.0, 0.0)]), ("b", "a", [(1.0, 0.0), (0.5, 2.0), (0.0, 0.0)])], f"station_a string, station_b string, points {trajectories.POINTS}")
    asked = spark.createDataFrame([("b", "a"), ("a", "z")], "a string, b string")
    got = {(r.a, r.b): r.points and [tuple(p) for p in r.points] for r in trajectories.direct_segments(asked, stored).collect()}
    assert got == {("b", "a"): [(1.0, 0.0), (0.0, 0.0)], ("a", "z"): None}


def test_boxes_and_line_statistics(spark):
    rows = [("r", [[(0.0, 0.0), (1.0, 1.0)], [(9.0, 9.0), (9.0, 9.0)]]), ("s", [[(9.0, 9.0)]]), ("t", [[(9.0, 9.0)]])]
    routes = spark.createDataFrame(rows, f"route string, sublines array<{trajectories.POINTS}>")
    boxes = spark.createDataFrame([("r", 0.0, 1.0, 0.0, 1.0), ("s", 0.0, 1.0, 0.0, 1.0)], "route string, minx double, maxx double, miny double, maxy double")
    assert {r.route: (len(r.sublines), r.removed) for r in trajectories.filter_sublines_by_bbox(routes, boxes).collect()} == {"r": (1, 1), "s": (1, 0), "t": (1, 0)}
    both = spark.createDataFrame([("1", ["a", "b"], ["b", "a"]), ("2", ["a"], ["a", "b"]), ("3", ["a"], [])], "train_code string, expected array<string>, found array<string>")
    assert sorted(map(tuple, lines.line_match_stats(both).collect())) == [("exact", 1, 33.3), ("none", 1, 33.3), ("partial", 1, 33.3)]


def test_corpus_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.b.txt").write_text("x\ny")
    (tmp_path / "in" / "c.md").write_text("z")
    corpus = files.read_text_corpus(spark, str(tmp_path / "in"))
    assert [tuple(r) for r in corpus.collect()] == [("a.b.txt", "x\ny")]
    files.write_cleaned_corpus(corpus, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().out_name == "a.b_cleaned.txt"
    files.write_tables({"one": corpus, "two": corpus.withColumn("n", F.lit(1)).drop("text")}, str(tmp_path / "t"))
    got = files.read_union_shards(spark, [str(tmp_path / "t" / "one"), str(tmp_path / "t" / "two")]).collect()
    assert sorted(((r.text, r.n) for r in got), key=str) == [("x\ny", None), (None, 1)]
    (tmp_path / "t" / "bad").mkdir()
    (tmp_path / "t" / "bad" / "x.parquet").write_text("no table")
    (tmp_path / "t" / "two" / "part-9.parquet").write_text("cut off")
    with pytest.warns(UserWarning) as told:
        some = files.read_union_shards(spark, [str(tmp_path / "t" / x) for x in ("bad", "none", "one", "two")])
        assert files.read_union_shards(spark, [str(tmp_path / "t" / "none")]) is None
    assert len(told) == 3 and sorted(((r.text, r.n) for r in some.collect()), key=str) == [("x\ny", None), (None, 1)]


def test_tables_as_json(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", ["r"])], "station_a string, station_b string, routes array<string>")
    files.write_tables({"pairs": pairs, "names": pairs.select("routes")}, str(tmp_path), "json")
    read = lambda name: [json.loads(x) for p in (tmp_path / name).glob("part*") for x in p.read_text().splitlines()]
    assert read("pairs") == [{"key": "a|b", "routes": ["r"]}] and read("names") == [{"routes": ["r"]}]
    with pytest.raises(ValueError, match="csv"):
        files.write_tables({"pairs": pairs}, str(tmp_path), "csv")


def test_stop_lists_in_every_form(spark, tmp_path):
    stop = lambda name: {"station_name": name, "station_no": "1", "start_station_name": "甲", "end_station_name": "乙", "train_class_name": "G"}
    lists = {"n1": [stop("甲"), stop("乙")], "n2": [], "n3": [stop("丙")]}
    (tmp_path / "o.json").write_text(json.dumps(lists))
    (tmp_path / "l.json").write_text("\n".join(json.dumps({"train_no": k, "train_ord": i, "stops": v}) for i, (k, v) in enumerate(lists.items())))
    kind = f"train_no string, train_ord long, stops array<{files.STOP_TYPE}>"
    spark.read.schema(kind).json(str(tmp_path / "l.json")).write.parquet(str(tmp_path / "p"))
    rows = [sorted(map(tuple, files.read_train_list(spark, str(tmp_path / x), form).collect())) for x, form in (("o.json", "object"), ("l.json", "lines"), ("p", "parquet"))]
    assert rows[0] == rows[1] == rows[2] and [r[:4] for r in rows[0]] == [("n1", 0, 0, "甲"), ("n1", 0, 1, "乙"), ("n3", 2, 0, "丙")]
    (tmp_path / "c.json").write_text(json.dumps({"G1": "n1", "G2": "n3", "G3": 7}))
    assert [tuple(r) for r in files.read_train_codes(spark, str(tmp_path / "c.json")).collect()] == [("G1", "n1", 0), ("G2", "n3", 1), ("G3", "7", 2)]


def test_the_last_number_of_a_code_and_its_first_stop_count(spark):
    rows = [
        ("n1", 0, 1, "甲", "", "08:00", "1", "起", "终", "G"), ("n1", 0, 2, "乙", "09:00", "----", "x", "", "", ""),
        ("n2", 1, 2, " 丁 ", "07:10", "07:11", "2", "不", "对", "K"), ("n2", 1, 1, "丙", "----", "07:00", "1", " 首 ", "尾", "D"), ("n3", 2, 1, "戊", None, None, None, None, None, None),
    ]
    stops = spark.createDataFrame(rows, "train_no string, train_ord long, ord long, station string, arrive string, depart string, station_no string, start_station string, end_station string, train_class string")
    codes = spark.createDataFrame([("G1", "n1", 0), ("G1", "n2", 1), ("D9", "n3", 2), ("D8", "n3", 3)], "train_code string, train_no string, ord int")
    got = {r.train_code: r for r in timetable.build_trains(timetable.attach_train_code(stops, codes)).collect()}
    assert set(got) == {"G1", "D8"} and (got["G1"].from_station, got["G1"].to_station, got["G1"].train_class, got["G1"].ord) == ("首", "尾", "D", 1)
    assert got["G1"].stations == ["丙", "丁"] and [tuple(x) for x in got["G1"].station_details] == [("丙", "----", "07:00", 1), ("丁", "07:10", "07:11", 2)]
    assert (got["D8"].from_station, got["D8"].to_station, got["D8"].departs) == ("戊", "戊", [""])
    frame = timetable.build_trains(timetable.attach_train_code(stops, codes)).where("train_code = 'G1'")
    columns = [F.col(c) for c in ("train_code", "train_class", "from_station", "to_station", "stations")]
    timed, bare, basic = frame.select(journeys.format_train_info(*columns, F.col("station_details")), journeys.format_train_info(*columns, F.array()), journeys.format_basic_info(*columns)).first()
    assert timed == "🚄 G1 (D)\n  起讫站: 首 → 尾\n  经停 2 站:\n    1. 丙 到:---- 发:07:00\n    2. 丁 到:07:10 发:07:11"
    assert bare == "🚄 G1 (D)\n  起讫站: 首 → 尾\n  经停 2 站:\n    1. 丙\n    2. 丁" and basic == "🚄 G1 (D)\n  起讫站: 首 → 尾\n  经停 2 站: 丙 → 丁"


def test_checkpoints(spark):
    say = lambda *rows: [(r, c, t) for r, c, t in rows]
    one = say(("human", "q" * 120, False))
    rows = [
        ("user_1", 3, "2025-02-01T10:00:30Z", "loop", [*one, ("ai", "", True)]), ("user_1", 1, "2025-02-01T09:59:00Z", "input", one), ("user_1", 4, "z", "input", [*one, ("ai", "", True), ("tool", "t", False), ("AIMessageChunk", "done", False)]),
        ("user_2", 1, "2025-02-01T09:59:40Z", "input", say(("HumanMessage", "", False))), ("user_2", 2, "", "loop", say(("HumanMessage", "", False), ("AIMessage", "x", True))),
        ("user_3", 1, "2025-02-02T00:00:00Z", "input", []), ("user_4", 1, "bad", "input", say(("user", "hi", False))), ("user_5", 1, "2025-02-01T11:00:00Z", "loop", say(("tool", "", True))),
    ]
    frame = spark.createDataFrame(rows, "thread_id string, seq long, ts string, source string, messages array<struct<role:string,content:string,has_tool_calls:boolean>>").repartition(3)
    first = chat.first_input_per_thread(frame)
    assert {r.thread_id: (r.created_at[:16], r.preview) for r in first.collect()} == {"user_1": ("2025-02-01T09:59", "q" * 100), "user_2": ("2025-02-01T09:59", "新对话"), "user_3": ("2025-02-02T00:00", "新对话"), "user_4": ("bad", "hi")}
    assert [tuple(r)[:3] for r in chat.sessions_by_date(first).collect()] == [("未知日期", "", "user_4"), ("2025-02-02", "00:00", "user_3"), ("2025-02-01", "09:59", "user_2"), ("2025-02-01", "09:59", "user_1")]
    assert sorted((r.thread_id, r.role, r.content) for r in chat.session_messages(frame).collect()) == [("user_1", "assistant", "done"), ("user_1", "user", "q" * 120), ("user_2", "assistant", "x"), ("user_4", "user", "hi")]
    assert [r.thread_id for r in chat.pending_tool_calls(frame).collect()] == ["user_2"]


def test_items_of_marked_lists():
    html = '<ul class="clearfix"><li>out</ul><div class="x train_index_cz2"><ul class="a clearfix"><li> 甲<b>1</b><br> <li>乙<ul><li>in</li></ul>!</li></ul><ul><li>other</ul><p><ul class=clearfix><li>丙</div><ul class=clearfix><li>after</ul>'
    assert pages.items_of(html, "train_index_cz", "clearfix") == ["甲1", "乙in!", "丙"]
    assert pages.items_of(html) == ["out", "甲1", "乙in!", "in", "other", "丙", "after"] and pages.items_of(None) == []
    assert pages.items_of(html, ul_class="clearfix") == ["out", "甲1", "乙in!", "丙", "after"]


def test_nearest_nodes_equal_brute_force(spark):
    r = np.random.default_rng(5)
    nodes = np.concatenate([r.uniform((70, 15), (140, 55), (300, 2)), np.round(r.uniform((99, 29), (101, 31), (500, 2)), 1)])
    places = np.concatenate([r.uniform((60, 0), (150, 70), (60, 2)), np.round(r.uniform((99, 29), (101, 31), (60, 2)), 1) + 0.05])
    asked = spark.createDataFrame([(str(i), float(x), float(y)) for i, (x, y) in enumerate(places)] + [("none", None, 3.0)], "name string, lng double, lat double")
    got = {int(x.name): (x.degrees, x.lng, x.lat) for x in network.nearest_node(asked, spark.createDataFrame(nodes.tolist(), "lng double, lat double")).collect()}
    for i, p in enumerate(places):
        d = np.hypot(*(nodes - p).T)
        assert abs(got[i][0] - d.min()) < 1e-9 and d[(nodes == got[i][1:]).all(1)].min() == pytest.approx(d.min())
    assert len(got) == len(places)


def test_retrieval_in_blocks_equals_one(spark):
    r = np.random.default_rng(6)
    vectors = np.round(r.normal(0, 1, (230, 6)), 1)
    vectors[5], vectors[6] = 0, vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0]), (902, [None] * 6), (None, [1.0] * 6)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    chunks, queries = table.withColumnRenamed("id", "chunk_id"), table.withColumnRenamed("id", "query_id")
    got = {(x.query_id, x["rank"]): (x.chunk_id, x.similarity) for x in retrieval.retrieve_topk(chunks, queries, k=4, threshold=0.1, block=50, part=60).collect()}
    unit = vectors / np.where(np.linalg.norm(vectors, axis=1, keepdims=True) > 0, np.linalg.norm(vectors, axis=1, keepdims=True), 1)
    wanted = {}
    for i, s in enumerate(np.round(unit @ unit.T, 12)):
        best = sorted((-x, j) for j, x in enumerate(s) if x >= 0.1)[:4]
        wanted |= {(i, n + 1): (j, -x) for n, (x, j) in enumerate(best)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()} and all(abs(got[k][1] - wanted[k][1]) < 1e-9 for k in got)
    assert retrieval.retrieve_topk(chunks, queries.limit(0)).count() == retrieval.retrieve_topk(chunks.limit(0), queries).count() == 0


def plain_lines(ride, table):
    """The lines of a ride, leg by leg."""
    names, last = [], None
    for a, b in zip(ride, ride[1:], strict=False):
        held = []
        for order, (name, stations) in enumerate(table):
            if a in stations and b in stations and a != b:
                coverage = len(set(ride) & set(stations)) / len(stations)
                held.append((len(stations), -coverage, -abs(stations.index(a) - stations.index(b)), order, name))
        if not held:
            continue
        best = min(held)
        if last and last[0] in [x[-1] for x in held] and best[0] >= last[1]:
            continue
        if not last or best[-1] != last[0]:
            names.append(best[-1])
            last = best[-1], best[0]
    return names


def test_lines_equal_plain_loops(spark):
    r = np.random.default_rng(7)
    names = [f"s{i}" for i in range(12)]
    table = [(f"l{i}", [names[k] for k in r.permutation(12)[: r.integers(2, 6)]]) for i in range(25)]
    rides = [(f"t{i}", [names[k] for k in r.integers(0, 12, r.integers(2, 9))]) for i in range(60)]
    got = lines.match_lines(spark.createDataFrame(rides, "train_code string, stations array<string>"), spark.createDataFrame([(n, i, s) for i, (n, s) in enumerate(table)], "line_name string, line_ord int, stations array<string>")).collect()
    assert {x.train_code: x.line_names for x in got} == {t: n for t, ride in rides if (n := plain_lines(ride, table))}


def test_reports(spark):
    from ferrovia.operators import profile

    docs = spark.createDataFrame([(1, "<b>ab</b>"), (2, None), (3, ""), (4, "abcd")], "doc_id long, text string")
    told = profile.cleaned(docs)
    assert profile.cleaning_report(told).first().asDict() == {"files": 4, "ok": 3, "failed": 1, "success": 75.0, "original_size": 13, "new_size": 6, "reduction": 53.8462, "mean_reduction": 25.9259}
    assert sorted((r.doc_id, r.ok, r.original_size, r.new_size, r.reduction) for r in profile.cleaning_details(told).collect()) == [(1, True, 9, 2, 77.78), (2, False, None, None, None), (3, True, 0, 0, 0.0), (4, True, 4, 4, 0.0)]
    assert profile.cleaning_report(told.limit(0)).first().asDict() == {"files": 0, "ok": 0, "failed": 0, "success": 0.0, "original_size": 0, "new_size": 0, "reduction": 0.0, "mean_reduction": 0.0}
    runs = spark.createDataFrame([(str(i % 2), i) for i in range(30, 0, -1)], "run string, doc_id long")
    assert sorted(map(tuple, profile.parse_status_samples(runs, 2).collect())) == [("0", 1, 2), ("0", 2, 4), ("1", 1, 1), ("1", 2, 3)]
    assert tuple(profile.table_profile(spark.createDataFrame([(1, ""), (2, "x")], "fid int, name string")).first()) == (2, 1, "fid:int,name:string")
    points = spark.createDataFrame([(1, "甲", (100.0, 30.0)), (2, "甲站", (101.0, 30.0)), (3, " ", (100.0, 30.0)), (4, "乙", None), (5, "丙", (1.0, 1.0))], "fid int, name string, point struct<lng:double,lat:double>")
    assert tuple(network.station_coord_counters(points).first()) == (1, 3, 1)
    pairs = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("q", "a", "b"), ("q", "a", "b")], "route string, station_a string, station_b string")
    assert sorted((r.station_a, [tuple(e) for e in r.entries]) for r in network.build_adjacency(pairs).collect()) == [("a", [("q", 1), ("r", 1)]), ("b", [("r", 1)])]
    assert tuple(network.adjacency_stats(pairs).first()) == (2, 3, 1, 3)


def test_caps_are_asked_for(spark):
    zigzag = np.stack([100 + 0.01 * np.arange(400), 30 + 0.001 * (np.arange(400) % 2)], 1)
    assert len(trajectories.denoised([zigzag])) == 400 and len(trajectories.denoised([zigzag], 150)) == 150
    df = spark.createDataFrame([(1, [[tuple(map(float, p)) for p in zigzag]], 5.0)], f"i int, sublines array<{trajectories.POINTS}>, km double")
    sizes = df.select(F.size(trajectories.denoise_route("sublines")), F.size(trajectories.denoise_route("sublines", 150)), F.size(trajectories.merge_sublines("sublines", "km"))).first()
    assert tuple(sizes) == (400, 150, 400)
    far = [(101.305, 30.0), (101.5, 30.0), (103.99, 30.0)]
    assert trajectories.parallel(np.array(far), zigzag, near_km=0.6) and not trajectories.parallel(np.array(far), np.repeat(zigzag, 2, 0), near_km=0.6, every=50)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from ferrovia.sources.stored import stored

    session = Fake(conf=Fake(get=lambda *_: None), sparkContext=Fake(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stored(Fake(sparkSession=session))


def test_few_partitions_are_spread(spark):
    from ferrovia.sources.stored import spread

    few, many = spark.range(100, numPartitions=1), spark.range(100, numPartitions=20)
    assert spread(few).rdd.getNumPartitions() == 8 and spread(few).count() == 100 and spread(many) is many


def test_thinning_equals_a_walk():
    r = np.random.default_rng(11)
    for n in (2, 3, 30, 400, 3000):
        for scale in (0.00001, 0.002, 0.05):
            xy = np.cumsum(np.concatenate([[(100, 30)], r.normal(0, scale, (n - 1, 2)) * (r.random((n - 1, 1)) < 0.7)]), 0)
            steps = trajectories.km_between(xy[:-1], xy[1:])
            km = float(steps.sum())
            target = max(2, int(km * 25 / 100))
            kept = list(range(n))
            if not (target >= n or km < 0.01):
                along, following, kept = np.cumsum(steps), km / (target - 1), [0]
                for i in range(1, n - 1):
                    if along[i - 1] >= following:
                        kept.append(i)
                        following += km / (target - 1)
                kept.append(n - 1)
            assert np.array_equal(trajectories.downsampled(xy), xy[kept])
