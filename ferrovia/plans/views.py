"""Rail-shaped views of the driver's tables, for the registered queries: {name: (tables, SQL)}.

The SQL runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession



def _clock(minute: str) -> str:
    two = lambda x: f"lpad(CAST(CAST({x} AS INT) AS STRING), 2, '0')"
    return f"concat({two(f'floor(({minute}) % 1440 / 60e0)')}, ':', {two(f'({minute}) % 60')})"


#: Routes go by supplier, twelve to each: a vertex for each of their line items, 0.003 degrees on, in rows 0.1 degrees apart.
_ROUTE = "CAST(floor({} / 12e0) AS BIGINT)"
_WEST, _SOUTH = "71 + floor(r / 390e0) % 3 * 22e0", "14.95e0 + r % 390 * 0.1e0"

VIEWS = {
    "v_stops": (("lineitem",), f"""
SELECT train_no, train_no AS train_ord, ord, station, CASE WHEN ord = 1 THEN '' ELSE {_clock("m + 1435")} END AS arrive, {_clock("m")} AS depart, ord AS station_no,
  first_value(station) OVER (PARTITION BY train_no ORDER BY ord) AS start_station, first_value(station) OVER (PARTITION BY train_no ORDER BY ord DESC) AS end_station, train_class
FROM (SELECT l_orderkey AS train_no, l_linenumber * 97 + l_partkey AS m, concat('class ', CAST(l_partkey % 5 AS STRING)) AS train_class,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS BIGINT) AS ord,
  concat(CASE WHEN l_partkey % 29 = 0 THEN 'X' ELSE 'S' END, lpad(CAST(l_suppkey AS STRING), 5, '0'), CASE WHEN l_suppkey % 3 = 0 THEN '站' ELSE '' END) AS station
  FROM lineitem) AS l"""),
    "v_train_codes": (("orders",), """
SELECT o_orderkey AS train_no, o_orderpriority AS train_class, o_orderkey AS ord,
  concat(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'G' WHEN '2' THEN 'D' WHEN '3' THEN 'Z' WHEN '4' THEN 'K' ELSE '' END,
         CAST(o_orderkey - CASE WHEN o_orderkey % 7 = 1 THEN 1 ELSE 0 END AS STRING)) AS train_code
FROM orders"""),
    "v_route_points": (("lineitem",), f"""
SELECT concat('R', lpad(CAST(r AS STRING), 5, '0')) AS route, idx, round({_WEST} + idx * 0.003e0, 6) AS lng,
  round({_SOUTH} + idx * 0.00001e0 * (r % 3 - 1) + idx * 7 % 5 * 0.0002e0, 6) AS lat
FROM (SELECT r, CAST(row_number() OVER (PARTITION BY r ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS BIGINT) AS idx
  FROM (SELECT *, {_ROUTE.format("l_suppkey")} AS r FROM lineitem) AS a) AS b"""),
    "v_coords": (("supplier",), f"""
SELECT concat('S', lpad(CAST(s_suppkey AS STRING), 5, '0')) AS name,
  round({_WEST} + (s_suppkey % 12 * 580 + s_suppkey * 131 % 300) * 0.003e0 + (s_suppkey * 17 % 9 - 4) * 0.01e0, 6) AS lng,
  round({_SOUTH} + (s_suppkey % 12 * 580 + s_suppkey * 131 % 300) * 0.00001e0 * (r % 3 - 1) + (s_suppkey * 29 % 9 - 4) * 0.01e0, 6) AS lat
FROM (SELECT *, {_ROUTE.format("s_suppkey")} AS r FROM supplier) AS a"""),
    "v_tagged_points": (("part",), """
SELECT p_partkey AS fid, p_name AS name,
  concat('"railway"=>"', CASE p_size % 4 WHEN 0 THEN 'station' WHEN 1 THEN 'halt' WHEN 2 THEN 'switch' ELSE 'signal' END,
         '","operator"=>"', p_brand, '"') AS other_tags
FROM part"""),
    "v_messages": (("conversations",), """
SELECT concat('user_', CAST(conv_id % 13 AS STRING), '_', CAST(conv_id AS STRING)) AS thread_id, turn, role, text AS content
FROM conversations"""),
    "v_dirty_docs": (("documents",), """
SELECT doc_id, concat(
  CASE WHEN doc_id % 2 = 0 THEN concat('## Title ', CAST(doc_id AS STRING), chr(10)) ELSE '' END,
  CASE WHEN doc_id % 3 = 0 THEN concat('see [link', CAST(doc_id AS STRING), '](http://x.example/', CAST(doc_id AS STRING), ')', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 5 = 0 THEN concat('fact [[', CAST(doc_id % 9 AS STRING), ']](https://y.example/a) <b>bold</b>', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 7 = 0 THEN concat('![pic](/img.png)   two   spaces', chr(9), 'tab', chr(10), '-----', chr(10), 'https://z.example/only', chr(10), chr(10), chr(10), chr(10)) ELSE '' END,
  text) AS text
FROM documents"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def duck(*names: str) -> str:
    """The views as the start of a WITH clause."""
    return "WITH " + also(*names)[2:]


def also(*names: str) -> str:
    """More views for a WITH clause."""
    return "".join(f",\n{n} AS ({VIEWS[n][1]})" for n in names)
