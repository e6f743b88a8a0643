"""Registered queries of whole answers to questions about trains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers
from .queries import CODED, RANK, asked, query, trains

_TEXTS = CODED + """, r AS (SELECT train_code, string_agg(concat('    ', CAST(station_no AS VARCHAR), '. ', station, ' 到:', CASE WHEN arrive = '' THEN '----' ELSE arrive END, ' 发:', depart), chr(10) ORDER BY ord) AS timed,
  string_agg(concat('    ', CAST(ord AS VARCHAR), '. ', station), chr(10) ORDER BY ord) AS bare, string_agg(CASE WHEN ord <= 5 THEN station END, ' → ' ORDER BY ord) AS head, arg_max(station, ord) AS tail FROM stops GROUP BY train_code),
x AS (SELECT t.*, concat('🚄 ', train_code, ' (', train_class, ')', chr(10), '  起讫站: ', from_station, ' → ', to_station, chr(10), '  经停 ', CAST(n_stops AS VARCHAR), ' 站:') AS top, timed, bare, head, tail FROM trains t JOIN r USING (train_code))
"""


@query(_TEXTS + """, c AS (SELECT train_no // 5 AS question, train_no, upper(trim(concat(' g', CAST(train_no AS VARCHAR)))) AS train_code FROM v_train_codes),
p AS (SELECT c.*, CASE WHEN x.train_code IS NOT NULL THEN concat(top, chr(10), CASE WHEN n_stops >= 3 THEN timed ELSE bare END) END AS text FROM c LEFT JOIN x ON c.train_code = x.train_code),
g AS (SELECT question, string_agg(text, concat(chr(10), chr(10)) ORDER BY train_no) AS found, string_agg(CASE WHEN text IS NULL THEN train_code END, ', ' ORDER BY train_no) AS missing FROM p GROUP BY question)
SELECT question, concat_ws(concat(chr(10), chr(10)), found, CASE WHEN missing IS NOT NULL THEN concat(chr(10), '❌ 未找到以下车次信息: ', missing) END) AS text FROM g""")
def j2_train_info_answers(spark, sf_dir):
    """Questions of up to five codes, most of them unknown; trains of two stops and fewer have no times."""
    every = trains(spark, sf_dir)
    codes = asked(spark, sf_dir).withColumn("n", F.regexp_extract("code", r"\d+", 0).cast("long"))
    questions = codes.groupBy(F.floor(F.col("n") / 5).cast("long").alias("question")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda x: x["code"]).alias("codes"))
    return answers.train_info_answers(questions, every.where("n_stops >= 3"), every)


@query(_TEXTS + f""", k AS (SELECT *, row_number() OVER (PARTITION BY from_station, to_station ORDER BY {RANK}, train_code) AS rank FROM x),
p AS (SELECT from_station, to_station, rank, CASE WHEN n_stops % 2 = 0 THEN concat(top, chr(10), timed) ELSE concat(top, ' ', head, CASE WHEN n_stops > 5 THEN concat(' ... → ', tail) ELSE '' END) END AS text FROM k WHERE rank <= 3),
g AS (SELECT from_station, to_station, concat('从「', from_station, '」到「', to_station, '」的 ', CAST(count(*) AS VARCHAR), ' 个车次:', chr(10), string_agg(text, concat(chr(10), chr(10)) ORDER BY rank)) AS text FROM p GROUP BY from_station, to_station),
a AS (SELECT from_station, to_station FROM trains UNION SELECT to_station, from_station FROM trains)
SELECT a.from_station, a.to_station, coalesce(g.text, concat('未找到从「', a.from_station, '」到「', a.to_station, '」的车次。')) AS text FROM a LEFT JOIN g ON a.from_station = g.from_station AND a.to_station = g.to_station""")
def j3_route_answers(spark, sf_dir):
    """The terminals of all trains, both ways; trains of an odd number of stops have no times."""
    every = trains(spark, sf_dir)
    back = every.select(F.col("to_station").alias("from_station"), F.col("from_station").alias("to_station"))
    return answers.route_answers(every.select("from_station", "to_station").union(back), every.where("n_stops % 2 = 0"), every)
