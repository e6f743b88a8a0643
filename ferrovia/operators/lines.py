"""Line names of trains, from a dictionary (line_name, line_ord, stations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import few, kept
from .segments import sharing


def candidate_lines(trains: DataFrame, lines: DataFrame) -> DataFrame:
    """For each pair of consecutive stations of trains (train_code, stations), the lines that hold both, with line_length, the share of
    the line's stations that the train has (coverage) and their distance on the line, by the first place of each."""
    stops = trains.select("train_code", F.posexplode("stations").alias("at", "a"), F.col("stations"))
    pairs = stops.select("train_code", "at", "a", F.get("stations", F.col("at") + 1).alias("b")).where("b IS NOT NULL AND a <> b")
    places = lines.select("line_name", "line_ord", F.size("stations").alias("line_length"), F.posexplode("stations").alias("place", "station"))
    places = kept(places.groupBy("line_name", "line_ord", "line_length", "station").agg(F.min("place").alias("place")))
    pairs = kept(sharing(pairs, places.select(F.col("station").alias("name"), "line_name"), "line_name"))
    own = trains.join(few(pairs.select("train_code").distinct()), "train_code", "left_semi").select("train_code", F.explode(F.array_distinct("stations")).alias("station"))
    held = own.join(places, "station").groupBy("train_code", "line_name", "line_ord").agg(F.count(F.lit(1)).alias("held"))
    a = places.select("line_name", "line_ord", "line_length", F.col("station").alias("a"), F.col("place").alias("pos_a"))
    b = places.select("line_name", "line_ord", F.col("station").alias("b"), F.col("place").alias("pos_b"))
    # different pairs first: a line's stations never meet each other, and a pair that many trains ride is looked up once
    hit = pairs.select("a", "b").distinct().join(a, "a").join(b, ["line_name", "line_ord", "b"])
    both = pairs.join(hit, ["a", "b"]).join(held, ["train_code", "line_name", "line_ord"])
    return both.select(
        "train_code", "at", "a", "b", "line_name", "line_ord", "line_length", (F.col("held") / F.col("line_length")).alias("coverage"), F.abs(F.col("pos_a") - F.col("pos_b")).alias("distance")
    )


def match_lines(trains: DataFrame, lines: DataFrame) -> DataFrame:
    """(train_code, line_names): per segment the shortest line (then coverage, distance, order); the last
    line stays while it holds the segment and the best is not shorter. Segments without a line are passed over."""
    found = candidate_lines(trains, lines)
    order = Window.partitionBy("train_code", "at").orderBy("line_length", F.col("coverage").desc(), F.col("distance").desc(), "line_ord")
    ranked = found.withColumn("rank", F.row_number().over(order))
    steps = ranked.groupBy("train_code", "at").agg(
        F.min_by(F.struct("line_name", "line_length"), "rank").alias("best"), F.collect_list("line_name").alias("held")
    )
    per_train = steps.groupBy("train_code").agg(F.array_sort(F.collect_list(F.struct("at", "best", "held"))).alias("steps"))
    start = F.struct(F.array().cast("array<string>").alias("names"), F.lit("").alias("last"), F.lit(0).alias("size"))

    def fold(acc, x):
        stay = F.array_contains(x["held"], acc["last"]) & (x["best"]["line_length"] >= acc["size"])
        same = x["best"]["line_name"] == acc["last"]
        moved = F.struct(F.concat(acc["names"], F.array(x["best"]["line_name"])).alias("names"), x["best"]["line_name"].alias("last"), x["best"]["line_length"].alias("size"))
        return F.when(stay | same, acc).otherwise(moved)

    return per_train.select("train_code", F.aggregate("steps", start, fold)["names"].alias("line_names"))


def line_match_stats(both: DataFrame) -> DataFrame:
    """both (train_code, expected, found) to a count and share in percent (one place) per status: exact, partial or none. Every train has a
    status, so the shares are of all."""
    common = F.size(F.array_intersect("expected", "found"))
    exact = (common == F.size(F.array_distinct("expected"))) & (F.size("expected") == F.size("found")) & (common == F.size(F.array_distinct("found")))
    return both.groupBy(F.when(exact, "exact").when(common > 0, "partial").otherwise("none").alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 1))
