"""Raw stop lists to trains, route groups and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped, train_prefix


def attach_train_code(stops: DataFrame, codes: DataFrame) -> DataFrame:
    """stops (train_no, ...) with train_code: the last code (by ord) of its number, else the number."""
    last = codes.groupBy("train_no").agg(F.max_by("train_code", "ord").alias("train_code"))
    return stops.join(last, "train_no", "left").withColumn("train_code", F.coalesce("train_code", F.col("train_no").cast("string")))


def build_trains(stops: DataFrame) -> DataFrame:
    """stops (train_code, ord, station, and what else there is of train_ord, arrive, depart, station_no, start_station,
    end_station, train_class) to a row per train: train_code, ord, terminals and class as its first stop has them,
    stations in order, station_details, departs and n_stops.

    Of several numbers with one code the one of the greatest train_ord counts, and ord is that. A terminal that the first stop
    doesn't name is the first or last station. ord is unique in a number; text is trimmed.
    """
    have = set(stops.columns)
    text = lambda c: stripped(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in have else F.lit("")
    number = F.expr("try_cast(station_no AS INT)") if "station_no" in have else F.lit(None)
    rows = stops.select(
        "train_code", (F.col("train_ord") if "train_ord" in have else F.lit(0)).cast("long").alias("train_ord"),
        F.struct("ord", text("station").alias("name"), text("arrive").alias("arrive"), text("depart").alias("depart"), F.coalesce(number, F.lit(0)).alias("no")).alias("stop"),
        F.struct("ord", *[text(c).alias(c) for c in ("start_station", "end_station", "train_class")]).alias("head"),
    )
    if "train_ord" in have:
        last = rows.groupBy("train_code").agg(F.max("train_ord").alias("train_ord"))
        rows = rows.join(last, ["train_code", "train_ord"], "left_semi")
    trains = rows.groupBy("train_code").agg(F.max("train_ord").alias("ord"), F.array_sort(F.collect_list("stop")).alias("s"), F.min("head").alias("head"))
    names = F.transform("s", lambda x: x["name"])
    ends = F.coalesce(F.nullif("head.start_station", F.lit("")), F.element_at(names, 1)), F.coalesce(F.nullif("head.end_station", F.lit("")), F.element_at(names, -1))
    return trains.select(
        "train_code", "ord", ends[0].alias("from_station"), ends[1].alias("to_station"), F.col("head.train_class").alias("train_class"), names.alias("stations"),
        F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["arrive"].alias("arrive"), x["depart"].alias("depart"), x["no"].alias("no"))).alias("station_details"),
        F.transform("s", lambda x: x["depart"]).alias("departs"), F.size("s").cast("long").alias("n_stops"),
    )


#: Parts of a group of trains that are looked at before the group's first codes are taken.
SALTS = 32


def group_routes(trains: DataFrame, examples: int = 5) -> DataFrame:
    """Trains (train_code, ord, from_station, to_station, stations) by unordered terminals.

    A pair of both directions is named a/b by the one seen first, a single one a→b. Trains stand by
    first letter (Z without one) and code; a group has their count, its stations by first appearance
    and its first codes. A group whose terminals are equal is counted once. Stations are reduced to one row
    per group and name, and codes to the first of each part of a group, before they are gathered.
    """
    letter = F.when(F.col("train_code").rlike(r"^\p{L}"), F.substring("train_code", 1, 1)).otherwise("Z")
    keyed = trains.select("*", F.least("from_station", "to_station").alias("a"), F.greatest("from_station", "to_station").alias("b"), letter.alias("letter"))
    groups = keyed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("train_count"), F.min_by(F.struct("from_station", "to_station"), F.struct("ord", "train_code")).alias("seen"), F.count_distinct("from_station").alias("ways"))
    salt = F.pmod(F.xxhash64("train_code"), F.lit(SALTS))
    in_part = F.row_number().over(Window.partitionBy("a", "b", salt).orderBy("letter", "train_code"))
    few = keyed.select("a", "b", "letter", "train_code", in_part.alias("rank")).where(F.col("rank") <= examples)
    codes = few.groupBy("a", "b").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("letter", "train_code"))), 1, examples), lambda x: x["train_code"]).alias("example_codes"))
    first = keyed.select("a", "b", "letter", "train_code", F.posexplode("stations").alias("at", "station")).groupBy("a", "b", "station").agg(F.min(F.struct("letter", "train_code", "at")).alias("when"))
    names = first.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("when", "station"))), lambda x: x["station"]).alias("stations"))
    name = F.concat(F.col("seen.from_station"), F.when(F.col("ways") > 1, "/").otherwise("→"), F.col("seen.to_station"))
    return groups.join(names, ["a", "b"]).join(codes, ["a", "b"]).select(name.alias("route_name"), "train_count", "stations", "example_codes")


def class_distribution(trains: DataFrame) -> DataFrame:
    return trains.groupBy(train_prefix(F.col("train_code")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def merge_train_files(rows: DataFrame) -> DataFrame:
    """rows (train_code, kind, file_rank) to a row per code: the kind of the first file, and whether a later one has another."""
    return rows.groupBy("train_code").agg(F.min_by("kind", F.struct("file_rank", "kind")).alias("kind"), (F.count_distinct("kind") > 1).alias("conflict"))


def type_stats(merged: DataFrame) -> DataFrame:
    return merged.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("conflict").alias("conflicts"))


def longest_trains(trains: DataFrame, n: int = 10) -> DataFrame:
    return trains.orderBy(F.col("n_stops").desc(), "train_code").limit(n).select("train_code", "n_stops")


def major_g_trains(trains: DataFrame, n: int = 15, min_stops: int = 10) -> DataFrame:
    return longest_trains(trains.where(F.col("train_code").startswith("G") & (F.col("n_stops") >= min_stops)), n)


def station_vocabulary(stops: DataFrame) -> DataFrame:
    return stops.select("station").where(F.col("station") != "").distinct()


def adjacent_pairs(stops: DataFrame, key: str = "train_code") -> DataFrame:
    """Consecutive stops: key, ord, station_a, station_b."""
    line = Window.partitionBy(key).orderBy("ord")
    return stops.select(key, "ord", F.col("station").alias("station_a"), F.lead("station").over(line).alias("station_b")).where(F.col("station_b").isNotNull())
