"""Queries on trains: by code, by terminals, passing through, legs with coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance_km
from ..sources.stored import few, kept

#: Order of classes in answers.
PRIORITY = ("G", "D", "C", "Z", "T", "K")
#: City prefixes that a station name may have in front.
CITY_PREFIXES = (
    "北京", "上海", "广州", "深圳", "天津", "重庆", "成都",
    "武汉", "南京", "杭州", "西安", "郑州", "长沙", "沈阳",
    "哈尔滨", "长春", "济南", "青岛", "大连", "昆明", "贵阳",
    "南宁", "兰州", "太原", "石家庄", "合肥", "南昌", "福州",
)


def priority(code: Column) -> Column:
    first = F.substring(code, 1, 1)
    out = F.lit(9)
    for i, letter in reversed(list(enumerate(PRIORITY))):
        out = F.when(first == letter, i).otherwise(out)
    return out


def lookup_trains(codes: DataFrame, details: DataFrame, basic: DataFrame) -> DataFrame:
    """codes (code) to the train of each: from details, else from basic; unknown ones are left out."""
    asked = codes.select(F.upper(F.trim("code")).alias("train_code")).distinct()
    return asked.join(details, "train_code").withColumn("source", F.lit("details")).unionByName(
        asked.join(basic, "train_code").join(details.select("train_code"), "train_code", "left_anti").withColumn("source", F.lit("basic")), allowMissingColumns=True
    )


def codes_not_found(codes: DataFrame, *tables: DataFrame) -> DataFrame:
    asked = codes.select(F.upper(F.trim("code")).alias("train_code")).distinct()
    for table in tables:
        asked = asked.join(table.select("train_code"), "train_code", "left_anti")
    return asked


def trains_by_terminals(requests: DataFrame, trains: DataFrame, limit: int = 3) -> DataFrame:
    """For each request (from_station, to_station) its first trains by class priority and code."""
    order = Window.partitionBy("from_station", "to_station").orderBy(priority(F.col("train_code")), "train_code")
    found = trains.join(requests.distinct(), ["from_station", "to_station"]).withColumn("rank", F.row_number().over(order).cast("long"))
    return found.where(F.col("rank") <= limit).select("from_station", "to_station", "rank", "train_code")


def trains_passing(requests: DataFrame, stops: DataFrame) -> DataFrame:
    """For each request the trains that stop at both stations, the last stop at each counting, in that
    order; names are compared without spaces. Sorted use: by departure and code."""

    def plain(c: str) -> Column:
        return F.replace(F.col(c), F.lit(" "), F.lit(""))

    asked = kept(requests.select(plain("from_station").alias("from_station"), plain("to_station").alias("to_station")).distinct())
    # pairs of stops of a train, at stations that are asked for, then the requests: a hub's
    # trains never meet all the requests that name the hub
    ends = few(kept(asked.select(F.explode(F.array("from_station", "to_station")).alias("station")).distinct()))
    at = stops.select("train_code", "ord", "depart", plain("station").alias("station")).join(ends, "station", "left_semi")
    last = at.groupBy("train_code", "station").agg(F.max_by("depart", "ord").alias("depart"), F.max("ord").alias("ord"))
    whole = kept(last.groupBy("train_code").agg(F.collect_list(F.struct("station", "ord", "depart")).alias("s")))
    a = whole.select("train_code", F.explode("s").alias("a"), "s")
    later = F.filter("s", lambda x: x["ord"] > F.col("a.ord"))
    rides = a.select("train_code", F.col("a.station").alias("from_station"), F.col("a.depart").alias("depart"), F.col("a.ord").alias("ord"), F.explode(later).alias("b"))
    rides = rides.select("train_code", "from_station", F.col("b.station").alias("to_station"), "depart", (F.col("b.ord") - F.col("ord")).alias("hops"))
    return rides.join(asked, ["from_station", "to_station"]).select("from_station", "to_station", "train_code", "depart", "hops")


def train_legs_with_coords(stops: DataFrame, coords: DataFrame) -> DataFrame:
    """Legs between consecutive named stops of which both have coordinates, with their straight length."""
    line = Window.partitionBy("train_code").orderBy("ord")
    legs = stops.where(F.col("station") != "").select("train_code", "ord", F.col("station").alias("a"), F.lead("station").over(line).alias("b"))
    a = coords.select(F.col("name").alias("a"), F.col("lng").alias("lng_a"), F.col("lat").alias("lat_a"))
    b = coords.select(F.col("name").alias("b"), F.col("lng").alias("lng_b"), F.col("lat").alias("lat_b"))
    return legs.join(a, "a").join(b, "b").withColumn("km", distance_km(F.col("lng_a"), F.col("lat_a"), F.col("lng_b"), F.col("lat_b")))


def station_coverage(stops: DataFrame, coords: DataFrame) -> DataFrame:
    """Stations that stop lists name, how many have coordinates, and the percentage, rounded down."""
    names = stops.select("station").where(F.col("station") != "").distinct()
    hits = names.join(coords.select(F.col("name").alias("station"), F.lit(1).alias("hit")).distinct(), "station", "left")
    return hits.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("found")).withColumn("percent", F.when(F.col("total") > 0, F.floor(F.col("found") * 100 / F.col("total"))).otherwise(0))


def resolve_station(names: DataFrame, coords: DataFrame, prefixes: tuple[str, ...] = CITY_PREFIXES) -> DataFrame:
    """names (name) with resolved: the first of the name without spaces, with the station sign, without
    trailing signs, or without the first fitting of the prefixes, that coords has; else null."""
    plain = F.replace(F.col("name"), F.lit(" "), F.lit(""))
    bare = F.regexp_replace(plain, "站+$", "")
    tries = [plain, F.concat(plain, F.lit("站")), bare] + [F.when(bare.startswith(p), F.substring(bare, len(p) + 1, 1000)) for p in prefixes]
    tried = names.select("name").distinct().select("name", F.posexplode(F.array(*tries)).alias("rank", "candidate"))
    hit = tried.join(coords.select(F.col("name").alias("candidate")).distinct(), "candidate").groupBy("name").agg(F.min_by("candidate", "rank").alias("resolved"))
    return names.join(hit, "name", "left")


def endpoint_roles(stops: DataFrame, coords: DataFrame) -> DataFrame:
    """start, end or middle for the stops that have coordinates, by their place among those."""
    known = stops.join(coords.select(F.col("name").alias("station")).distinct(), "station", "left_semi")
    line = Window.partitionBy("train_code").orderBy("ord")
    at, n = F.row_number().over(line), F.count(F.lit(1)).over(Window.partitionBy("train_code"))
    return known.select("train_code", "ord", "station", F.when(at == 1, "start").when(at == n, "end").otherwise("middle").alias("role"))


def trip_bounds(stops: DataFrame, coords: DataFrame) -> DataFrame:
    placed = stops.join(coords.withColumnRenamed("name", "station"), "station")
    return placed.groupBy("train_code").agg(F.min("lng").alias("west"), F.max("lng").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.avg("lng").alias("lng"), F.avg("lat").alias("lat"))


def format_route_fallback(stations: Column, shown: int = 5) -> Column:
    head = F.array_join(F.slice(stations, 1, shown), " → ")
    return F.when(F.size(stations) > shown, F.concat(head, F.lit(" ... → "), F.element_at(stations, -1))).otherwise(head)


def format_train_info(code: Column, train_class: Column, start: Column, end: Column, stations: Column, details: Column) -> Column:
    """The text of a train: its code and class, terminals, number of stations, and a line for each stop: number, name, arrival
    and departure (---- for none) of details (array of name, arrive, depart, no), or the numbered stations where there are none."""
    time = lambda x: F.when(F.coalesce(x, F.lit("")) == "", "----").otherwise(x)
    none = lambda x: F.coalesce(x, F.lit(""))
    details = details.cast("array<struct<name:string,arrive:string,depart:string,no:int>>")
    timed = F.transform(details, lambda x: F.concat(F.lit("    "), F.coalesce(x["no"], F.lit(0)).cast("string"), F.lit(". "), none(x["name"]), F.lit(" 到:"), time(x["arrive"]), F.lit(" 发:"), time(x["depart"])))
    bare = F.transform(stations, lambda x, i: F.concat(F.lit("    "), (i + 1).cast("string"), F.lit(". "), none(x)))
    rows = F.when(F.size(details) > 0, timed).otherwise(F.coalesce(bare, F.array().cast("array<string>")))
    head = F.concat(F.lit("🚄 "), code, F.lit(" ("), none(train_class), F.lit(")"))
    ends = F.concat(F.lit("  起讫站: "), none(start), F.lit(" → "), none(end))
    count = F.concat(F.lit("  经停 "), F.greatest(F.size(stations), F.lit(0)).cast("string"), F.lit(" 站:"))
    return F.array_join(F.concat(F.array(head, ends, count), rows), "\n")


def format_basic_info(code: Column, train_class: Column, start: Column, end: Column, stations: Column) -> Column:
    """The text of a train without times: its stations follow in one line (see format_route_fallback)."""
    none = lambda x: F.coalesce(x, F.lit(""))
    head = F.concat(F.lit("🚄 "), code, F.lit(" ("), none(train_class), F.lit(")\n  起讫站: "), none(start), F.lit(" → "), none(end))
    return F.concat(head, F.lit("\n  经停 "), F.size(stations).cast("string"), F.lit(" 站: "), format_route_fallback(stations))
