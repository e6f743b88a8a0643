"""Stop tables of stored pages, and their resumable ingest."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stored import kept


class _Stops(HTMLParser):
    """Cells of the rows of the first tbody under class table-inner."""

    def __init__(self):
        super().__init__()
        self.state, self.rows, self.cell = 0, [], None  # 0 before, 1 in the container, 2 in the tbody, 3 after

    def handle_starttag(self, tag, attrs):
        if self.state == 0 and "table-inner" in (dict(attrs).get("class") or "").split():
            self.state = 1
        elif self.state == 1 and tag == "tbody":
            self.state = 2
        elif self.state == 2 and tag == "tr":
            self.rows.append([])
        elif self.state == 2 and tag == "td" and self.rows:
            self.rows[-1].append("")
            self.cell = True

    def handle_endtag(self, tag):
        if self.state == 2 and tag == "tbody":
            self.state = 3
        if tag == "td":
            self.cell = None

    def handle_data(self, data):
        if self.state == 2 and self.cell:
            self.rows[-1][-1] += data


#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Items(HTMLParser):
    """Texts of the li that are children of a ul whose class has `ul_class` in it, inside a div whose class has `div_class`; of all li
    where both are empty. An item's text has that of what is nested in it; an li ends the one before it in its list."""

    def __init__(self, div_class: str, ul_class: str):
        super().__init__()
        self.every, self.div_class, self.ul_class = not (div_class or ul_class), div_class, ul_class
        self.items, self.open = [], []  # for each open element: its tag, whether it is in a fitting div, whether a fitting ul, its item

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag == "li":
            lists = [i for i, x in enumerate(self.open) if x[0] in ("ul", "ol")]
            before = [i for i, x in enumerate(self.open) if x[0] == "li" and i > (lists[-1] if lists else -1)]
            if before:
                del self.open[before[0] :]
        _, inside, fits, _ = self.open[-1] if self.open else ("", not self.div_class, False, None)
        item = None
        if tag == "li" and (self.every or fits and inside):
            item = len(self.items)
            self.items.append("")
        own = dict(attrs).get("class") or ""
        if tag == "div" and self.div_class and self.div_class in own:
            inside = True
        self.open.append((tag, inside, tag == "ul" and self.ul_class in own, item))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for _, _, _, item in self.open:
            if item is not None:
                self.items[item] += data


#: The attributes by which a table of a city's stations is known.
CITY_TABLE = {"width": "100%", "border": "0", "cellpadding": "4", "cellspacing": "1"}


class _City(HTMLParser):
    """The first bold link in the first row of a city table, and the first font in the first link of each cell of its second row."""

    def __init__(self):
        super().__init__()
        self.tables, self.row, self.bold = [], 0, 0  # for each open table: whether it is a city table
        self.name, self.stations, self.text, self.links, self.fonts = None, [], None, 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            own = dict(attrs)
            self.tables.append(all(own.get(k) == v for k, v in CITY_TABLE.items()))
            if self.tables[-1]:
                self.row = 0
        elif tag == "b" or tag == "strong":
            self.bold += 1
        if not (self.tables and self.tables[-1]):
            return
        if tag == "tr":
            self.row += 1
        elif tag == "td":
            self.links = self.fonts = 0
        elif tag == "a":
            self.links += 1
            self.fonts = 0
            if self.row == 1 and self.name is None:
                self.text = ""
        elif tag == "font" and self.row == 2 and self.links == 1:
            self.fonts += 1
            if self.fonts == 1:
                self.text = ""

    def handle_data(self, data):
        if self.text is not None and (self.row == 2 or self.bold):
            self.text += data

    def handle_endtag(self, tag):
        if tag == "table" and self.tables:
            self.tables.pop()
        elif tag == "b" or tag == "strong":
            self.bold = max(0, self.bold - 1)
        elif self.text is not None and tag == ("a" if self.row == 1 else "font"):
            found, self.text = self.text.strip(), None
            if self.row == 1:
                self.name = found or None
            elif "站" in found:
                self.stations.append(found)


class _CityLinks(HTMLParser):
    """Of each city table, the first link of the first cell of its body's first row, if it has a bold part."""

    steps = ("tbody", "tr", "td", "a")

    def __init__(self):
        super().__init__()
        self.tables, self.links = [], []  # for each open table: how many of the steps were met
        self.url, self.name, self.bold = None, None, False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            own = dict(attrs)
            self.tables.append(0 if all(own.get(k) == v for k, v in CITY_TABLE.items()) else len(self.steps))
        elif tag == "b" and self.url is not None and self.name is None:
            self.name, self.bold = "", True
        elif self.tables and self.tables[-1] < len(self.steps) and tag == self.steps[self.tables[-1]]:
            self.tables[-1] += 1
            if tag == "a":
                self.url, self.name = dict(attrs).get("href") or "", None

    def handle_data(self, data):
        if self.bold:
            self.name += data

    def handle_endtag(self, tag):
        if tag == "table" and self.tables:
            self.tables.pop()
        elif tag == "b":
            self.bold = False
        elif tag == "a" and self.url is not None:
            if self.url and self.name is not None:
                self.links.append({"name": self.name.strip(), "url": self.url})
            self.url, self.bold = None, False
        elif self.tables and self.tables[-1] and tag in ("tbody", "tr", "td"):
            self.tables[-1] = len(self.steps)


def city_links_of(html: str | None) -> list[dict]:
    parser = _CityLinks()
    parser.feed(html or "")
    return parser.links


def city_of(html: str | None) -> dict:
    parser = _City()
    parser.feed(html or "")
    return {"city": parser.name, "stations": parser.stations}


def stops_of(html: str | None) -> list[dict] | None:
    if not html or "table-inner" not in html and "&" not in html:  # a class may be written with references
        return None
    parser = _Stops()
    parser.feed(html)
    stops = {}
    for row in parser.rows:
        cells = [c.strip() for c in row[:2]]
        if len(cells) == 2 and cells[0].isdigit() and cells[1]:
            stops[int(cells[0])] = cells[1]
    return [{"seq": k, "name": v} for k, v in sorted(stops.items())] or None


def items_of(html: str | None, div_class: str = "", ul_class: str = "") -> list[str]:
    parser = _Items(div_class, ul_class)
    parser.feed(html or "")
    return [x.strip() for x in parser.items]


STOPS = T.ArrayType(T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("name", T.StringType())]))


@F.pandas_udf(STOPS)
def extract_stop_table(html: pd.Series) -> pd.Series:
    return html.map(stops_of, na_action=None)


#: The classes of the list of trains of a page, and of the div that it is in.
TRAIN_DIV, TRAIN_LIST = "train_index_cz", "clearfix"


def extract_list_items(html: Column | str, div_class: str = TRAIN_DIV, ul_class: str = TRAIN_LIST) -> Column:
    """The trimmed texts, in order, of the items of lists whose class has ul_class in it, in a div whose class has div_class; of
    all items where both are empty. Null and other pages give none."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def items(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: items_of(x, div_class, ul_class), na_action=None)

    return items(html)


def numbered_items(items: Column) -> Column:
    """Items as numbered lines, which sources.files.read_train_number_files reads."""
    return F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


CITY = T.StructType([T.StructField("city", T.StringType()), T.StructField("stations", T.ArrayType(T.StringType()))])


@F.pandas_udf(CITY)
def extract_city_stations(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([city_of(x) for x in html], columns=["city", "stations"])


def city_stations(pages: DataFrame) -> DataFrame:
    """(page_id, city, stations) of pages (page_id, html) that name stations."""
    return pages.select("page_id", extract_city_stations("html").alias("c")).select("page_id", "c.*").where(F.size("stations") > 0)


LINKS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("url", T.StringType())]))


@F.pandas_udf(LINKS)
def extract_city_links(html: pd.Series) -> pd.Series:
    return html.map(city_links_of, na_action=None)


def city_links(pages: DataFrame, base: str | None = None, marker: str = "chengshi/") -> DataFrame:
    """(page_id, ord, name, url): links to the pages of cities of list pages (page_id, html), in their order.
    With a base, a url that doesn't start with http is base and what follows its last marker. Pages without
    links, or without html, give no row."""
    found = pages.select("page_id", F.posexplode(extract_city_links("html")).alias("ord", "link")).select("page_id", "ord", "link.name", "link.url")
    if base is None:
        return found
    tail = F.concat(F.lit(base), F.substring_index("url", marker, -1))
    return found.withColumn("url", F.when(F.col("url").startswith("http"), F.col("url")).otherwise(tail))


def city_station_totals(cities: DataFrame) -> DataFrame:
    """Cities with stations, and stations, of cities (city, stations)."""
    own = F.size("stations")
    return cities.where(own > 0).agg(F.count(F.lit(1)).alias("city_count"), F.coalesce(F.sum(own), F.lit(0)).alias("station_count"))


def ingest_pages(spark: SparkSession, source: str, target: str, checkpoint: str, files_at_once: int = 10) -> None:
    """Stop tables of new page files (Parquet: page_id, url, html) appended to target/stops, pages without
    one to target/failed, and how many there were of both to target/counts, taken as they are written. A stopped ingest goes on at its
    checkpoint; batches are told apart by number, so a batch that is done again takes the place of the first, its counts too."""

    def batch(df: DataFrame, number: int) -> None:
        found = kept(df.select("page_id", "url", extract_stop_table("html").alias("stops")), "pages")  # parsed once for both tables
        good, bad = Observation(f"good-{number}"), Observation(f"bad-{number}")
        n = F.count(F.lit(1)).alias("n")
        found.where(F.col("stops").isNotNull()).observe(good, n).write.mode("overwrite").parquet(f"{target}/stops/batch={number}")
        found.where(F.col("stops").isNull()).select("page_id", "url").observe(bad, n).write.mode("overwrite").parquet(f"{target}/failed/batch={number}")
        counts = df.sparkSession.range(1).select(F.lit(good.get["n"]).cast("long").alias("ok"), F.lit(bad.get["n"]).cast("long").alias("failed"))
        counts.write.mode("overwrite").parquet(f"{target}/counts/batch={number}")

    stream = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_at_once).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_totals(spark: SparkSession, target: str) -> DataFrame:
    """(batches, ok, failed) of all that ingest_pages has written to target, over every run."""
    counts = spark.read.parquet(f"{target}/counts")
    return counts.agg(F.count(F.lit(1)).alias("batches"), F.sum("ok").alias("ok"), F.sum("failed").alias("failed"))
