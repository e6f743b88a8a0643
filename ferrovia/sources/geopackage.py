"""Feature tables of map extracts: GeoPackage (SQLite) files read by ranges of fid, or columnar copies. A box goes to
the file's own R-tree, and equality of texts and ranges of fid that a query asks for go into what is read."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Features in a partition, and rows in a batch of it.
STEP, BATCH = 100_000, 4096
#: Columns of the feature tables, as far as operators read them.
COLUMNS = {
    "points": ("name", "other_tags"),
    "lines": ("name", "railway", "other_tags"),
    "multilinestrings": ("name", "type", "other_tags"),
}


class FidRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


#: Comparisons that are pushed into a read, as SQL has them.
PUSHED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class FeatureReader(DataSourceReader):
    """Reads the rows that pass the pushed filters and, with a box (west, east, south, north), whose bounds in the R-tree touch it."""

    def __init__(self, path: str, table: str, columns: list[str], step: int, box: tuple[float, ...] | None = None):
        self.path, self.table, self.columns, self.step, self.box = path, table, columns, step, box
        self.where: list[tuple[str, object]] = []

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality of text columns and comparisons of fid; the others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in PUSHED and f.value is not None and (name == "fid" or name in self.columns and type(f) is EqualTo):
                self.where.append((f'"{name}" {PUSHED[type(f)]} ?', f.value))
            else:
                yield f

    def _condition(self) -> tuple[str, list]:
        """What follows WHERE, and its values."""
        parts, values = [x for x, _ in self.where], [v for _, v in self.where]
        if self.box is not None:
            parts.append(f'fid IN (SELECT id FROM "rtree_{self.table}_geom" WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)')
            values += self.box
        return " AND ".join(parts) or "1", values

    def partitions(self) -> list[FidRange]:
        condition, values = self._condition()
        with self._open() as db:
            low, high = db.execute(f'SELECT min(fid), max(fid) FROM "{self.table}" WHERE {condition}', values).fetchone()
        return [FidRange(x, min(x + self.step - 1, high)) for x in range(low, high + 1, self.step)] if low is not None else [FidRange(0, -1)]

    def read(self, partition: FidRange) -> Iterator[pa.RecordBatch]:
        condition, values = self._condition()
        with self._open() as db:
            rows = db.execute(f'SELECT fid, {", ".join(self.columns)}, geom FROM "{self.table}" WHERE fid BETWEEN ? AND ? AND {condition} ORDER BY fid', (partition.low, partition.high, *values))
            types = [pa.int64(), *[pa.string()] * len(self.columns), pa.binary()]
            while part := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), types, strict=True)], ["fid", *self.columns, "geom"])


class GeoPackage(DataSource):
    """Options path (which every executor must reach: a shared mount), table, step, and box as west,east,south,north."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _columns(self) -> list[str]:
        return list(COLUMNS[self.options["table"]])

    def schema(self) -> str:
        return ", ".join(["fid long", *[f"{c} string" for c in self._columns()], "geom binary"])

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(self.options["path"], self.options["table"], self._columns(), int(self.options.get("step", STEP)), tuple(map(float, self.options["box"].split(","))) if "box" in self.options else None)


def read_osm_features(spark: SparkSession, path: str, table: str, step: int = STEP, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The features of a table (points, lines or multilinestrings): fid, its text columns and geom. A path that ends in .gpkg is
    read in place, by ranges of fid, and of a filter on fid or on the text of a column only what passes is read; any other is a folder of Parquet
    with one subfolder for each table. With box (west, east, south, north), those whose bounds touch it: by the file's R-tree, or by the columns minx,
    maxx, miny and maxy of the copy."""
    if path.endswith(".gpkg"):
        spark.dataSource.register(GeoPackage)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        reader = spark.read.format("geopackage").option("table", table).option("step", step)
        return (reader if box is None else reader.option("box", ",".join(map(repr, map(float, box))))).load(path)
    rows = spark.read.parquet(f"{path}/{table}")
    if box is not None:
        west, east, south, north = map(float, box)
        rows = rows.where((F.col("maxx") >= west) & (F.col("minx") <= east) & (F.col("maxy") >= south) & (F.col("miny") <= north))
    return rows.select("fid", *COLUMNS[table], "geom")
