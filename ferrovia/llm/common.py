"""Shared folders, written tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression class body.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is
    unset on a local master (a test on one machine), a temporary folder is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: its lineage is cut and
    it is computed once, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """df (a written table), broadcast if it has at most `most` rows; else as it is, and
    Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fits(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def columns_of(struct: str, names: list[str]) -> list:
    """The columns of a struct under their own names, whatever those hold."""
    return [F.col(struct).getField(c).alias(c) for c in names]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_bucket(doc_id, parts: int):
    """crc32 of doc_id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def held_out(doc_id, parts: int):
    """Whether a document is kept from learning: its remainder is 0. A null id has no
    remainder and is not held out."""
    return F.coalesce(doc_bucket(doc_id, parts) == 0, F.lit(False))


def lower_ascii(text):
    return F.translate(text, UPPER, LOWER)
