"""Tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> None:
    """Sees to it that checkpoints have a folder: the one that spark.checkpoint.dir names, or a temporary one on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not spark.conf.get("spark.checkpoint.dir", None) and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='spark-')}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of checkpoints; it is deleted when the application ends."""
    _shared(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def stored(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut, in the folder that spark.checkpoint.dir names (a temporary one
    is set where it is unset on a local master)."""
    _shared(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer: a file of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: With this, an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Where Spark reads files in smaller blocks than this, a table of them would come back in as many tasks: it is a checkpoint instead.
LEAST_BLOCK = 1 << 18


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df computed once, as compressed columns in the folder of checkpoints: for tables of as many rows as the input, of which a
    checkpoint takes several times the disk. What its steps shuffled is deleted at once. The order of rows isn't kept."""
    if df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes() < LEAST_BLOCK:
        return stored(df)
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of names and a few numbers, about 100 bytes each, that are broadcast at most.
FEW = 1_000_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_some(big: DataFrame, some: DataFrame, on: list[str], most: int = FEW) -> DataFrame:
    """big with the columns of some (one row for each of the keys `on`), null where it has none. Where there are few keys, only the rows
    of big that have one are shuffled."""
    keys = some.select(on)
    if keys.limit(most + 1).count() > most:
        return big.join(some, on, "left")
    more = [x for x in some.schema if x.name not in on]
    met = big.join(F.broadcast(keys), on, "left_semi").join(some, on)
    rest = big.join(F.broadcast(keys), on, "left_anti")
    return met.unionByName(rest.select("*", *[F.lit(None).cast(x.dataType).alias(x.name) for x in more]))
