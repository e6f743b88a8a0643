"""Sharding by a two-pass external shuffle.

Pass one scatters records over memory-sized buckets by a seeded hash. Pass two shuffles
each bucket by Fisher-Yates (Spark's seeded shuffle of an array) and writes it. All steps
are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, new_path, written

#: Of a task's share of the heap, what the records of a bucket take: they are gathered in an array, sorted, shuffled and written,
#: each of which holds them once more.
BUCKET_SHARE = 32
#: Bytes of records that a bucket holds on average, at most.
MOST_BUCKET_BYTES = 32 << 20
#: The table of buckets is broadcast up to this many rows of about 40 bytes.
BROADCAST_BUCKETS = 200_000
#: Copies of a row that are made in one step.
STEP = 10_000


def bucket_bytes_of(spark: SparkSession) -> int:
    """Bytes of a bucket, by the heap that a task of the session's executors has to itself."""
    context, runtime = spark.sparkContext, spark._jvm.java.lang.Runtime.getRuntime()
    if context.master.startswith("local"):
        heap, cores = runtime.maxMemory(), context.defaultParallelism
    else:
        heap = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(context.getConf().get("spark.executor.memory", "1g"))
        cores = int(context.getConf().get("spark.executor.cores", "1"))
    return max(1 << 20, min(MOST_BUCKET_BYTES, heap // max(1, cores) // BUCKET_SHARE))


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16).cast("long")


def shard_of(doc_id: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with doc_id is largest. With one more shard a row either stays
    or goes to the new one."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), doc_id, s).alias("h"), s.alias("s")))
    return F.array_max(scores)["s"]


def shuffled_shards(docs: DataFrame, shards: int = 40, seed: int = 20_260_101, bucket_bytes: int | None = None, path: str | None = None) -> DataFrame:
    """Write docs as a parquet table partitioned by shard, in shuffled order, and return it
    as read back: the columns of docs in a struct `record`, with shard, grown_shard (the
    shard if there were one more) and slot (the place in the shard, gapless from 0).

    doc_id and the number of shards decide the shard. A null doc_id hashes as null, so
    all such rows share a shard, which gets as many buckets as its bytes ask for. Buckets are dealt by all
    columns, so copies of a text spread. Rows that are equal in every column are interchangeable: where
    they would fill a quarter of a bucket, they are dealt by their number among themselves. A record of more
    than a bucket is a bucket's alone with what is dealt there. bucket_bytes, if not given, goes by the memory of a task. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bucket_bytes = bucket_bytes or bucket_bytes_of(spark)
    dealt = docs.select(
        F.struct(*docs.columns).alias("record"), shard_of(F.col("doc_id"), shards, seed).alias("shard"), record_size(F.col("text")).alias("size"),
        F.struct(F.xxhash64(*docs.columns).alias("a"), F.xxhash64(F.lit(seed), *docs.columns).alias("b")).alias("same"),
    )
    counts = written(dealt.groupBy("shard", "same").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")), "shard-counts")
    per_shard = counts.groupBy("shard").agg(F.greatest(F.ceil(F.sum(F.col("n") * F.col("size")) / bucket_bytes), F.lit(1)).cast("int").alias("buckets"))
    per_shard = written(per_shard.withColumn("before", (F.sum("buckets").over(Window.orderBy("shard")) - F.col("buckets")).cast("int")), "shards")  # a row for each shard
    parts = per_shard.agg(F.sum("buckets")).first()[0] or 1
    hot = counts.where((F.col("n") > 1) & (F.col("n") * F.col("size") * 4 >= bucket_bytes)).select("same")
    rows = dealt.select("record", "shard", "same", F.lit(0).alias("copy"))
    if hot.limit(1).count():
        hot = broadcast_if(hot, BROADCAST_BUCKETS)
        alike = dealt.join(hot, "same", "left_semi").groupBy("record", "shard", "same").agg(F.count(F.lit(1)).alias("n"))
        steps = alike.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STEP))))
        copies = F.sequence(F.col("step") * STEP, F.least((F.col("step") + 1) * STEP, F.col("n")) - 1)
        alike = steps.repartition(F.col("same"), F.col("step")).select("record", "shard", "same", F.explode(copies.cast("array<int>")).alias("copy"))
        rows = rows.join(hot, "same", "left_anti").select("record", "shard", "same", "copy").union(alike)
    bucket = F.col("before") + F.pmod(F.xxhash64(F.lit(seed + 1), "same", "copy"), F.col("buckets")).cast("int")
    # a bucket is a partition: Spark seeds its shuffle by partition, so reruns agree
    placed = rows.join(F.broadcast(per_shard), "shard").select("record", "shard", bucket.alias("bucket"), F.struct("same", "copy").alias("key"))
    # within a bucket the order before the shuffle must not depend on arrival
    one = F.array_sort(F.collect_list(F.struct("key", "record")))
    buckets = placed.repartitionById(parts, F.col("bucket")).groupBy("shard", "bucket").agg(one.alias("records"))
    turned = buckets.select("shard", "bucket", F.posexplode(F.shuffle(F.col("records"), F.lit(seed))).alias("at", "item"))
    folder = path or new_path(spark, "shards")
    turned = turned.select(F.col("item.record").alias("record"), "bucket", "at", "shard")
    turned.write.partitionBy("shard").parquet(folder)
    back = spark.read.schema(turned.schema).parquet(folder)
    sizes = written(back.groupBy("shard", "bucket").count(), "shard-buckets")
    starts = sizes.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("start"))
    placed = back.join(broadcast_if(written(starts, "shard-starts"), BROADCAST_BUCKETS), ["shard", "bucket"])
    return placed.select("record", "shard", shard_of(F.col("record.doc_id"), shards + 1, seed).alias("grown_shard"), (F.col("start") + F.col("at")).cast("long").alias("slot"))
