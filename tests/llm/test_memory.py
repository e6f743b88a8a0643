"""Operators in a heap of their own, as small as an executor's."""

import subprocess
import sys
from pathlib import Path

SHARDS = """
from pyspark.sql import SparkSession, functions as F
from ferrovia.llm import sharding
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "1800m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
text = F.concat(F.col("doc_id").cast("string"), F.repeat(F.sha2(F.col("doc_id").cast("string"), 256), 1600))
docs = spark.range(0, 2400, 1, 16).select(F.col("id").alias("doc_id")).withColumn("text", text)  # 4 shards of 60 MB
found = sharding.shuffled_shards(docs, shards=4)
rows = found.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
assert len(rows) == 4 and sum(r.n for r in rows) == 2400 and all(r.n == r.slots == r.last + 1 for r in rows)
print("buckets of", sharding.bucket_bytes_of(spark))
"""


def test_full_buckets_fit_their_tasks():
    done = subprocess.run([sys.executable, "-c", SHARDS], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "buckets of 1" in done.stdout
