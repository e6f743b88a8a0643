"""Counts over feature tables and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, parse_tags


def tag_value_counts(features: DataFrame, key: str, n: int = 30) -> DataFrame:
    value = F.try_element_at(parse_tags(F.col("other_tags")), F.lit(key))
    counted = features.select(value.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "value").limit(n)


def duplicate_names(features: DataFrame) -> DataFrame:
    return features.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def table_profile(features: DataFrame) -> DataFrame:
    """Rows, rows with a name, and the columns with their types in order."""
    columns = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in features.schema.fields)
    return features.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce("name", F.lit("")) != "").alias("named")).withColumn("columns", F.lit(columns))


def cleaned(docs: DataFrame, keep_structure: bool = True) -> DataFrame:
    """docs (doc_id, text) cleaned, with sizes in code points and the reduction in percent (0 for empty)."""
    out = docs.select("doc_id", F.length("text").cast("long").alias("original_size"), clean_text(F.col("text"), keep_structure).alias("text"))
    out = out.withColumn("new_size", F.length("text").cast("long"))
    return out.withColumn("reduction", F.when(F.col("original_size") > 0, (1 - F.col("new_size") / F.col("original_size")) * 100).otherwise(0.0))


def cleaning_report(cleaned_docs: DataFrame) -> DataFrame:
    """Documents, those cleaned and failed (without text), the share of the cleaned in percent, and over those the sizes, the reduction
    of all together and the mean of the reductions; 0 where there are none."""
    ok = F.col("text").isNotNull()
    n, good = F.count(F.lit(1)), F.count_if(ok)
    total, new = (F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)) for c in ("original_size", "new_size"))
    return cleaned_docs.agg(
        n.alias("files"), good.alias("ok"), (n - good).alias("failed"), F.when(n > 0, F.round(good * 100 / n, 2)).otherwise(0.0).alias("success"), total.alias("original_size"), new.alias("new_size"),
        F.when(total > 0, F.round((1 - new / total) * 100, 4)).otherwise(0.0).alias("reduction"), F.coalesce(F.round(F.avg(F.when(ok, F.col("reduction"))), 4), F.lit(0.0)).alias("mean_reduction"),
    )


def cleaning_details(cleaned_docs: DataFrame) -> DataFrame:
    """The report's row for each document: doc_id, ok, sizes and reduction in percent; a failed one has no sizes."""
    ok = F.col("text").isNotNull()
    return cleaned_docs.select("doc_id", ok.alias("ok"), *[F.when(ok, F.col(c)).alias(c) for c in ("original_size", "new_size")], F.when(ok, F.round("reduction", 2)).alias("reduction"))


#: Run codes of documents and their labels.
RUN_LABELS = {"0": "UNSTART", "1": "RUNNING", "2": "CANCEL", "3": "DONE", "4": "FAIL"}
#: Parts of a status of which each gives its first documents, before the first of all are taken.
SALTS = 32


def parse_status_counts(docs: DataFrame) -> DataFrame:
    """docs (run) counted by run code, with labels and zeros."""
    labels = docs.sparkSession.createDataFrame(list(RUN_LABELS.items()), "run string, label string")
    return labels.join(docs.groupBy("run").agg(F.count(F.lit(1)).alias("n")), "run", "left").fillna(0, ["n"])


def parse_status_samples(docs: DataFrame, n: int = 5) -> DataFrame:
    """(run, rank, doc_id): the first n documents of each status, by doc_id."""
    part = F.row_number().over(Window.partitionBy("run", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy("doc_id"))
    few = docs.select("run", "doc_id", part.alias("part")).where(F.col("part") <= n)
    ranked = few.select("run", F.row_number().over(Window.partitionBy("run").orderBy("doc_id")).cast("long").alias("rank"), "doc_id")
    return ranked.where(F.col("rank") <= n)


def top_names(features: DataFrame, n: int = 30) -> DataFrame:
    counted = features.where(F.coalesce("name", F.lit("")) != "").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "name").limit(n)
