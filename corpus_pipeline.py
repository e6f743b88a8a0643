"""The corpus pipeline: documents to packed sequences.

Each stage is (name, function of (spark, docs, sf_dir)); run() writes what a stage returns as
Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrovia.llm import jaccard, langid, mixing, packing
from ferrovia.llm.common import broadcast_if, columns_of, documents, held_out, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no letter (or is null) go, whatever else they hold; a null lang is filled with the
    label. Without any lang to learn from, langs stay null. Rows that repeat all stay, and so do other
    columns; an empty table stays empty."""
    model = langid.learn(docs.where(~held_out(F.col("doc_id"), 5)).select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(langid.has_letter(F.col("text")))
    kept = langid.label(docs, model).where(F.col("language.lang_pred") != "und")
    filled = F.coalesce("record.lang", "language.lang_pred").alias("lang")
    return kept.select(*[filled if c == "lang" else F.col("record").getField(c).alias(c) for c in docs.columns])


#: Ids are broadcast up to this many (16 bytes each with the hash of the text, about 100 in a hash table).
BROADCAST_IDS = 1_000_000


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5 words, 0.8) the row of the least doc_id stays (of
    several texts under that id, the one of the least hash). Each row is judged by its own text: a
    wordless one is in no group. Rows that agree in doc_id and text stay once; a row without an
    id stays."""
    key, digest = ["doc_id", "digest"], F.xxhash64("text").alias("digest")
    keyed = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", digest)).alias("doc_id"), "text")
    found = jaccard.near_duplicates(keyed, k=5, percent=80).where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    rows = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("doc_id") != F.col("component_id")).alias("gone"))
    ids = written(rows.select("doc_id.*", "rows", "gone"), "groups")
    gone, again = ids.where("gone").select(*key), ids.where("not gone and rows > 1").select(*key)
    out = docs.select(F.struct(*docs.columns).alias("record"), "doc_id", digest).join(broadcast_if(gone, BROADCAST_IDS), key, "left_anti")
    if again.limit(1).count():
        again = broadcast_if(again, BROADCAST_IDS)
        once = out.join(again, key, "left_semi").select("record", *key, "record.text").dropDuplicates([*key, "text"])
        out = out.join(again, key, "left_anti").unionByName(once.drop("text"))
    return out.select(*columns_of("record", docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most twice: rows of equal doc_id draw alike, a null id draws
    by its text, a null source is one of its own, wordless texts have no words to take and go with a source that has
    none. Other columns stay; an empty table stays empty."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of at most 2048 tokens: one row per piece, with its ids. A null or empty text is one end
    token; rows that repeat are packed each; null ids are kept; an empty table has no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language_id", language_stage), ("ngram_jaccard", near_duplicate_stage), ("source_mixing", mixing_stage), ("cost_balanced_packing", packing_stage)]

#: SQL cannot tell languages, link by shingles at this size, or tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
