"""Mixing sources to target weights.

Words are summed by source, targets follow from the weights under a cap, and each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with the
fraction of the rate as its probability. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of, fits, written

#: Rows of the source table up to which it is broadcast (about 60 bytes each).
BROADCAST_SOURCES = 50_000
SALTS = 32


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(per_source: DataFrame, weights: tuple[float, ...], total_ratio: float, cap_ratio: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, take the weights in turn. They share
    total_ratio times all sizes by weight; a target stops at cap_ratio times its
    source's size and the excess goes to the others by weight until none is above. That
    limit is a common level: sources are taken in order of cap / weight, and the first at
    which the level of what is left stays under the cap sets it for all later ones.
    The windows run over one row per source. Ties in cap / weight go by source.
    """
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.select(
        "source", "source_size", (F.lit(cap_ratio) * F.col("source_size")).alias("cap"),
        F.element_at(kinds, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.lit(total_ratio) * F.sum("source_size").over(everything)).alias("total"),
    )
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    left = F.col("total") - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    levels = ranked.select(
        "*", F.row_number().over(by_cap).alias("rank"),
        (left / F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))).alias("level"),
    )
    settled = levels.withColumn(
        "first", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("rank", "level"))).over(everything)
    )
    target = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), F.col("cap")).otherwise(F.col("first.level") * F.col("weight"))
    return settled.select("source", "source_size", target.alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on key and seed alone: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_ratio: float = 1.5, cap_ratio: float = 2.0, seed: str = "mix", size: Column | None = None
) -> DataFrame:
    """(record, mix): the columns of docs as a struct, and a struct of size, source_size, target and copies.

    docs needs doc_id, text and source. A null text has size 0, a null source is a
    source of its own, a source without words has target 0 and no copies. A null doc_id
    draws by its text. Rows that agree in doc_id draw alike. An empty table stays empty.
    Any other column, whatever its name, is carried as it is.
    """
    measured = n_words(F.col("text")) if size is None else size
    sized = docs.select(F.struct(*docs.columns).alias("record"), F.col("source").alias("source"), measured.alias("size"))
    per_source = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    targets = source_targets(per_source, weights, total_ratio, cap_ratio).withColumnRenamed("source", "of")
    if fits(per_source, BROADCAST_SOURCES):
        joined = sized.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("of")), "left")
    else:  # a source may hold a third of all rows: it is dealt over SALTS partitions
        salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = sized.withColumn("own", F.pmod(F.xxhash64("record.doc_id", "record.text"), F.lit(SALTS)).cast("int"))
        joined = sized.join(salted, F.col("source").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.coalesce(F.col("record.doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("record.text"), F.lit("")).cast("binary"))))
    copies = F.floor(rate) + F.when(uniform(key, seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.select("record", F.struct("size", "source_size", "target", copies.cast("long").alias("copies")).alias("mix"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    taken = with_copies(docs, **how).where(F.col("mix.copies") > 0)
    copied = taken.select("record", F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int"))).alias("copy"))
    return copied.select(*columns_of("record", docs.columns))
