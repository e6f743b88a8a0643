"""Hard negatives by slots of scores.

Anchors meet all rows in blocks: a task scores a block of anchors against a tile of rows by one
integer product. First come each anchor's positives. Their scores are the upper limits of windows
that overlap; they cut the scores into disjoint slots, and each task keeps the best of each anchor and slot, so do
the steps that combine tasks. A window is a run of slots from its limit down: the slots' best,
merged in descending order and ended at the window's lower limit, answer all windows of an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, written
from .neighbours import matrix

#: Bytes of vectors in a tile of rows, those that a task packs at once, and those of a block of anchors (all as doubles).
TILE_BYTES, HELD_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20, 1 << 20
#: Blocks of anchors are broadcast up to this many.
BROADCAST_BLOCKS = 24
#: Lengths of vectors with anchors are broadcast up to this many.
BROADCAST_LENGTHS = 100_000
#: Anchors that are looked at at once, against a tile.
ANCHORS = 128

PACKED = "dim int, kind string, rows int, ids binary, labels binary, vectors binary"


def per_pack(dim, size: int):
    """Vectors of a length that fit in so many bytes."""
    return F.greatest(F.floor(F.lit(size) / (dim * 8 + 16)), F.lit(1)) if isinstance(dim, Column) else max(1, size // (dim * 8 + 16))


def _packed(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict:
    """Rows in order of their id, as bytes."""
    order = np.argsort(ids, kind="stable")
    return {
        "dim": vectors.shape[1], "kind": str(vectors.dtype), "rows": len(ids), "ids": ids[order].astype(np.int64).tobytes(),
        "labels": labels[order].astype(np.int64).tobytes(), "vectors": np.ascontiguousarray(vectors[order]).tobytes(),
    }


def _tiles(rows: DataFrame) -> DataFrame:
    """All rows (vec_id, label, vector), packed by length of the vector where they are."""
    names = [x.split()[0] for x in PACKED.split(", ")]
    types = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for d, parts in held.items():
                ids, labels, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
                step = per_pack(d, TILE_BYTES)
                for i in range(0, len(ids), step):
                    one = _packed(ids[i : i + step], labels[i : i + step], vectors[i : i + step])
                    yield pa.RecordBatch.from_arrays([pa.array([one[k]], t) for k, t in zip(names, types, strict=True)], names)
            held.clear()

        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d, (at, vectors) in matrix(batch.column(2)).items():
                held.setdefault(d, []).append((ids[at], labels[at], vectors))
                size += vectors.nbytes + 16 * len(at)
            if size >= HELD_BYTES:
                yield from passed_on()
                size = 0
        yield from passed_on()

    packed = rows.select("vec_id", "label", "vector").mapInArrow(run, PACKED)
    return written(packed.withColumn("tile", F.monotonically_increasing_id()), "negative-tiles")


def _blocks(anchors: DataFrame) -> DataFrame:
    """The anchors in blocks, numbered from 0 for each length of vector."""
    dim = F.size("vector")
    counts = written(anchors.groupBy(dim.alias("dim")).agg(F.count(F.lit(1)).alias("n")), "anchor-lengths")
    counts = counts.select("dim", F.ceil(F.col("n") / per_pack(F.col("dim"), BLOCK_BYTES)).cast("int").alias("blocks"))
    seated = anchors.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", dim).join(broadcast_if(counts, BROADCAST_LENGTHS), "dim")
    seated = seated.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = _packed(pdf["vec_id"].to_numpy(), pdf["label"].to_numpy(), np.stack(pdf["vector"].to_list()))
        return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy()} | {k: [x] for k, x in one.items()})

    return written(seated.select("dim", "block", "vec_id", "label", "vector").groupBy("dim", "block").applyInPandas(run, f"block int, {PACKED}"), "anchor-blocks")


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), scale a power of two: doubles while those hold all the numbers, Python's integers beyond."""
    x = vectors.astype(np.float64)
    if not x.size or np.abs(x).max() < 2.0**1000 / scale:
        return np.floor(x * scale)
    as_int = np.frompyfunc(lambda v: int(v) * scale if abs(v) > 2.0**53 else int(np.floor(v * scale)), 1, 1)
    return as_int(x)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit integers; what is beyond those is put at their end."""
    if a.dtype != object and b.dtype != object:
        most = (np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
        if most < 2.0**24:
            return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
        if most < 2.0**53:
            return (a @ b.T).astype(np.int64)
    big = np.frompyfunc(int, 1, 1)
    found = big(a) @ big(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(found, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the first `top` of each group, by descending score, then id."""
    order = np.lexsort((ids, -score, group))
    ordered = group[order]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    place = np.arange(len(ordered)) - np.repeat(begin, np.diff(np.append(begin, len(ordered))))
    return order[place < top]


class _Pack:
    def __init__(self, row: dict, scale: int):
        self.ids, self.labels = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels"))
        self.numbers = whole(np.frombuffer(row["vectors"], np.dtype(row["kind"])).reshape(row["rows"], row["dim"]), scale)


def _met(tiles: DataFrame, blocks: DataFrame):
    """Every tile beside every block of anchors of its length, each pair a group of one row."""
    numbers = written(blocks.groupBy("dim").agg(F.max("block").alias("last")), "block-numbers")
    tile = tiles.join(broadcast_if(numbers, BROADCAST_LENGTHS), "dim").select("dim", "tile", F.struct("dim", "kind", "rows", "ids", "labels", "vectors").alias("held"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"))
    extra = [c for c in blocks.columns if c not in ("dim", "block")]
    anchors = blocks.select("dim", "block", F.struct("dim", *extra).alias("anchors"))
    return tile.join(broadcast_if(anchors, BROADCAST_BLOCKS), ["dim", "block"]).groupBy("tile", "block")


def _positives(tiles: DataFrame, blocks: DataFrame, top: int, scale: int) -> DataFrame:
    """(dim, block, anchor, id, score, place): the first `top` other rows of each anchor's label."""

    def run(met: pa.Table) -> pa.Table:
        row, out = met.to_pylist()[0], []
        a, b = _Pack(row["anchors"], scale), _Pack(row["held"], scale)
        for i in range(0, len(a.ids), ANCHORS):
            score = products(a.numbers[i : i + ANCHORS], b.numbers)
            other = (a.labels[i : i + ANCHORS, None] == b.labels) & (a.ids[i : i + ANCHORS, None] != b.ids)
            if other.shape[1] > top:  # what is below the top-th of a row can't be among its first
                ranked = np.where(other, score, np.iinfo(np.int64).min)
                other &= score >= np.partition(ranked, -top, axis=1)[:, -top, None]
            anchor, at = np.nonzero(other)
            took = _first(anchor, score[anchor, at], b.ids[at], top)
            anchor, at = anchor[took], at[took]
            out.append(_rows(row, i + anchor, b.ids[at], score[anchor, at], anchor_id=a.ids[i + anchor]))
        return pa.Table.from_batches(out)

    every = _met(tiles, blocks).applyInArrow(run, "dim int, block int, anchor int, id bigint, score bigint, anchor_id bigint")
    of_anchor = Window.partitionBy("dim", "block", "anchor").orderBy(F.col("score").desc(), "id")
    return written(every.withColumn("place", F.row_number().over(of_anchor)).where(F.col("place") <= top), "positives")


def _rows(row: dict, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    columns = {"dim": np.full(len(ids), row["dim"], np.int32), "block": np.full(len(ids), row["block"], np.int32), "anchor": anchor.astype(np.int32), "id": ids, "score": score} | more
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _per_cent(score: Column, part: int, add: int) -> Column:
    """(part * score + add) / 100 for a score of at least 0, in whole numbers."""
    return F.call_function("div", score.cast("decimal(20,0)") * F.lit(part).cast("decimal(3,0)") + F.lit(add).cast("decimal(3,0)"), F.lit(100).cast("decimal(3,0)"))


def _slotted(tiles: DataFrame, blocks: DataFrame, slots: int, top: int, scale: int) -> DataFrame:
    """(dim, block, anchor, id, score, slot): the first `top` rows of other labels in each slot of an anchor. Slot s holds
    scores from above limit s + 1 up to limit s; blocks carry the limits."""

    def run(met: pa.Table) -> pa.Table:
        row, out = met.to_pylist()[0], []
        a, b, given = _Pack(row["anchors"], scale), _Pack(row["held"], scale), row["anchors"]["limits"]
        limits = np.full((len(a.ids), slots), np.iinfo(np.int64).min)
        limits[[x["anchor"] for x in given], [x["place"] - 1 for x in given]] = [x["limit"] for x in given]
        floors = np.full(len(a.ids), np.iinfo(np.int64).max)
        np.minimum.at(floors, np.array([x["anchor"] for x in given], np.int64), np.array([x["floor"] for x in given], np.int64))
        for i in range(0, len(a.ids), ANCHORS):
            own = slice(i, i + ANCHORS)
            score = products(a.numbers[own], b.numbers)
            inside = (score <= limits[own, :1]) & (score >= floors[own, None]) & (a.labels[own, None] != b.labels)
            anchor, at = np.nonzero(inside)
            value = score[anchor, at]
            slot = (limits[i + anchor] >= value[:, None]).sum(axis=1) - 1
            took = _first(anchor * slots + slot, value, b.ids[at], top)
            anchor, at = anchor[took], at[took]
            out.append(_rows(row, i + anchor, b.ids[at], value[took], slot=slot[took].astype(np.int32)))
        return pa.Table.from_batches(out)

    every = _met(tiles, blocks).applyInArrow(run, "dim int, block int, anchor int, id bigint, score bigint, slot int")
    of_slot = Window.partitionBy("dim", "block", "anchor", "slot").orderBy(F.col("score").desc(), "id")
    return written(every.withColumn("place", F.row_number().over(of_slot)).where(F.col("place") <= top), "slotted")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, top: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, place, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding).

    A component x becomes floor(scale * x), scale being a power of two; a row's score is its integer inner product with the anchor,
    exact, put at the end of a 64-bit integer where it is beyond. Higher scores come first, ties by smaller vec_id. An anchor's
    positives are its first `positives` other rows of the same label, place telling which; for each the first `top` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score come back, rank from 1 (high is up to 100, low up to high).

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part. Vectors of
    different lengths don't meet. Rows of the anchor's vec_id are the anchor itself; other rows that repeat are each a
    positive or negative, and an anchor that repeats returns its rows as often. An anchor without positives, a
    positive without negatives and an empty table return none; other columns are passed over.
    """
    if not 0 <= low <= high <= 100 or scale < 1 or scale & (scale - 1):
        raise ValueError("limits are whole per cents with low <= high, scale is a power of two")
    of = rows.schema["embedding"].dataType.elementType.simpleString()
    vector = F.col("embedding") if of in ("float", "double") else F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & finite
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector")]
    rows = rows.where(there)
    tiles, blocks = _tiles(rows.select(columns)), _blocks(rows.where(is_anchor).select(columns))
    found = _positives(tiles, blocks, positives, scale)
    # of a score below 0 the window is empty: low * score is above high * score
    windows = found.where("score >= 0").withColumn("limit", _per_cent(F.col("score"), high, 0)).withColumn("floor", _per_cent(F.col("score"), low, 99))
    sets = windows.groupBy("dim", "block").agg(F.collect_list(F.struct("anchor", "place", "limit", "floor")).alias("limits"))
    best = _slotted(tiles, blocks.join(sets, ["dim", "block"]), positives, top, scale)
    # a window starts at the slot of its limit, that of the last place with that limit
    of_anchor = ["dim", "block", "anchor"]
    windows = windows.withColumn("from", F.max("place").over(Window.partitionBy(*of_anchor, "limit")) - 1)
    own = windows.select(*of_anchor, "anchor_id", "place", "from", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "floor")
    best = best.select(*of_anchor, "slot", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    merged = own.join(best, of_anchor).where((F.col("slot") >= F.col("from")) & (F.col("negative_score") >= F.col("floor")))
    rank = F.row_number().over(Window.partitionBy(*of_anchor, "place").orderBy(F.col("negative_score").desc(), "negative_id")).cast("int")
    merged = merged.withColumn("rank", rank).where(F.col("rank") <= top)
    return merged.select("anchor_id", "positive_id", "place", "rank", "negative_id", "positive_score", "negative_score")
