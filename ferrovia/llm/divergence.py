"""How the sources of each language differ in the terms they use.

Late materialization of strings: tasks count terms under 64-bit digests, and only digests of fixed
width are shuffled. Once it is known which terms a language keeps, the least and the greatest string of
each kept digest are gathered; where they differ, different terms share the digest, and those are
counted again by their strings. Strings are joined back for the rows that are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import broadcast_if, fits, written

#: Counted rows that a task combines at once, and that it holds before it passes them on.
COMBINE = 1 << 20
#: Strings that a task remembers to leave out repeats; then it starts anew.
KEPT_STRINGS = 500_000
#: Digests are broadcast up to this many (8 bytes each), groups up to that many (about 100 bytes each).
BROADCAST_DIGESTS, BROADCAST_GROUPS = 2_000_000, 200_000
#: Terms, about, and sources of a block that meet in a task when sources are compared.
TERMS, SOURCES = 2048, 256

#: Bytes of a term: letters of ASCII and all of any other character.
IS_TERM = np.zeros(256, bool)
IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True

COUNTED = "lang string, source string, digest bigint, n bigint, docs bigint"


def _terms(column: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes in lower case, starts, ends, row from 0, digests of `bits` bits) of the terms, by slices."""
    for i, j, data, offsets in tv.texts(column):
        lower = tv.LOWER[data]
        starts, ends, first = tv.runs(IS_TERM[data], offsets)
        digests = tv.segment_hashes(lower, starts, ends)
        if bits < 64:
            digests = digests & np.uint64((1 << bits) - 1)
        yield i, lower, starts, ends, np.repeat(np.arange(j - i), np.diff(first)), digests.view(np.int64)


class _Groups:
    """Numbers for the (lang, source) pairs that a task meets."""

    def __init__(self):
        self.number: dict[tuple[str, str], int] = {}

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        return np.array([self.number.setdefault(x, len(self.number)) for x in pairs], np.int64)

    def names(self, which: np.ndarray) -> list[pa.Array]:
        known, which = list(self.number), pa.array(which)
        return [pa.array([x[i] for x in known], pa.string()).take(which) for i in (0, 1)]


def _combined(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows (group, digest, n, docs) with sums for each group and digest."""
    group, digest, n, docs = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((digest, group))
    group, digest = group[order], digest[order]
    at = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (digest[1:] != digest[:-1]))))
    return group[at], digest[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at)


def counted(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, source, digest, n, docs): occurrences of a digest and documents with it, summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, size = _Groups(), [], 0

        def passed_on() -> pa.RecordBatch:
            group, digest, n, docs = held.pop()
            return pa.RecordBatch.from_arrays([*groups.names(group), pa.array(digest), pa.array(n), pa.array(docs)], ["lang", "source", "digest", "n", "docs"])

        for batch in batches:
            of = groups.of(batch)
            for i, _, starts, _, own, digests in _terms(batch.column(2), bits):
                if not len(starts):
                    continue
                order = np.lexsort((digests, own))
                own, digests = own[order], digests[order]
                at = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (digests[1:] != digests[:-1]))))
                held.append((of[i + own[at]], digests[at], np.diff(np.append(at, len(own))), np.ones(len(at), np.int64)))
                size += len(at)
                if size >= COMBINE:
                    held[:] = [_combined(held)]
                    size = len(held[0][0])
                    if size >= COMBINE // 2:
                        yield passed_on()
                        size = 0
        if held:
            held[:] = [_combined(held)]
            yield passed_on()

    return docs.select("lang", "source", "text").mapInArrow(run, COUNTED)


def strings(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(digest, term): the strings of every digest. A task repeats few of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bytes] = {}
        for batch in batches:
            for _, lower, starts, ends, _, digests in _terms(batch.column(0), bits):
                if not len(starts):
                    continue
                # every occurrence is held against the first of its digest in the slice
                _, first, back = np.unique(digests, return_index=True, return_inverse=True)
                odd = np.flatnonzero(~equal_segments(lower, starts, ends, first[back]))
                buffer, out = lower.tobytes(), []
                for k in np.concatenate([first, odd]).tolist():
                    digest, term = int(digests[k]), buffer[starts[k] : ends[k]]
                    if seen.get(digest) != term:
                        if len(seen) >= KEPT_STRINGS:
                            seen.clear()
                        seen.setdefault(digest, term)
                        out.append((digest, term))
                if out:
                    columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["digest", "term"])

    return docs.select("text").mapInArrow(run, "digest bigint, term string")


def equal_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether segment i holds the same bytes as segment other[i]."""
    size = ends - starts
    same = size == size[other]
    live = np.flatnonzero(same & (other != np.arange(len(other))))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    loads = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at = 0
    while len(live):
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
        good = ((loads[starts[live] + at] ^ loads[starts[other[live]] + at]) & mask) == 0
        same[live[~good]] = False
        at += 8
        live = live[good & (size[live] > at)]
    return same


def counted_by_string(docs: DataFrame, wanted: DataFrame, bits: int = 64) -> DataFrame:
    """counted(), with the term, of those digests only that are in wanted (digest)."""
    few = np.sort(np.array([r[0] for r in wanted.collect()], np.int64)) if fits(wanted, BROADCAST_DIGESTS // 8) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups()
        for batch in batches:
            of = groups.of(batch)
            for i, lower, starts, ends, own, digests in _terms(batch.column(2), bits):
                live = np.flatnonzero(np.isin(digests, few)) if few is not None else np.arange(len(starts))
                if not len(live):
                    continue
                buffer = lower.tobytes()
                every = [buffer[a:b] for a, b in zip(starts[live].tolist(), ends[live].tolist(), strict=True)]
                rows = pd.DataFrame({"own": own[live], "group": of[i + own[live]], "digest": digests[live], "term": every})
                sums = rows.groupby(["own", "group", "digest", "term"], sort=False).size().rename("n").reset_index().groupby(["group", "digest", "term"], sort=False)["n"].agg(["sum", "size"]).reset_index()
                columns = [*groups.names(sums["group"].to_numpy()), pa.array(sums["digest"]), pa.array(sums["sum"], pa.int64()), pa.array(sums["size"], pa.int64()), pa.array(sums["term"].tolist(), pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "digest", "n", "docs", "term"])

    rows = docs.select("lang", "source", "text").mapInArrow(run, f"{COUNTED}, term string")
    return rows if few is not None else rows.join(wanted, "digest", "left_semi").select("lang", "source", "digest", "n", "docs", "term")


def _kept(rows: DataFrame, term: list[str], least_docs: int) -> DataFrame:
    """Rows (lang, source, *term, n) of the terms that at least least_docs documents of the language hold, with lang_n."""
    same = Window.partitionBy("lang", *term)
    sums = rows.groupBy("lang", "source", *term).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sums = sums.withColumn("lang_docs", F.sum("docs").over(same)).withColumn("lang_n", F.sum("n").over(same))
    return sums.where(F.col("lang_docs") >= least_docs).select("lang", "source", *term, "n", "lang_n", (F.row_number().over(same.orderBy("source")) == 1).alias("head"))


def kept_terms(docs: DataFrame, least_docs: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows, dictionary): rows (lang, source, digest, sub, n, lang_n, head) of the terms that each language keeps, head
    once for each lang and term; dictionary (digest, sub, term). sub tells the terms of one digest apart."""
    rows = written(_kept(counted(docs, bits), ["digest"], least_docs), "kept-digests")
    kept = written(rows.where("head").select("digest").distinct(), "digests")
    spelled = strings(docs, bits).join(broadcast_if(kept, BROADCAST_DIGESTS), "digest", "left_semi")
    spelled = written(spelled.groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("most")), "spelled")
    shared = spelled.where("least != most").select("digest")
    plain = spelled.where("least = most").select("digest", F.lit(0).alias("sub"), F.col("least").alias("term"))
    own = rows.withColumn("sub", F.lit(0))
    columns = ["lang", "source", "digest", "sub", "n", "lang_n", "head"]
    if not shared.limit(1).count():
        return own.select(columns), plain
    # different terms under one digest: their sums may hide that some are too rare
    split = written(_kept(counted_by_string(docs, shared, bits), ["digest", "term"], least_docs), "split-terms")
    names = split.select("digest", "term").distinct()
    names = written(names.withColumn("sub", F.row_number().over(Window.partitionBy("digest").orderBy("term"))), "split-names")
    again = split.join(names, ["digest", "term"]).select(columns)
    own = own.join(shared, "digest", "left_anti").select(columns)
    return written(own.union(again), "kept-terms"), plain.union(names.select("digest", "sub", "term"))


def share(count: Column, total: Column, terms: Column, scale: int, add: int) -> Column:
    """1 + floor(scale * (count + add) / (total + add * terms)) in whole numbers; total + add * terms is above 0."""
    wide = lambda x: x.cast("decimal(19,0)")
    upper = (F.lit(scale).cast("decimal(10,0)") * (wide(count) + F.lit(add).cast("decimal(3,0)"))).cast("decimal(36,0)")
    lower = (wide(total) + F.lit(add).cast("decimal(3,0)") * wide(terms)).cast("decimal(36,0)")
    return F.lit(1).cast("long") + F.call_function("div", upper, lower)


def _distances(left: pd.DataFrame, right: pd.DataFrame, sources: int) -> pd.DataFrame:
    """Sums of |p - p'| over the terms at hand for each pair of a source of block a and one of block b."""
    right = right.sort_values("idx")
    index, zero = right["idx"].to_numpy(), right["zero"].to_numpy()
    lang, a, b = right["lang"].iloc[0], int(right["a"].iloc[0]), int(right["b"].iloc[0])
    terms = left[["digest", "sub"]].drop_duplicates() if len(left) else left
    matrix = np.repeat(zero[:, None], len(terms), axis=1)
    if len(left):
        column = pd.MultiIndex.from_frame(terms).get_indexer(pd.MultiIndex.from_frame(left[["digest", "sub"]]))
        matrix[np.searchsorted(index, left["idx"].to_numpy()), column] = left["p"].to_numpy()
    block = index // sources
    rows = []
    other = np.flatnonzero(block == b)
    for i in np.flatnonzero(block == a).tolist():
        to = other[other > i]
        if len(to):
            sums = np.abs(matrix[to] - matrix[i]).sum(axis=1)
            rows.append((np.full(len(to), index[i]), index[to], sums))
            rows.append((index[to], np.full(len(to), index[i]), sums))
    rows = rows or [(index[:0], index[:0], zero[:0])]
    i, j, sums = (np.concatenate(x) for x in zip(*rows, strict=True))
    return pd.DataFrame({"lang": pd.Series([lang] * len(i), dtype=object), "idx": i, "other": j, "sum": sums, "terms": np.full(len(i), len(terms))})


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, scale: int = 1_000_000_000, add: int = 5, bits: int = 64, sources: int = SOURCES, slice_terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source): part `pair` holds each other source of the
    language and how far its term shares are from the group's, part `term` the terms that the group
    uses more than its language does, up to `top`.

    Terms are runs of letters of ASCII, A-Z lower-cased, and of any characters beyond; a language keeps those that
    least_docs of its documents hold. A share is 1 + floor(scale * (count + add) / (total + add * terms)), all in whole
    numbers. Null text, lang and source are empty ones. A group without kept terms, or a language without any
    (then all its pairs are 0), stays in part `pair`; a language of one source has no pairs. Rows that repeat are documents
    of their own; ties go by the bytes of the item. An empty table gives no rows; other columns are passed over. Terms of any
    length count whole. Exact whatever the digests: `bits` narrows them, so that tests make terms collide.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows, dictionary = kept_terms(docs, least_docs, bits)
    langs = rows.where("head").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")])
    groups = groups.withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    none = F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"), scale, add)).otherwise(zero)
    groups = written(groups.withColumn("zero", none), "groups")

    shares = rows.join(broadcast_if(groups, BROADCAST_GROUPS), ["lang", "source"])
    shares = shares.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"), scale, add))
    shares = written(shares.withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), scale, add)), "shares")

    # sources meet in blocks and over slices of the terms; a term that no source of two blocks has counts by their zeros
    sizes = written(groups.groupBy("lang").agg((F.floor(F.max("idx") / sources) + 1).cast("int").alias("blocks"), F.greatest(F.ceil(F.max("terms") / slice_terms), F.lit(1)).cast("int").alias("slices")), "sizes")
    sizes = broadcast_if(sizes, BROADCAST_GROUPS)
    block = F.floor(F.col("idx") / sources).cast("int")

    def distances(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _distances(left, right, sources)

    def seated(df: DataFrame, *columns: str) -> DataFrame:
        met = df.select(*columns, "slice", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        return met.select(*columns, "slice", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"))

    left = seated(shares.join(sizes, "lang").withColumn("slice", F.pmod(F.xxhash64("digest", "sub"), F.col("slices")).cast("int")), "lang", "digest", "sub", "idx", "p")
    right = seated(groups.join(sizes, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))), "lang", "idx", "zero")
    keys = ["lang", "slice", "a", "b"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(distances, "lang string, idx int, other int, sum bigint, terms bigint")
    met = met.groupBy("lang", "idx", "other").agg(F.sum("sum").alias("sum"), F.sum("terms").alias("met"))
    own = groups.select("lang", "idx", "source", "terms", "zero")
    others = groups.select("lang", F.col("idx").alias("other"), F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    pairs = met.join(broadcast_if(own, BROADCAST_GROUPS), ["lang", "idx"]).join(broadcast_if(others, BROADCAST_GROUPS), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("sum") + (F.col("terms") - F.col("met")) * F.abs(F.col("zero") - F.col("other_zero"))).alias("value"))

    of_group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    best = shares.where("value > 0").select("lang", "source", "digest", "sub", "value").withColumn("place", F.rank().over(of_group)).where(F.col("place") <= top)
    terms = best.join(dictionary, ["digest", "sub"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    rank = F.row_number().over(of_group.orderBy(F.col("value").desc(), "item")).cast("int").alias("rank")
    ranked = terms.select("*", rank).where(F.col("rank") <= top)
    return pairs.select("*", rank).union(ranked)
