"""Similarity join on word n-grams by Jaccard similarity, exact.

1. A text becomes the sorted set of its shingle hashes; equal sets fall together under a
   digest. Sets are hashed anew in each of three passes, which takes less than storing them.
2. Blocks. Two sets of at least the wanted similarity differ in at most d shingles, d
   following from their sizes. Shingles are dealt by hash over d + m + 1 parts, so m + 1
   parts at least are equal in both. Each set sets aside its m parts with the longest lists,
   and sets that share the digest of one of the others meet: a passage or line that
   many documents share draws none together.
   Sizes go by bands of ratio t, and a set takes part in its own band and the next one up.
   Sets that meet, directly or through others, are a block, unless they are too many.
3. In a block too large for one task the least set is held against all others first, a few times over; those
   that link are joined and don't meet one another again.
4. In a block: T-occurrence search. Short inverted lists are counted, long ones set aside by
   DivideSkip and probed by binary search (counted where many sets ask), and sets that reach the
   overlap that the sizes ask for are linked. A large block is cut by size into chunks
   of bounded bytes, and pairs of chunks are searched.
5. Components of the links; members of a set share its fate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import fits, written
from .components import components

#: Shingles in a chunk of a block: 8 MB of hashes.
CHUNK = 1 << 20
#: What a set counts besides its shingles.
SET_COST = 64
#: A component of up to so many shingles is one block.
MOST_IN_COMPONENT = 32 * CHUNK
#: Before the sets of a larger one meet in chunks, so many times the least set that is joined to none is held against all others
#: like it, and those that link are joined to it.
ROUNDS = 3
#: A chunk's number holds the round in which its sets were joined (0 if they are not) above so many bits.
GROUP_BITS = 40
#: A binary search takes as long as counting so many postings.
PROBE = 32
#: Sets whose digests are kept in a task to leave out repeats; then it starts anew.
KEPT_SETS = 500_000
#: Parts that HOT texts or more of one in SAMPLED hold are counted without gathering them; MOST_HOT of them are broadcast
#: (16 bytes each), which leaves the others at most a share of 1 / MOST_HOT each.
SAMPLED, HOT, MOST_HOT = 256, 64, 100_000
#: Sets that take part in blocks are broadcast up to this many (about 40 bytes each).
BROADCAST_SETS = 400_000


def least_size(size: int, percent: int) -> int:
    """The least size of a set that can reach the similarity with one of this size."""
    return -(-size * percent // 100)


def least_overlap(a: int, b: int, percent: int) -> int:
    """100 * overlap >= percent * union, solved for the overlap."""
    return -(-percent * (a + b) // (100 + percent))


def bands(percent: int, most: int) -> list[int]:
    """Lower ends of the size bands. The upper end of a band is the largest size that its
    lower end can link with, so a pair that can link is in one band or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return out


def most_differences(upper: int, percent: int) -> int:
    """The most shingles in which two sets of up to `upper` of the wanted similarity differ."""
    return 2 * upper * (100 - percent) // (100 + percent)


def set_aside(differ: int) -> int:
    """How many parts of a set are set aside, where two sets may differ in `differ` shingles."""
    return max(1, differ // 3)


def part_digests(hashes: np.ndarray, percent: int, ends: list[int]) -> list[tuple[int, np.ndarray, int]]:
    """(0 or 1, digests, m) of the parts of a set, for its own band and for the next one.

    Two sets that differ in at most d shingles are equal in m + 1 of d + m + 1 parts at
    least. If each sets aside the m parts of lowest rank, in a ranking by what is in a part,
    then the highest-ranked equal part stays in both: m equal parts rank below it. Empty parts rank
    lowest; what is left of m is for the other parts. Only a set with more than m empty
    parts gives digests of those. Bands in which only equal sets can link need none."""
    band = int(np.searchsorted(ends, len(hashes), "right")) - 1
    spread = tv.scramble(hashes ^ np.uint64(0x5BF03635))
    out = []
    for j in (band, band + 1):
        differ = most_differences(ends[j + 1] - 1, percent)
        if not differ:
            continue
        m = set_aside(differ)
        parts = differ + m + 1
        tag = np.uint64((j + 1) * 0x1000193)
        part = (tv.scramble(hashes + np.uint64(j + 1)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        used, at = np.unique(part[order], return_index=True)
        sums = np.add.reduceat(spread[order], at)
        found = tv.scramble(sums + (used + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tag)
        n_empty = parts - len(used)
        if n_empty > m:
            empty = np.setdiff1d(np.arange(parts), used)
            found = np.concatenate([found, tv.scramble(tv.scramble((empty + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) + tag)])
        out.append((j - band, found, max(0, m - n_empty)))
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray], list[bytes | None]]]:
    """(ids, sets, digests of the sets) of batches of (doc_id, text), by slices; an empty set has no digest."""
    for batch in batches:
        for i, j, data, offsets in tv.texts(batch.column(1)):
            starts, stops, first = tv.words(data, offsets)
            sets = tv.shingles(tv.segment_hashes(tv.LOWER[data], starts, stops), first, k)
            keys = [np.array([x.sum(), tv.scramble(x ^ np.uint64(0xA5A51234)).sum()], np.uint64).tobytes() if len(x) else None for x in sets]
            yield batch.column(0).slice(i, j - i), sets, keys


def _fresh(slices, kept: int = KEPT_SETS) -> Iterator[list[tuple[bytes, np.ndarray]]]:
    """The sets that a task hasn't seen before, by slices: a third of all rows may be copies."""
    seen: set[bytes] = set()
    for _, sets, keys in slices:
        out = []
        for x, key in zip(sets, keys, strict=True):
            if key is not None and key not in seen:
                if len(seen) >= kept:
                    seen.clear()
                seen.add(key)
                out.append((key, x))
        if out:
            yield out


def sizes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, set_id) of every row."""

    def run(batches):
        for ids, sets, keys in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n", "set_id"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, set_id binary")


def digests(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(set_id, n, up, aside, part): the digests of the parts of every set, for its band (up 0) and the
    next (1), and how many of those are to be set aside; a task repeats none."""

    def run(batches):
        ends = bands(percent, 1 << 40)
        for slice_ in _fresh(_sets(batches, k)):
            rows = [(i, *r) for i, (_, x) in enumerate(slice_) for r in part_digests(x, percent, ends)]
            if not rows:
                continue
            lens = np.array([len(r[2]) for r in rows])
            which = pa.array(np.repeat(np.array([r[0] for r in rows]), lens))
            columns = [pa.array([key for key, _ in slice_], pa.binary()).take(which), pa.array([len(x) for _, x in slice_], pa.int32()).take(which)]
            columns += [pa.array(np.repeat(np.array([r[i] for r in rows], np.int32), lens)) for i in (1, 3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([r[2] for r in rows]).view(np.int64))], ["set_id", "n", "up", "aside", "part"])

    return docs.select("doc_id", "text").mapInArrow(run, "set_id binary, n int, up int, aside int, part bigint")


def hot_parts(docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(part): the most frequent parts (MOST_HOT at most) of a hash-drawn SAMPLED-th of the texts, if they are in
    HOT of those at least; None where there are none."""
    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    often = digests(drawn, k, percent).groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT)
    found = written(often.orderBy(F.col("n").desc(), "part").limit(MOST_HOT).select("part"), "hot-parts")
    return found if found.limit(1).count() else None


def over_parts(rows: DataFrame, hot: DataFrame | None, name: str) -> DataFrame:
    """rows (part, set_id, ...) with often, least and most: the number of rows of the part, its least and its
    greatest set. Rows of a part meet in a window; those of hot parts, which one task shouldn't get, are summed where they are."""
    same = Window.partitionBy("part")
    stats = (F.count(F.lit(1)), "often"), (F.min("set_id"), "least"), (F.max("set_id"), "most")
    if hot is None:
        return rows.select("*", *[f.over(same).alias(x) for f, x in stats])
    rows = written(rows, name)
    sums = rows.join(F.broadcast(hot), "part", "left_semi").groupBy("part").agg(*[f.alias(x) for f, x in stats])
    cold = rows.join(F.broadcast(hot), "part", "left_anti").select(*rows.columns, *[f.over(same).alias(x) for f, x in stats])
    return cold.union(rows.join(F.broadcast(sums), "part").select(*rows.columns, "often", "least", "most"))


def meetings(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(leader, set_id, n): sets with the least set that shares one of their parts, after each set
    has set aside its most frequent parts. Parts that are in one set only don't travel on."""
    hot = hot_parts(docs, k, percent)
    shared = over_parts(digests(docs, k, percent), hot, "digests").where(F.col("least") != F.col("most"))
    own = shared.select("set_id", "n", "up", "aside", "part", "often").repartition("set_id", "up").groupBy("set_id", "up", "part", "n", "aside", "often").agg(F.lit(1).alias("one"))
    rank = F.row_number().over(Window.partitionBy("set_id", "up").orderBy(F.col("often").desc(), "part"))
    kept = own.withColumn("rank", rank).where(F.col("rank") > F.col("aside")).select("set_id", "n", "part")
    met = over_parts(kept, hot, "kept").where(F.col("least") != F.col("most"))
    return written(met.select(F.col("least").alias("leader"), "set_id", "n").distinct(), "met")


def contents(docs: DataFrame, k: int) -> DataFrame:
    """(set_id, hashes) of every set; a task repeats none."""

    def run(batches):
        for slice_ in _fresh(_sets(batches, k)):
            yield pa.RecordBatch.from_arrays([pa.array([key for key, _ in slice_], pa.binary()), pa.array([x.tobytes() for _, x in slice_], pa.binary())], ["set_id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "set_id binary, hashes binary")


def _postings(postings: np.ndarray, begin: np.ndarray, stop: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """The lists, one after the other."""
    lengths = stop[lists] - begin[lists]
    ends = np.cumsum(lengths)
    return postings[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[lists] - ends + lengths, lengths)]


def search(sets: list[np.ndarray], percent: int, split: int | None = None, mu: float = 0.01, spanning: bool = True, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """T-occurrence search among sets in ascending order of size; links as pairs of places.

    Each set asks for sets at or after its place that share T of its shingles, T being
    what the least of those needs. Its longest lists (L of them, by the DivideSkip rule) are
    set aside; how often a set occurs in the others is counted, leaving out those that are joined to it already, and sets
    that occur T - L times are sought in the long lists: by binary search where they are few, else by counting those
    lists too. With `split`, only pairs across that place
    count; with `side`, only pairs of different sides. With `spanning`, a pair whose members are joined by links already is left
    out, so components are the same and the links at most one less than the sets; without,
    all links come.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    del order
    begin = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    lengths = np.diff(np.append(begin, len(every)))
    shared = lengths > 1
    keys, postings, lengths = every[begin[shared]], owner[np.repeat(shared, lengths)], lengths[shared]
    del every, owner, begin
    stop = np.cumsum(lengths)
    begin = stop - lengths
    probe = np.repeat(np.arange(len(keys)) * n, lengths) + postings  # sorted: the lists for binary search
    label = np.arange(n)
    links = []
    for q in range(n):
        if split is not None and q >= split:
            break
        size = int(sizes[q])
        end = int(np.searchsorted(sizes, size * 100 // percent, "right"))
        low = q + 1 if split is None else max(q + 1, split)
        if low >= end or (spanning and not np.any(label[low:end] != label[q])):
            continue
        if not len(keys):
            break
        at = np.searchsorted(keys, sets[q])
        at[at == len(keys)] = 0
        lists = at[keys[at] == sets[q]]
        t_low = least_overlap(size, max(size, int(sizes[low])), percent)
        if len(lists) < t_low:
            continue
        lengths = stop[lists] - begin[lists]
        lists = lists[np.argsort(-lengths, kind="stable")]
        longest = max(2, int(lengths.max()))
        aside = min(t_low - 1, int(t_low / (mu * math.log2(longest) + 1)))
        long, short = lists[:aside], lists[aside:]
        need = t_low - aside
        c = _postings(postings, begin, stop, short)
        c = c[(c >= low) & (c < end)]
        if spanning:
            c = c[label[c] != label[q]]
        if side is not None:
            c = c[side[c] != side[q]]
        times = np.bincount(c - low, minlength=end - low)
        c = np.flatnonzero(times >= need)
        times, c = times[c], c + low
        if not len(c):
            continue
        if len(c) * len(long) * PROBE > int((stop[long] - begin[long]).sum()):
            times = times + np.bincount(_postings(postings, begin, stop, long), minlength=n)[c]
        elif len(long):
            asked = (long * n + c[:, None]).ravel()
            found = np.searchsorted(probe, asked)
            found[found == len(probe)] = 0
            times = times + (probe[found] == asked).reshape(len(c), len(long)).sum(1)
        for c in c[times >= least_overlap(size, sizes[c], percent)].tolist():
            if spanning and label[c] == label[q]:
                continue
            links.append((q, c))
            if spanning:
                a, b = label[q], label[c]
                label[label == b] = a
    return links


def set_links(docs: DataFrame, k: int, percent: int, spanning: bool = True) -> DataFrame:
    """(a, b): links between the different sets of docs."""
    met = meetings(docs, k, percent)
    # A block is a component of the sets that meet: each set is in one block. The sets of a
    # larger component are in a block for each leader that they meet.
    whole = written(components(met.select(F.col("leader").alias("a"), F.col("set_id").alias("b"))), "met-components")
    sized = met.select("set_id", "n").distinct().join(whole.withColumnRenamed("node", "set_id"), "set_id")
    whole_size = sized.groupBy("component").agg((F.sum(F.col("n").cast("long") + F.lit(SET_COST)) <= MOST_IN_COMPONENT).alias("one"))
    sized = written(sized.join(whole_size, "component"), "met-sizes")
    led = met.join(sized.where(~F.col("one")).select("set_id"), "set_id", "left_semi").select("leader", "set_id", "n", F.lit(0).cast("long").alias("group"))
    joined = None
    if spanning and led.limit(1).count():
        led, joined = _joined(written(led, "led"), docs, k, percent)
    whole = sized.where("one").select(F.col("component").alias("leader"), "set_id", "n", F.lit(0).cast("long").alias("group"))
    members = written(whole.union(led), "members")
    # Chunks follow the sizes. Only the distinct sizes of a block are ordered in one task: about
    # 8,000 at most in a component, those of two bands in a leader's block. A set's place within
    # its size is drawn from its digest, so a chunk holds CHUNK shingles on average.
    weights = members.groupBy("leader", "group", "n").agg(F.sum(F.col("n").cast("long") + F.lit(SET_COST)).alias("weight"))
    smaller = Window.partitionBy("leader", "group").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    starts = weights.withColumn("start", F.coalesce(F.sum("weight").over(smaller), F.lit(0)))
    place = F.col("start") + F.pmod(F.xxhash64("set_id"), F.col("weight"))
    chunk = F.col("group") * F.lit(1 << GROUP_BITS) + F.floor(place / F.lit(CHUNK)).cast("long")
    cut = members.join(starts, ["leader", "group", "n"]).select("leader", "set_id", "n", "group", chunk.alias("chunk"))
    spans = cut.groupBy("leader", "group", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = spans.select("leader", F.col("group").alias("group_b"), F.col("chunk").alias("chunk_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    close = lambda high, low: F.lit(100) * F.col(high) >= F.lit(percent) * F.col(low)
    # sets that are joined in one round are joined already
    open_ = (F.col("group") != F.col("group_b")) | (F.col("group") == 0)
    near = (F.col("chunk_b") >= F.col("chunk")) & close("high", "low_b") & close("high_b", "low") & open_
    pairs = spans.join(other, "leader").where(near).select("leader", F.col("chunk").alias("a"), F.col("chunk_b").alias("b"))
    sides = pairs.select("leader", "a", "b", F.col("a").alias("chunk")).union(pairs.where("a < b").select("leader", "a", "b", F.col("b").alias("chunk")))
    seats = sides.join(cut.drop("group"), ["leader", "chunk"])
    wanted = written(members.select("set_id").distinct(), "wanted")
    stored = contents(docs, k).join(F.broadcast(wanted) if fits(wanted, BROADCAST_SETS) else wanted, "set_id", "left_semi").dropDuplicates(["set_id"])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = pdf["chunk"].to_numpy() >> GROUP_BITS
        mixed = bool((groups != groups[0]).any())  # chunks of different rounds overlap in their sizes
        pdf = pdf.sort_values(["n", "set_id"] if mixed else ["chunk", "n", "set_id"], kind="stable")
        chunks = pdf["chunk"].to_numpy()
        split = int(np.searchsorted(chunks, chunks[0], "right")) if not mixed and chunks[0] != chunks[-1] else None
        ids = pdf["set_id"].tolist()
        found = search([np.frombuffer(x, np.uint64) for x in pdf["hashes"]], percent, split, spanning=spanning, side=chunks if mixed else None)
        return pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found]})

    blocks = seats.join(stored, "set_id").select("leader", "a", "b", "chunk", "n", "set_id", "hashes")
    links = blocks.groupBy("leader", "a", "b").applyInPandas(block, "a binary, b binary")
    return links if joined is None else links.union(joined)


def _joined(led: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """led (leader, set_id, n, group) with the round (from 1) in which a set was joined to the least one of its block that was
    not yet, and the links (a, b) for that. A set is held against one other a round, in tasks of about four chunks of them."""
    ids = written(led.select("set_id").distinct(), "led-sets")
    held = contents(docs, k).join(F.broadcast(ids) if fits(ids, BROADCAST_SETS) else ids, "set_id", "left_semi").dropDuplicates(["set_id"])
    held, links = written(held, "led-contents"), None

    def against(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(pivots):
            return pd.DataFrame({"leader": [], "set_id": [], "pivot": []})
        pivot = np.frombuffer(pivots["pivot_hashes"].iloc[0], np.uint64)
        good = []
        for x in members["hashes"]:
            x = np.frombuffer(x, np.uint64)
            at = np.searchsorted(pivot, x)
            overlap = int(np.count_nonzero(pivot[np.minimum(at, len(pivot) - 1)] == x))
            good.append(100 * overlap >= percent * (len(x) + len(pivot) - overlap))
        out = members[["leader", "set_id"]][np.array(good, bool)].copy()
        out["pivot"] = [pivots["pivot"].iloc[0]] * len(out)
        return out

    for round_ in range(1, ROUNDS + 1):
        open_ = led.where("group = 0")
        size = F.col("n").cast("long") + F.lit(SET_COST)
        pivots = open_.groupBy("leader").agg(F.min("set_id").alias("set_id"), F.ceil(F.sum(size) / (4 * CHUNK)).cast("int").alias("parts"))
        pivots = written(pivots, "pivots")
        asked = open_.join(pivots.select("leader", "parts"), "leader").select("leader", "set_id", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int").alias("part"))
        asked = asked.join(held, "set_id")
        each = pivots.join(held, "set_id").select("leader", "set_id", "hashes", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).toDF("of", "pivot", "pivot_hashes", "of_part")
        found = asked.groupBy("leader", "part").cogroup(each.groupBy("of", "of_part")).applyInPandas(against, "leader binary, set_id binary, pivot binary")
        found = written(found, "joined")
        new = found.select("set_id", F.col("pivot").alias("a")).where("set_id <> a").select("a", F.col("set_id").alias("b"))
        links = new if links is None else links.union(new)
        done = found.select("leader", "set_id", F.lit(round_).cast("long").alias("now"))
        led = written(led.join(done, ["leader", "set_id"], "left").select("leader", "set_id", "n", F.coalesce("now", "group").alias("group")), "led")
    return led, links


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Words are runs of other than space and \\x09-\\x0D, with A-Z in lower case. Two documents
    link when 100 * overlap >= percent * union of their sets of k-word shingles; a shorter
    text has its whole sequence as one shingle. component_id is the least doc_id that links
    reach. A null or wordless text has an empty set, links with nothing and is its own
    component, equal texts link at any length. Null ids are passed over when the least is
    taken; a component of null ids has a null id. Rows that repeat are kept.
    """
    sets = written(sizes(docs, k), "sets")
    links = components(set_links(docs, k, percent))
    classes = sets.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("least"))
    labelled = classes.join(links.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "least", F.coalesce("component", "set_id").alias("component"))
    labelled = written(labelled, "classes")
    many = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    final = written(labelled.join(many, "component").select("set_id", "component_id"), "components")
    own = sets.select("doc_id", F.col("n").alias("n_shingles"), "set_id")
    empty = own.where(F.col("set_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.join(final, "set_id").select("doc_id", "n_shingles", "component_id").union(empty)
