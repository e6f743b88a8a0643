"""Connected components of a table of links: each task contracts its own links, then large-star and
small-star steps alternate until every node is tied to one that is tied to none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MOST_ROUNDS = 60
#: Links that a task contracts at once.
AT_ONCE = 500_000
#: A node of more links than this, and than one in MOST_HOT of all, is joined by broadcast.
HOT, MOST_HOT = 20_000, 100_000


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the least node that links (a, b) lead to."""
    least = np.arange(n)
    while True:
        before = least.copy()
        m = np.minimum(least[a], least[b])
        np.minimum.at(least, a, m)
        np.minimum.at(least, b, m)
        least = least[least]
        if np.array_equal(least, before):
            return least


def _contracted(edges: DataFrame) -> DataFrame:
    """(a, b): every node of a task's links (at most AT_ONCE at a time) with the least that it reaches by them."""

    def settled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (pa.chunked_array([x.column(i) for x in held]).combine_chunks() for i in (0, 1))
        names = pc.unique(pa.chunked_array([a, b]))
        names = names.take(pc.sort_indices(names))
        codes = [pc.index_in(x, names).to_numpy() for x in (a, b)]
        least = forest(*codes, len(names))
        node = np.flatnonzero(least != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(node)), names.take(pa.array(least[node]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= AT_ONCE:
                yield settled(held)
                held, n = [], 0
        if held:
            yield settled(held)

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def _both(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(ways).alias("way")).select("way.a", "way.b")


def _star(edges: DataFrame, large: bool, hot: int | None) -> DataFrame:
    """One step over (a, b): large-star ties the larger neighbours of a node to the least of
    its closed neighbourhood, small-star the smaller ones and the node itself. A link gives one link at most, so they don't grow.
    Nodes of more than `hot` links, if any, meet their least by broadcast, so no task gets all links of one."""
    near = _both(edges) if large else edges  # b < a in all links
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    asking = near.where(F.col("b") > F.col("a")) if large else near
    if hot is None:
        met = asking.join(least.select("a", "m"), "a")
    else:
        few = F.broadcast(least.where(F.col("n") > hot).select("a", "m"))
        cold = asking.join(few.select("a"), "a", "left_anti").join(least.where(F.col("n") <= hot).select("a", "m"), "a")
        met = cold.select("a", "b", "m").union(asking.join(few, "a").select("a", "b", "m"))
    if large:
        out = met.select("b", "m")
    else:  # the least one's own link ties the node, the others' tie them
        out = met.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("b"), "m")
    return out.toDF("a", "b").where(F.col("a") != F.col("b"))


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """(nodes that are tied to several others, or to one that is tied itself; the most links of a node): repeats of a link count
    as links."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.lit(None).cast(edges.schema["b"].dataType).alias("to")))
    seen = edges.select(F.explode(ends).alias("end")).select("end.node", "end.to")
    counts = seen.groupBy("node").agg(F.min("to").alias("least"), F.max("to").alias("most"), F.count("to").alias("up"), F.count(F.lit(1)).alias("n"))
    open_ = (F.col("up") > 0) & ((F.col("least") != F.col("most")) | (F.col("n") > F.col("up")))
    n, most = counts.agg(F.count(F.when(open_, 1)), F.max("n")).first()
    return n, most or 0


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, component): the least node that can be reached. Only nodes with
    a link to another node appear; null ends are passed over. Every round is a written table, contracted by the tasks that
    read it: the fewer its bytes, the fewer these are and the more each of them sees. What the driver reads of a round is two numbers."""
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for _ in range(MOST_ROUNDS):
        edges = written(_contracted(written(edges, "links")), "contracted")
        n, most = _unsettled(edges)
        if not n:
            break
        hot = max(HOT, edges.count() // MOST_HOT)
        hot = hot if most > hot else None
        edges = _star(_star(edges, True, hot), False, hot)
    else:
        raise RuntimeError(f"components not settled in {MOST_ROUNDS} rounds")
    edges = edges.distinct()
    least = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(least)
