"""Top-k retrieval of chunks by cosine similarity, exact, through an index of cells.

Cells have centres fitted on a bounded sample; every chunk goes to its nearest centre, and a cell knows how far its
farthest chunk is. By the triangle inequality no chunk of a cell is nearer to a query than the centre is, less that
radius. A query first asks the nearest cells that hold k chunks; only cells that can hold a nearer one than
its k-th are asked after that, so most queries are done with few cells where vectors bunch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

#: Queries, and chunks, that a task scores against each other.
BLOCK, PART = 4096, 16384
#: Queries that are scored at once.
AT_ONCE = 1024
#: Chunks, about, on which centres are fitted (a hash picks them), the most of their bytes, and the most centres.
SAMPLE, SAMPLE_BYTES, MOST_CELLS = 10_000, 32 << 20, 1024
#: Steps of the fit.
STEPS = 5
#: What rounding may add to a distance.
ROOM = 1e-6
#: Fixed value: what a query without a hit is told.
NO_HITS = "未找到相关消息"


def units(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors; one of zeros is as far from all as those at right angles."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * x @ y.T))


class Cells:
    """Centres (unit vectors; the last cell is for vectors of zeros), with the radius and the number of chunks of each cell."""

    def __init__(self, sample: np.ndarray, n: int):
        x = units(sample)
        x = np.unique(x[np.abs(x).sum(axis=1) > 0], axis=0)
        pick = np.random.default_rng(7).permutation(len(x))[:n]
        self.centres = x[pick] if len(pick) else np.zeros((0, sample.shape[1]))
        for _ in range(STEPS):
            if not len(self.centres):
                break
            own = np.concatenate([(x[i : i + AT_ONCE] @ self.centres.T).argmax(axis=1) for i in range(0, len(x), AT_ONCE)])
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, x)
            held = np.linalg.norm(sums, axis=1) > 1e-12
            self.centres[held] = units(sums[held])
        self.radius, self.count = np.zeros(len(self.centres) + 1), np.zeros(len(self.centres) + 1, np.int64)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance from its centre) of each vector."""
        x = units(vectors)
        none = np.abs(x).sum(axis=1) == 0
        if not len(self.centres):
            return np.zeros(len(x), np.int64), np.zeros(len(x))
        d = _apart(x, self.centres)
        cell = d.argmin(axis=1)
        return np.where(none, len(self.centres), cell), np.where(none, 0.0, d[np.arange(len(x)), cell])

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """The least distance that a chunk of each cell can have; infinite for cells without chunks."""
        x = units(vectors)
        d = np.concatenate([_apart(x, self.centres) - self.radius[:-1], np.full((len(x), 1), np.sqrt(2.0))], axis=1)
        d = np.where(np.abs(x).sum(axis=1, keepdims=True) > 0, d, np.sqrt(2.0))
        return np.where(self.count > 0, np.maximum(d, 0.0), np.inf)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Which cells each query asks first: those of the least bounds that hold k chunks together, and one more."""
        order = np.argsort(bounds, axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        asked = np.zeros(bounds.shape, bool)
        wanted = np.zeros(bounds.shape, bool)
        wanted[:, 0] = True
        wanted[:, 1:] = before[:, :-1] < k
        np.put_along_axis(asked, order, wanted, axis=1)
        return asked & np.isfinite(bounds)


def _dense(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def in_single(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with those of y, all sums in single precision in the order of the coordinates, as SQL takes them over lists of
    floats; a vector of zeros is like none (0)."""
    dot, own, other = (np.zeros(len(x), np.float32) for _ in range(3))
    x, y = np.ascontiguousarray(x.T, np.float32), np.ascontiguousarray(y.T, np.float32)
    for a, b in zip(x, y, strict=True):
        dot += a * b
        own += a * a
        other += b * b
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = np.clip(dot / np.sqrt(own * other), np.float32(-1), np.float32(1))
    return np.where(np.isnan(cosine), 0.0, cosine.astype(np.float64))


def retrieve_topk(
    chunks: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.0, block: int = BLOCK, part: int = PART, cells: int | None = None, scored: list | None = None,
    places: int = 12, single: bool = False,
) -> DataFrame:
    """(query_id, rank, chunk_id, similarity): for each of queries (query_id, embedding) the k best
    chunks (chunk_id, embedding) of at least the threshold; ties by chunk_id. Similarities that are equal to so many
    places are a tie; with single they are those of in_single.

    Rows without an id or embedding, with a null in it, or of another length than most queries' are left out; a vector of zeros is like
    none (0). The chunks of a cell are dealt to parts and the queries that ask it to blocks, by a hash and any number of them. cells is the number
    of centres, the root of the number of chunks if not given (MOST_CELLS at most). The driver gets counts, the sample and the
    radius of each cell. To a list `scored` the pairs of query and chunk that were compared are added.
    """
    spark = chunks.sparkSession
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    sized = queries.where(whole & F.col("query_id").isNotNull()).groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    common = sized.orderBy(F.col("rows").desc(), "n").first()
    query_type, chunk_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (chunks, "chunk_id")))
    kinds = f"query_id {query_type}, chunk_id {chunk_type}, similarity double"
    if common is None:
        return spark.createDataFrame([], kinds + ", rank bigint")
    fits = whole & (F.size("embedding") == common["n"])
    vector = F.col("embedding").cast("array<double>").alias("vector")
    held = chunks.where(fits & F.col("chunk_id").isNotNull()).select("chunk_id", vector)
    asked = queries.where(fits & F.col("query_id").isNotNull()).select("query_id", vector)
    index = _index(held, common["n"], cells)
    if index is None:
        return spark.createDataFrame([], kinds + ", rank bigint")
    placed, stats = index
    shared = spark.sparkContext.broadcast(stats)
    hit = f"query_id {query_type}, vector array<double>, bound double"

    def asking(later: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for i in range(0, batch.num_rows, AT_ONCE):
                    one = batch.slice(i, AT_ONCE)
                    bounds = index.bounds(_dense(one.column(1)))
                    first = index.first(bounds, k)
                    if later:
                        wanted = ~first & (bounds <= one.column(2).to_numpy()[:, None] + ROOM)
                    else:
                        wanted = first
                    row, cell = np.nonzero(wanted)
                    yield pa.RecordBatch.from_arrays([*[one.column(c).take(pa.array(row)) for c in (0, 1)], pa.array(cell.astype(np.int32))], ["query_id", "vector", "cell"])

        return run

    order = Window.partitionBy("query_id").orderBy(F.round("similarity", places).desc(), "chunk_id")
    # a chunk that ties with the k-th, or that single precision puts before it, may be so much less like the query
    slack = 10.0**-places + (single and (common["n"] + 4) * 2.0**-22)
    best = lambda found: found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    ask = f"query_id {query_type}, vector array<double>, cell int"
    farthest = float(np.sqrt(max(0.0, 2 - 2 * max(threshold - slack, -1.0))))
    met = stored(_scored(asked.withColumn("bound", F.lit(0.0)).mapInArrow(asking(False), ask), placed, k, threshold, block, part, kinds, scored, places, single, slack))
    near = stored(best(met))
    last = near.where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(2 - 2 * (F.col("similarity") - slack), F.lit(0.0))).alias("bound"))
    open_ = asked.join(last, "query_id", "left").select("query_id", "vector", F.least(F.coalesce("bound", F.lit(2.0)), F.lit(farthest)).alias("bound"))
    more = _scored(open_.mapInArrow(asking(True), ask), placed, k, threshold, block, part, kinds, scored, places, single, slack)
    return best(near.drop("rank").union(more))


def _index(held: DataFrame, dim: int, cells: int | None) -> tuple[DataFrame, Cells] | None:
    """Chunks with their cell, as a stored table, and what is known of the cells; None without chunks."""
    spark, total = held.sparkSession, held.count()
    if not total:
        return None
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, dim))))
    drawn = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, most / total) * (1 << 20)) + 1)
    sample = held.where(drawn).select("vector").limit(2 * most).toArrow()
    stats = Cells(_dense(sample.column(0)) if sample.num_rows else np.zeros((1, dim)), min(MOST_CELLS, cells or int(total**0.5) + 1))
    shared = spark.sparkContext.broadcast(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                one = batch.slice(i, AT_ONCE)
                cell, far = shared.value.assign(_dense(one.column(1)))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["chunk_id", "vector", "cell", "far"])

    placed = stored(held.mapInArrow(run, f"chunk_id {held.schema['chunk_id'].dataType.simpleString()}, vector array<double>, cell int, far double"))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect():  # MOST_CELLS + 1 rows at most
        stats.count[r["cell"]], stats.radius[r["cell"]] = r["n"], r["radius"]
    return placed, stats


def _scored(asked: DataFrame, placed: DataFrame, k: int, threshold: float, block: int, part: int, kinds: str, scored: list | None, places: int, single: bool, slack: float) -> DataFrame:
    """The k best chunks of each cell for each query that asks it (query_id, vector, cell)."""
    asked = stored(asked)
    sizes = lambda df, n, c: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(c))
    deals = stored(sizes(asked, block, "blocks").join(sizes(placed, part, "parts"), "cell"))  # a row for each cell
    if scored is not None:
        rows = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("q")).join(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("c")), "cell")
        scored.append(rows.agg(F.coalesce(F.sum(F.col("q") * F.col("c")), F.lit(0))).first()[0])
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = asked.join(F.broadcast(deals), "cell").select("query_id", "vector", "cell", dealt("query_id", "blocks").alias("block"), every("parts").alias("part"))
    held = placed.join(F.broadcast(deals), "cell").select("chunk_id", "vector", "cell", dealt("chunk_id", "parts").alias("part"), every("blocks").alias("block"))

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": q["query_id"][:0], "chunk_id": c["chunk_id"][:0], "similarity": np.zeros(0)})
        if not len(q) or not len(c):
            return none
        c = c.sort_values("chunk_id", kind="stable")
        u, v = (np.stack([np.asarray(e, np.float64) for e in rows["vector"]]) for rows in (q, c))
        x, y = units(u), units(v)
        names, chunk, out = q["query_id"].to_numpy(), c["chunk_id"].to_numpy(), []
        for at in range(0, len(names), AT_ONCE):
            s = x[at : at + AT_ONCE] @ y.T
            last = np.partition(s, -k, axis=1)[:, -k] if k < s.shape[1] else np.full(len(s), -np.inf)
            r, i = np.nonzero(s >= np.maximum(last, threshold)[:, None] - 2 * slack)
            got = in_single(u[at + r], v[i]) if single else s[r, i]
            held = got >= threshold
            r, i, got = r[held], i[held], got[held]
            order = np.lexsort((i, -np.round(got, places), r))
            r, i, got = r[order], i[order], got[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            out.append(pd.DataFrame({"query_id": names[at + r], "chunk_id": chunk[i], "similarity": got})[rank < k])
        return pd.concat(out)

    key = ["cell", "block", "part"]
    return asking.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(score, kinds)


def format_hits(hits: DataFrame, texts: DataFrame, queries: DataFrame | None = None, none: str = NO_HITS) -> DataFrame:
    """Numbered text of the hits of each query: `i. content（来源: source）`, blank lines between, without a source where there is none. Of
    queries (query_id), if given, those without a hit are told so; hits without a text are left out."""
    source = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit("（来源: "), F.col("source"), F.lit("）"))).otherwise("")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce("content", F.lit("")), source)
    listed = hits.join(texts, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    listed = listed.select("query_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n\n").alias("text"))
    if queries is None:
        return listed
    return queries.select("query_id").distinct().join(listed, "query_id", "left").select("query_id", F.coalesce("text", F.lit(none)).alias("text"))
