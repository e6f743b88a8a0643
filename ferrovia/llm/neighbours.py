"""Near duplicates among vectors by cosine, exact, in PCA-ordered tiles.

Equal vectors are one class. Vectors are turned to the axes of a sample's second moments, ordered by what they
carry; that changes no cosine. A tree of splits on the leading coordinates deals them to leaves, leaves are
cut into tiles of bounded bytes. Two tiles meet if their boxes of leading coordinates and norms of the
remainder leave room for the cosine. Where two meet, the products of the leading coordinates come first;
what the others can add is at most the product of the remainders' norms, and a pair is left as soon as that cannot reach the
cosine. Each row gets its number of links, and a task passes on a spanning forest of them, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, written
from .components import components, forest

#: Bytes of a tile's vectors in double precision, and the most leaves of the tree.
TILE_BYTES, LEAVES = 4 << 20, 1024
#: Vectors, about, of which the axes and splits are made (a hash picks them), and the most of their bytes.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Vectors of more coordinates than this keep their axes and only have them ordered.
MOST_TURNED = 1024
#: Leading coordinates that boxes and splits go by, and those that each step adds.
LEAD, STEP = 16, 16
#: Rows of a tile that are multiplied at once, and pairs that are looked at singly at once.
SQUARE, PAIRS = 1024, 1 << 16
#: A pair of tiles is described in about 40 bytes; so many are broadcast.
BROADCAST_PAIRS = 500_000
#: A vector that more rows than this, and than one in MOST_HOT of all, repeat meets its rows by broadcast.
HOT, MOST_HOT = 200, 100_000


def usable(vector: Column) -> Column:
    """Whether a vector is there, all its components are finite numbers, and one of them is not 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_key(vector: Column) -> Column:
    """16 bytes that tell vectors apart."""
    parts = F.xxhash64(vector), F.xxhash64(F.lit(20_260_103), vector)
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in parts]))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows over their norms, in double precision; scaled by a power of two first, so no square is lost."""
    x = np.asarray(vectors, np.float64)
    if x.shape[1] == 0:
        return x
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Axes:
    """The axes of the vectors of one length and the tree over their leading coordinates; vectors of other lengths keep their axes."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim = sample.shape[1]
        unit = units(sample)
        if self.dim <= MOST_TURNED:
            values, axes = np.linalg.eigh(unit.T @ unit)
            self.turn = np.ascontiguousarray(axes[:, np.argsort(-values, kind="stable")])
        else:
            self.turn = np.argsort(-(unit * unit).sum(axis=0), kind="stable")
        self.tree: list[tuple[int, float, int, int]] = []  # axis, value, the node below it, the node above; a leaf is ~number
        self.leaves = 0
        self.root = self._split(self.turned(unit)[:, :LEAD], leaves)

    def _split(self, rows: np.ndarray, leaves: int) -> int:
        axis = int(np.argmax(rows.std(axis=0))) if len(rows) else 0
        value = float(np.median(rows[:, axis])) if len(rows) else 0.0
        below = rows[:, axis] < value
        if leaves < 2 or not below.any():
            self.leaves += 1
            return ~(self.leaves - 1)
        at = len(self.tree)
        self.tree.append((axis, value, 0, 0))
        self.tree[at] = axis, value, self._split(rows[below], leaves // 2), self._split(rows[~below], leaves - leaves // 2)
        return at

    def turned(self, unit: np.ndarray) -> np.ndarray:
        if unit.shape[1] != self.dim:
            return unit
        return unit @ self.turn if self.turn.ndim == 2 else unit[:, self.turn]

    def leaf(self, turned: np.ndarray) -> np.ndarray:
        """The leaf of each row; ~length for another length."""
        if turned.shape[1] != self.dim:
            return np.full(len(turned), ~turned.shape[1])
        out, todo = np.empty(len(turned), np.int64), [(self.root, np.arange(len(turned)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                axis, value, low, high = self.tree[node]
                below = turned[rows, axis] < value
                todo += [(low, rows[below]), (high, rows[~below])]
        return out


def rests(turned: np.ndarray, at: int) -> np.ndarray:
    """The norm of each row's coordinates from `at` on."""
    return np.sqrt(np.einsum("ij,ij->i", turned[:, at:], turned[:, at:]))


def matrix(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors of an Arrow list column by length of the vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        out[d] = rows, flat.reshape(-1, d) if len(rows) == len(sizes) and d else flat[np.repeat(sizes == d, sizes)].reshape(len(rows), d)
    return out


class Tile:
    """Vectors of a tile, turned, with what each step of the comparison needs."""

    def __init__(self, row: pd.Series, axes: Axes):
        n, d = int(row["rows"]), int(row["dim"])
        self.keys = np.frombuffer(row["keys"], "V16")
        self.weight = np.frombuffer(row["weights"], np.int64)
        self.unit = units(np.frombuffer(row["vectors"], np.dtype(row["kind"])).reshape(n, d))
        turned = axes.turned(self.unit)
        self.ends = [*range(STEP, d, STEP), d]
        self.rest = [rests(turned, e).astype(np.float32) for e in self.ends]
        self.turned = turned.astype(np.float32)
        self.first = np.concatenate([self.turned[:, : self.ends[0]], self.rest[0][:, None]], axis=1)


def links(a: Tile, b: Tile, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of the pairs of at least the cosine, by blocks; within one tile each pair once.

    Bounds go by single precision with room for its error; whatever is near the cosine is told by double precision."""
    d = a.unit.shape[1]
    room = np.float32((d + 16) * 2.0**-22)
    least = np.float32(cosine) - room
    for i in range(0, len(a.keys), SQUARE):
        for j in range(i if a is b else 0, len(b.keys), SQUARE):
            # leading products and the remainders' norms in one product: what the cosine can be at most
            bound = a.first[i : i + SQUARE] @ b.first[j : j + SQUARE].T
            hits = np.flatnonzero(bound.ravel() >= least)
            if a is b and i == j:
                hits = hits[hits // bound.shape[1] < hits % bound.shape[1]]
            if not len(hits):
                continue
            if len(hits) * 16 > bound.size:
                exact = a.turned[i : i + SQUARE] @ b.turned[j : j + SQUARE].T
                hits = hits[exact.ravel()[hits] >= least]
                found = [(hits, exact.ravel()[hits])]
            else:
                found = [_finished(a, b, i, j, bound, hits[k : k + PAIRS], least) for k in range(0, len(hits), PAIRS)]
            for hits, value in found:
                for k in range(0, len(hits), PAIRS):
                    at, near = hits[k : k + PAIRS], value[k : k + PAIRS] < np.float32(cosine) + room
                    x, y = i + at // bound.shape[1], j + at % bound.shape[1]
                    good = ~near
                    good[near] = np.einsum("ij,ij->i", a.unit[x[near]], b.unit[y[near]]) >= cosine
                    if good.any():
                        yield x[good], y[good]


def _finished(a: Tile, b: Tile, i: int, j: int, bound: np.ndarray, hits: np.ndarray, least: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """The pairs among hits whose products, a step of coordinates at a time, still can reach `least`, and their cosines."""
    x, y = i + hits // bound.shape[1], j + hits % bound.shape[1]
    total = bound.ravel()[hits] - a.rest[0][x] * b.rest[0][y]
    for s in range(1, len(a.ends)):
        span = slice(a.ends[s - 1], a.ends[s])
        total = total + np.einsum("ij,ij->i", a.turned[x, span], b.turned[y, span])
        live = total + a.rest[s][x] * b.rest[s][y] >= least
        x, y, hits, total = x[live], y[live], hits[live], total[live]
    return hits, total


def compare(tiles: list[Tile], cosine: float) -> pd.DataFrame:
    """(node, links, root) of the rows that have links between two tiles or within one: how many rows each is
    linked with, and the first place it is joined with."""
    a, b = tiles[0], tiles[-1]
    shift = 0 if a is b else len(a.keys)
    keys, weight = (np.concatenate([getattr(t, k) for t in tiles]) for k in ("keys", "weight"))
    counts, label = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for x, y in links(a, b, cosine):
        y = y + shift
        np.add.at(counts, x, weight[y])
        np.add.at(counts, y, weight[x])
        open_ = label[x] != label[y]
        if open_.any():
            ends = np.unique(label[x[open_]] * len(keys) + label[y[open_]])
            label = forest(ends // len(keys), ends % len(keys), len(keys))[label]
    rows = np.flatnonzero(counts)
    as_bytes = lambda at: [keys[i].tobytes() for i in at]
    return pd.DataFrame({"a": as_bytes(rows), "links": counts[rows], "b": as_bytes(label[rows])})


def _tiles(classes: DataFrame, axes: Axes, tile_bytes: int) -> DataFrame:
    """(tile, leaf, rows, dim, kind, keys, weights, vectors, low, high): the classes, packed."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(axes)
    kind = "float32" if classes.schema["vector"].dataType.elementType.simpleString() == "float" else "float64"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, dim = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for d, (rows, vectors) in matrix(batch.column(2)).items():
                leaf[rows], dim[rows] = shared.value.leaf(shared.value.turned(units(vectors))), d
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(dim), *batch.columns], ["leaf", "dim", "key", "n", "vector"])

    stored = written(classes.select("key", "n", "vector").mapInArrow(placed, f"leaf bigint, dim bigint, key binary, n bigint, vector {classes.schema['vector'].dataType.simpleString()}"), "placed")
    per_tile = F.greatest(F.floor(F.lit(tile_bytes) / (F.col("dim") * 8 + 8)), F.lit(1))
    cuts = stored.groupBy("leaf", "dim").agg(F.count(F.lit(1)).alias("all")).select("leaf", F.ceil(F.col("all") / per_tile).cast("int").alias("cuts"))
    tile = F.col("leaf") * F.lit(1 << 31) + F.pmod(F.xxhash64("key"), F.col("cuts"))
    seated = stored.join(broadcast_if(written(cuts, "cuts"), LEAVES * 16), "leaf").select(tile.alias("tile"), "leaf", "key", "n", "vector")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(pdf["vector"].to_list()).astype(kind)
        turned = shared.value.turned(units(vectors))
        order = np.argsort(turned[:, 0], kind="stable") if turned.shape[1] else np.arange(len(turned))  # by the first axis
        box = np.concatenate([turned[:, :LEAD], rests(turned, LEAD)[:, None]], axis=1)
        return pd.DataFrame({
            "tile": pdf["tile"].iloc[:1], "leaf": pdf["leaf"].iloc[:1], "rows": [len(pdf)], "dim": [vectors.shape[1]], "kind": [kind],
            "keys": [b"".join(pdf["key"].iloc[order])], "weights": [pdf["n"].to_numpy(np.int64)[order].tobytes()],
            "vectors": [vectors[order].tobytes()], "low": [box.min(axis=0).tolist()], "high": [box.max(axis=0).tolist()],
        })

    schema = "tile bigint, leaf bigint, rows int, dim int, kind string, keys binary, weights binary, vectors binary, low array<double>, high array<double>"
    return written(seated.groupBy("tile").applyInPandas(packed, schema), "tiles")


def _gap(a: str, b: str) -> Column:
    """The least squared distance of two boxes."""
    low, high = (F.zip_with(F.col(f"{x}.low"), F.col(f"{y}.high"), lambda p, q: F.greatest(p - q, F.lit(0.0))) for x, y in ((a, b), (b, a)))
    return F.aggregate(F.zip_with(low, high, lambda p, q: F.greatest(p, q)), F.lit(0.0), lambda s, x: s + x * x)


def _meetings(tiles: DataFrame, cosine: float) -> DataFrame:
    """(a, b): tiles with a <= b whose boxes are near enough. Leaves are compared first (LEAVES and one for each other length)."""
    spark = tiles.sparkSession
    # unit vectors of this cosine are at most sqrt(2 - 2 * cosine) apart; some room for rounding
    reach = 2 - 2 * cosine + 1e-9
    box = [F.array(*[f(F.get(F.col(k), F.lit(i))) for i in range(LEAD + 1)]).alias(k) for k, f in (("low", F.min), ("high", F.max))]
    leaves = tiles.where("leaf >= 0").groupBy("leaf").agg(*box).toPandas()
    leaf, low, high = leaves["leaf"].to_numpy(), *(np.array([list(x) for x in leaves[k]], float).reshape(len(leaves), LEAD + 1) for k in ("low", "high"))
    low, high = np.nan_to_num(low), np.nan_to_num(high)  # of fewer coordinates than LEAD
    pairs = []
    for i in range(len(leaf)):
        gap = np.maximum(np.maximum(low[i] - high[i:], low[i:] - high[i]), 0)
        pairs += [(int(leaf[i]), int(leaf[i + j])) for j in np.flatnonzero((gap * gap).sum(axis=1) <= reach)]
    near = spark.createDataFrame(pa.table({"leaf_a": pa.array([x for x, _ in pairs], pa.int64()), "leaf_b": pa.array([y for _, y in pairs], pa.int64())}))
    near = near.union(tiles.where("leaf < 0").select(F.col("leaf").alias("leaf_a"), F.col("leaf").alias("leaf_b")).distinct())
    box = written(tiles.select("leaf", F.struct("tile", "low", "high").alias("box")), "boxes")
    a = box.select(F.col("leaf").alias("leaf_a"), F.col("box").alias("x"))
    b = box.select(F.col("leaf").alias("leaf_b"), F.col("box").alias("y"))
    met = near.join(a, "leaf_a").join(b, "leaf_b").where((F.col("leaf_a") != F.col("leaf_b")) | (F.col("x.tile") <= F.col("y.tile")))
    return written(met.where(_gap("x", "y") <= reach).select(F.col("x.tile").alias("a"), F.col("y.tile").alias("b")), "tile-pairs")


def _links(classes: DataFrame, cosine: float, tile_bytes: int, leaves: int) -> DataFrame:
    """(a, links, b): the classes that have links, by pair of tiles."""
    spark = classes.sparkSession
    schema = "a binary, links bigint, b binary"
    lengths = classes.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * lengths.dim)))
    drawn = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1 << 20)) < F.lit(int(min(1.0, most / lengths.n) * (1 << 20)) + 1)
    sample = classes.where((F.size("vector") == lengths.dim) & drawn).select("vector").limit(2 * most).toArrow()
    wanted = max(1, min(leaves, -(-lengths.n * (8 * lengths.dim + 8) // tile_bytes)))
    rows = [x for d, (_, x) in matrix(sample.column(0)).items()] if sample.num_rows else [np.ones((1, lengths.dim))]
    axes = Axes(rows[0], wanted)
    tiles = _tiles(classes, axes, tile_bytes)
    shared = spark.sparkContext.broadcast(axes)
    met = broadcast_if(_meetings(tiles, cosine), BROADCAST_PAIRS)
    sides = met.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("tile"))
    held = tiles.select("tile", "rows", "dim", "kind", "keys", "weights", "vectors").join(sides, "tile")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        return compare([Tile(row, shared.value) for _, row in pdf.iterrows()], cosine)

    return written(held.groupBy("a", "b").applyInPandas(task, schema), "found")


def near_vectors(rows: DataFrame, cosine: float = 0.95, tile_bytes: int = TILE_BYTES, leaves: int = LEAVES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows (vec_id, embedding).

    Vectors of one length link at a cosine of at least `cosine` (above 0). Vectors that are null, zero or hold a null, NaN or
    infinite component link with nothing, and so do vectors of different lengths. Rows that repeat, in vec_id or
    vector, are vectors of their own, linked with one another. component_id is the least vec_id that links reach; null ids are passed over and a
    component of null ids has a null id. kept is whether vec_id is that id (false for a null one). An empty table gives no rows; other columns are passed over.
    """
    of = rows.schema["embedding"].dataType.elementType.simpleString()
    vector = F.col("embedding") if of in ("float", "double") else F.col("embedding").cast("array<double>")
    own = rows.select("vec_id", F.when(usable(vector), vector).alias("vector")).withColumn("key", F.when(F.col("vector").isNotNull(), vector_key(F.col("vector"))))
    classes = own.where(F.col("key").isNotNull()).groupBy("key", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, "vector-classes")
    found = _links(classes, cosine, tile_bytes, leaves)
    counts = found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b")).withColumnRenamed("node", "key")
    zero = F.lit(0).cast("long")
    linked = classes.select("key", "least", "n").join(counts, "key", "left").join(joined, "key", "left").where("n > 1 or component is not null")
    linked = linked.select("key", "least", "n", (F.col("n") - 1 + F.coalesce("links", zero)).alias("n_links"), F.coalesce("component", "key").alias("component"))
    linked = written(linked, "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    told = written(linked.join(least, "component").select("key", "n", "n_links", "component_id"), "told")
    hot = F.col("n") > max(HOT, (classes.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    few, many = F.broadcast(told.where(hot).drop("n")), told.where(~hot).drop("n")
    keyed = own.select("vec_id", "key")
    out = keyed.join(few, "key").select("vec_id", "n_links", "component_id").union(
        keyed.join(few.select("key"), "key", "left_anti").join(many, "key", "left").select(
            "vec_id", F.coalesce("n_links", zero).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
        )
    )
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
