"""The source audit, near duplicates among vectors and hard negatives, against plain versions of the whole result."""

import re
from collections import Counter

import numpy as np
import pytest

from ferrovia.llm import divergence, negatives, neighbours

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(docs, least_docs, top, scale=1_000_000_000, add=5):
    """The audit by plain loops; docs are (text, lang, source)."""
    docs = [tuple(x or "" for x in d) for d in docs]
    terms = [Counter(x.translate(LOWER) for x in TERM.findall(t)) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        of = [i for i, d in enumerate(docs) if d[1] == lang]
        held = Counter(x for i in of for x in terms[i])
        kept = {x for x, n in held.items() if n >= least_docs}
        groups = {docs[i][2]: Counter() for i in of}
        for i in of:
            for x, n in terms[i].items():
                if x in kept:
                    groups[docs[i][2]][x] += n
        whole = sum(groups.values(), Counter())

        def shares(counts, kept=kept):
            total = sum(counts.values())
            return {x: 1 + scale * (counts[x] + add) // (total + add * len(kept)) for x in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s, counts in groups.items():
            pairs = sorted(((-sum(abs(p[s][x] - p[o][x]) for x in kept), o.encode(), o) for o in groups if o != s))
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pairs, 1)]
            own = sorted((q[x] - p[s][x], x.encode(), x) for x in kept if counts[x] and p[s][x] > q[x])[:top]
            out += [(lang, s, "term", x, -v, r) for r, (v, _, x) in enumerate(own, 1)]
    return sorted(out)


def documents(n=260, seed=4):
    rng = np.random.default_rng(seed)
    words = ["rail", "Rail", "étoile", "ÉTOILE", "station", "x", "y" * 300, "z" * 300 + "a", "日本", "don't", "a1b", "_", "K", "train"] + [f"w{chr(97 + i)}" for i in range(20)]
    out = []
    for i in range(n):
        lang = ["en", "en", "en", "fr", None][int(rng.integers(5))]
        source = ["s0", "s0", "s1", "S2", None, f"own{i % 3}"][int(rng.integers(6))]
        k = int(rng.integers(0, 40))
        text = None if i % 29 == 0 else " ".join(rng.choice(words[: 14 + 4 * (len(source or "") % 3)], k))
        out.append((text, lang, source))
    out += [("only here", "xx", "alone"), ("", "xx", "other"), ("rail", "xx", None)] + [out[5]] * 9
    return out


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash") for d in docs], "text string, lang string, source string, digest string")


@pytest.mark.parametrize("bits", [64, 3])
def test_audit_by_loops(spark, bits):
    docs = documents()
    got = divergence.audit(frame(spark, docs), least_docs=9, top=6, bits=bits)
    assert [f.dataType.simpleString() for f in got.schema] == ["string"] * 4 + ["bigint", "int"]
    assert sorted(tuple(r) for r in got.collect()) == audited(docs, 9, 6)


def test_audit_in_blocks_and_slices(spark):
    docs = documents(seed=8)
    got = divergence.audit(frame(spark, docs), least_docs=4, top=3, sources=2, slice_terms=5)
    assert sorted(tuple(r) for r in got.collect()) == audited(docs, 4, 3)


def test_audit_of_nothing(spark):
    none = frame(spark, []).limit(0)
    assert divergence.audit(none).count() == 0
    lone = divergence.audit(frame(spark, [("a b", "en", "s"), (None, None, None), ("c", "en", "t")]), least_docs=30).collect()
    assert sorted(tuple(r) for r in lone) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_counts_beyond_a_long_product(spark):
    row = spark.range(1).select(
        divergence.share(neighbours.F.lit(5 * 10**17), neighbours.F.lit(10**18), neighbours.F.lit(1000), 10**9, 5).alias("p")
    )
    assert row.first().p == 1 + 10**9 * (5 * 10**17 + 5) // (10**18 + 5000)


def test_terms_that_share_a_digest_are_told_apart():
    data = np.frombuffer(b"abcabdabc" + b"q" * 40 + b"q" * 39 + b"r", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 49, 0]), np.array([3, 6, 9, 49, 89, 2])
    assert divergence.equal_segments(data, starts, ends, np.array([0, 0, 0, 3, 3, 0])).tolist() == [True, False, True, True, False, False]


def linked(vectors, cosine):
    """(n_links, component) by a full matrix; vectors are (id, list or None)."""
    rows = [np.array([np.nan if x is None else x for x in v], float) if v is not None else None for _, v in vectors]
    good = [v is not None and len(v) > 0 and np.isfinite(v).all() and v.any() for v in rows]
    n, near = len(rows), {}
    for i in range(n):
        near[i] = [j for j in range(n) if j != i and good[i] and good[j] and len(rows[i]) == len(rows[j]) and rows[i] @ rows[j] / np.sqrt((rows[i] @ rows[i]) * (rows[j] @ rows[j])) >= cosine]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [vectors[j][0] for j in seen if vectors[j][0] is not None]
        out.append((vectors[i][0], len(near[i]), min(ids) if ids else None))
    return out


def clustered(seed=1, d=24):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=d) for _ in range(150)]
    for c in range(12):  # near copies about the cosine, some far beyond, chains of them
        centre = rng.normal(size=d)
        rows += [centre + rng.normal(size=d) * 0.06 * (1 + c) / 3 for _ in range(20)]
    rows += [rows[3].copy() for _ in range(30)] + [rows[160] * 4.0, rows[160] * 0.25]
    vectors = [(int(i), np.asarray(v, np.float32).tolist()) for i, v in zip(rng.permutation(len(rows)) * 3, rows, strict=True)]
    vectors += [(10_000, None), (10_001, [0.0] * d), (10_002, [float("nan")] * d), (10_003, [float("inf")] + [1.0] * (d - 1)), (10_004, []), (10_005, [None] + [1.0] * (d - 1))]
    vectors += [(10_006, [1.0, 2.0]), (10_007, [2.0, 4.0]), (10_008, [-1.0, -2.0]), (None, [1.0, 2.0]), (10_006, [1.0, 2.0]), (None, [5.0, 1.0, 0.0]), (None, [5.0, 1.0, 0.0])]
    return vectors


@pytest.mark.parametrize("tile_bytes,leaves", [(1 << 22, 16), (20 * 200, 64)])
def test_near_vectors_by_full_matrix(spark, tile_bytes, leaves):
    vectors = clustered()
    df = spark.createDataFrame([(i, v, "clash") for i, v in vectors], "vec_id bigint, embedding array<float>, key string")
    got = neighbours.near_vectors(df, 0.95, tile_bytes=tile_bytes, leaves=leaves).collect()
    order = lambda x: tuple((y is None, y) for y in x)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=order) == sorted(linked(vectors, 0.95), key=order)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_near_vectors_of_doubles_at_the_edge(spark):
    # a cosine of 0.6 exactly, sizes whose squares a double can't hold
    vectors = [(1, [5e200, 0.0]), (2, [3e-200, 4e-200]), (3, [0.0, 1e-300])]
    df = spark.createDataFrame(vectors, "vec_id int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(df, 0.6).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 1)}
    assert neighbours.near_vectors(df.limit(0), 0.6).count() == 0
    assert [r.n_links for r in neighbours.near_vectors(df.select("vec_id", neighbours.F.lit(None).cast("array<double>").alias("embedding"))).collect()] == [0, 0, 0]


def test_far_tiles_do_not_meet(spark):
    # two bunches far apart: boxes keep their tiles from meeting, and what the steps look at shrinks
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(32)[i % 2] * 10 + rng.normal(size=32) * 0.2).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").withColumnRenamed("embedding", "vector")
    classes = df.select(neighbours.vector_key(neighbours.F.col("vector")).alias("key"), neighbours.F.lit(1).cast("bigint").alias("n"), "vector")
    sample = np.array([v for _, v in rows])
    tiles = neighbours._tiles(classes, neighbours.Axes(sample, 2), 100 * 264)
    met = neighbours._meetings(tiles, 0.95).count()
    n = tiles.count()
    assert n >= 6 and met <= n * (n + 1) // 2 - (n // 2) ** 2 + n


def mined(rows, positives=5, top=5, low=80):
    """Negatives by loops; rows are (id, label, vector)."""
    good = [(i, l, [int(np.floor(256.0 * np.float64(x))) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, label, x in good:
        if a % 10:
            continue
        other = [(-sum(p * q for p, q in zip(x, y, strict=True)), i, l) for i, l, y in good if i != a and len(y) == len(x)]
        for ps, p, _ in sorted(o for o in other if o[2] == label)[:positives]:
            best = sorted(o for o in other if o[2] != label and low * -ps <= 100 * -o[0] <= 100 * -ps)[:top]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("values,dim", [("normal", 12), ("whole", 3), ("huge", 4)])
def test_negatives_by_loops(spark, values, dim, monkeypatch):
    rng = np.random.default_rng(11)
    draw = {"normal": lambda: rng.normal(size=dim), "whole": lambda: rng.integers(-1, 3, size=dim) / 16.0, "huge": lambda: np.ldexp(rng.normal(size=dim), 21)}[values]
    rows = [(int(i), int(rng.integers(3)), draw().tolist()) for i in rng.permutation(240)]
    rows += [(500, 1, rows[3][2])] * 8 + [(501, None, rows[3][2]), (502, 1, None), (503, 1, [float("nan")] * dim), (None, 1, rows[3][2]), (504, 1, [None] * dim)]
    rows += [(510, 2, [1.0, 2.0]), (511, 2, [1.0, 1.5]), (512, 0, [1.0, 1.25]), (520, 7, [1.0, 1.0])]
    rows = [r for k, r in enumerate(rows) if r[0] is None or r[0] % 10 or r not in rows[:k]]  # an anchor that repeats comes below
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, label int, embedding array<double>, tile string").repartition(5)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 700)
    got = negatives.mine(df, negatives.F.col("vec_id") % 10 == 0)
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == mined(rows)


def test_negatives_of_repeated_anchors_and_nothing(spark):
    rows = [(10, 1, [1.0]), (10, 1, [1.0]), (11, 1, [0.5]), (12, 2, [0.45]), (13, 2, [0.55])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    got = negatives.mine(df, negatives.F.col("vec_id") % 10 == 0).collect()
    assert [tuple(r) for r in got] == [(10, 11, 1, 1, 12, 32768, 29440)] * 2
    assert negatives.mine(df.limit(0), negatives.F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(df, negatives.F.col("vec_id") % 10 == 0, low=90, high=80)


def test_products_are_exact():
    a = negatives.whole(np.array([[2.0**60, 3.0], [-(2.0**62), 1.0]]), 256)
    assert negatives.products(a, a).tolist() == [[2**63 - 1, -(2**63)], [-(2**63), 2**63 - 1]]
    b = negatives.whole(np.array([[2.0**25, 1 / 256.0]]), 256)
    assert negatives.products(b, b).tolist() == [[2**66 + 1 if 2**66 + 1 < 2**63 else 2**63 - 1]]
    c = negatives.whole(np.array([[2.0**20, 1 / 256.0]]), 256)
    assert negatives.products(c, c).tolist() == [[2**56 + 1]]
