"""The index of cells against full comparison, what queries are told, and dates of sessions."""

from datetime import datetime

import numpy as np
import pytest

from ferrovia.operators import chat, retrieval


def bunched(rng, n, d=16, bunches=40, width=0.02):
    centres = rng.normal(size=(bunches, d))
    return centres[rng.integers(0, bunches, n)] / 4 + rng.normal(size=(n, d)) * width


@pytest.mark.parametrize("kind", ["bunched", "even", "whole"])
def test_index_equals_full_comparison(spark, kind):
    rng = np.random.default_rng(4)
    x = {"bunched": lambda: bunched(rng, 3000), "even": lambda: rng.normal(size=(900, 6)), "whole": lambda: rng.integers(-1, 2, (700, 3)).astype(float)}[kind]()
    q = np.concatenate([x[:40] + (0 if kind == "whole" else 0.001), rng.normal(size=(10, x.shape[1])), np.zeros((2, x.shape[1]))])
    x[50:55] = 0.0
    chunks = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(-1, None), (None, x[0].tolist()), (-2, [1.0])], "chunk_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(q.tolist())] + [("none", None), ("short", [1.0, 2.0])], "query_id string, embedding array<double>")
    for k, threshold in ((5, 0.0), (3, 0.9), (1, -1.0)):
        scored = []
        got = retrieval.retrieve_topk(chunks, asked, k, threshold, part=100, block=7, scored=scored).collect()
        unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
        s = unit(q) @ unit(x).T
        want = set()
        for i, row in enumerate(np.round(s, 12)):
            best = [c for c in np.lexsort((np.arange(len(row)), -row))[:k] if s[i, c] >= threshold]
            want |= {(f"q{i}", r + 1, int(c)) for r, c in enumerate(best)}
        assert {(r.query_id, r["rank"], r.chunk_id) for r in got} == want and len(got) == len(want)
        assert len(scored) == 2
        if kind == "bunched" and k == 5:
            # queries among the bunches are done with few cells; those of nowhere and of zeros ask more
            near = []
            retrieval.retrieve_topk(chunks, asked.where("try_cast(substr(query_id, 2) AS int) < 40"), k, threshold, scored=near).collect()
            assert sum(near) < 0.2 * 40 * len(x)


def test_ties_are_those_of_the_asked_places(spark):
    """Similarities that agree to six places go by chunk, also where the index would have left the farther one out."""
    turned = [[float(np.cos(a)), float(np.sin(a))] for a in (0.1 + 2e-6, 0.1 + 1e-6, 0.1, 1.0)]
    chunks = spark.createDataFrame(list(enumerate(turned)), "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    near = [c for c, _ in sorted(enumerate(turned), key=lambda x: (-round(x[1][0], 6), x[0]))][:2]
    for cells in (1, 4):
        ask = lambda **more: [r.chunk_id for r in retrieval.retrieve_topk(chunks, asked, 2, cells=cells, **more).orderBy("rank").collect()]  # noqa: E731, B023
        assert ask() == [2, 1] and ask(places=6) == near == [0, 1]


def test_single_precision_is_that_of_sql(spark):
    """On lists of floats SQL sums in single precision: what it ranks by six places is ranked so here."""
    duckdb = pytest.importorskip("duckdb")
    x = np.random.default_rng(3).normal(size=(400, 64)).astype(np.float32)
    x[200:] = x[:200] * np.float32(1.7)  # as near as their doubles, but for rounding
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    got = {tuple(r) for r in retrieval.retrieve_topk(table, table.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), places=6, single=True).select("query_id", "chunk_id", "rank").collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE t (id BIGINT, e FLOAT[])")
    db.executemany("INSERT INTO t VALUES (?, ?)", rows)
    sql = """SELECT q, c, CAST(rank AS BIGINT) FROM (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY round(s, 6) DESC, c) AS rank
    FROM (SELECT a.id AS q, b.id AS c, list_cosine_similarity(a.e, b.e) AS s FROM t a, t b WHERE a.id % 20 = 0) WHERE s >= 0) WHERE rank <= 5"""
    assert got == set(db.execute(sql).fetchall())


def test_index_of_nothing(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, embedding array<double>")
    asked = chunks.withColumnRenamed("chunk_id", "query_id")
    assert retrieval.retrieve_topk(chunks.limit(0), asked).count() == 0 and retrieval.retrieve_topk(chunks, asked.limit(0)).count() == 0
    assert [tuple(r) for r in retrieval.retrieve_topk(chunks, asked).select("query_id", "rank", "chunk_id").collect()] == [(1, 1, 1)]
    zeros = spark.createDataFrame([(7, [0.0, 0.0]), (8, [0.0, 0.0])], chunks.schema)
    assert [r.chunk_id for r in retrieval.retrieve_topk(zeros, asked).orderBy("rank").collect()] == [7, 8]


def test_what_queries_are_told(spark):
    hits = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("a", 3, 12), ("c", 1, 13)], "query_id string, rank long, chunk_id long")
    texts = spark.createDataFrame([(10, "一", "x.txt"), (11, "二", None), (12, "三", "")], "chunk_id long, content string, source string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "query_id string")
    told = {r.query_id: r.text for r in retrieval.format_hits(hits, texts, asked).collect()}
    assert told == {"a": "1. 一（来源: x.txt）\n\n2. 二\n\n3. 三", "b": "未找到相关消息", "c": "未找到相关消息"}
    assert {r.query_id for r in retrieval.format_hits(hits, texts).collect()} == {"a"}


TIMES = [
    "2025-01-01T23:30:00+08:00", "2025-01-01T23:30:00Z", "2025-01-01 00:05", "2025-01-01T07", "2025-01-01", "20250101T2330", "20250101", "2025-01-01T23:30:00.123456-05:30", "2024-02-29T00:00:00",
    "2025-02-29T00:00:00", "2025-13-01", "2025-01", "23:30", "2025-1-1", "2025-01-01T24:01", "2025-01-01T10:60", "2025-01-01T", "0000-01-01", "x2025-01-01", "2025-01-01T10:00:00+25:00", "", "none", "2025-01-01T10:00:00,5",
]


def test_dates_are_those_of_the_text(spark):
    rows = [(f"t{i}", t, "p") for i, t in enumerate(TIMES)] + [("null", None, "p")]
    got = {r.thread_id: (r.date, r.time) for r in chat.sessions_by_date(spark.createDataFrame(rows, "thread_id string, created_at string, preview string")).collect()}
    for i, t in enumerate(TIMES):
        try:
            at = datetime.fromisoformat(t.replace("Z", "+00:00"))
            want = (at.strftime("%Y-%m-%d"), at.strftime("%H:%M"))
        except ValueError:
            want = ("未知日期", "")
        assert got[f"t{i}"] == want, t
    assert got["null"] == ("未知日期", "")
