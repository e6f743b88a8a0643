"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, gru, iblt, jaccard, langid, licenses, mixing, mjpeg, negatives, neighbours, packing, sharding, warc
from .common import documents, held_out


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times copies) of every document."""
    mixed = mixing.with_copies(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("record.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT source, source_size, 2e0 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight,
    1.5e0 * CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS rk,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
      / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
f AS (SELECT min(rk) AS rk FROM l WHERE level * weight <= cap),
t AS (
  SELECT l.source, l.source_size,
    CASE WHEN f.rk IS NULL OR l.rk < f.rk THEN l.cap ELSE g.level * l.weight END AS target
  FROM l CROSS JOIN f LEFT JOIN l g ON g.rk = f.rk),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate,
    CAST(concat('0x', substr(md5(concat('mix:', coalesce(CAST(d.doc_id AS VARCHAR), concat('text:', md5(coalesce(d.text, '')))))), 1, 8)) AS BIGINT) / 4294967296e0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, at 3 words and 0.9."""
    return jaccard.near_duplicates(documents(spark, sf_dir), k=3, percent=90)


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to one of 40 shards, and its place there, as read back."""
    placed = sharding.shuffled_shards(documents(spark, sf_dir), shards=40)
    text = F.col("record.text")
    return placed.select(
        F.col("record.doc_id").alias("doc_id"), sharding.record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", "grown_shard",
    )


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    back = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_revisit_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h),
g AS (
  SELECT p.*, o.owner, {", ".join(f"CAST(concat('0x', substr(p.h, {5 * i + 1}, 5)) AS BIGINT) AS g{i}" for i in range(8))}
  FROM p JOIN o ON p.h = o.h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  concat({", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(g{i} // {32**j} % 32 + 1 AS INT), 1)" for i in range(8) for j in (3, 2, 1, 0))}) AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM g
"""


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 tokens."""
    import public_tokenizers

    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; those whose remainder modulo 5 is not 0 teach."""
    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 5)
    model = langid.learn(docs.where(~out).select("doc_id", "text", "lang"))
    found = langid.label(docs.select("doc_id", "text"), model).select("record.doc_id", "language.*")
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op7_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model log-likelihoods of every document."""
    return gru.score_documents(documents(spark, sf_dir), parts=10)


def op8_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an AVI file, read back, and its shots."""
    return mjpeg.features(mjpeg.to_media(documents(spark, sf_dir)))


def op9_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    return iblt.compare_versions(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return licenses.scan(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each apart."""
    return divergence.audit(documents(spark, sf_dir), least_docs=30, top=50)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (
  SELECT o.lang, o.source, coalesce(s.n, 0) AS n, coalesce(l.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) o
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s ON s.lang = o.lang AND s.source = o.source
  LEFT JOIN l ON l.lang = o.lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (g.n + 5 * g.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (k.n + 5) // (l.n + 5 * l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM f QUALIFY part = 'pair' OR rank <= 50
"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    return neighbours.near_vectors(embeddings(spark, sf_dir), cosine=0.95)


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT a AS vec_id, b AS seen FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT vec_id, min(seen) AS least FROM r GROUP BY vec_id) c ON c.vec_id = e.vec_id
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; every seventh row's label is moved on first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings(spark, sf_dir).select("vec_id", label.alias("label"), "embedding")
    mined = negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, top=5, low=80, high=100, scale=256)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_source_mixing, op2_warc_round_trip, op3_ngram_jaccard, op4_external_shuffle, op5_cost_balanced_packing,
        op6_language_id, op7_gated_recurrent_lm, op8_motion_jpeg, op9_iblt_fingerprint, op10_license_scan,
        op11_source_divergence, op12_embedding_dedup, op13_hard_negatives,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": OP1_SQL, "op2_warc_round_trip": OP2_SQL, "op11_source_divergence": OP11_SQL, "op12_embedding_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
