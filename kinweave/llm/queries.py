"""The operators over whole tables: one query each, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import fingerprint, langid, mixing, neardup, packing, quality, secret_scan, sharding, tokens, topk

Query = Callable[[SparkSession, str], DataFrame]
SHARD_BYTES = 8 << 20
PACK_WORDS = 2048
TOP_K = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.learn(docs.where(~held_out()), "text", "lang")
    found = langid.identify(docs, samples)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, TOP_K)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, similarity=Fraction(85, 100))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade(docs, quality.learn(docs, quality.grades_of(table(spark, sf_dir, "labels"))))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.Mix(table(spark, sf_dir, "documents")).shares()
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACK_WORDS)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = [op1_language_id, op2_fingerprints, op3_exact_top_k, op4_token_counts, op5_secret_scan, op6_near_duplicates, op7_quality, op8_sharding, op9_mixing, op10_packing, pipeline]
    return {f.__name__: f for f in own}


TOP_K_SQL = f"""
WITH good AS (
  SELECT vec_id, row_number() OVER () AS number, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP_K}
"""

MIXING_SQL = r"""
WITH keyed AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(concat_ws(':', coalesce(md5(CAST(doc_id AS VARCHAR)), ''), coalesce(md5(lang), ''), coalesce(md5(CAST(n_chars AS VARCHAR)), ''), coalesce(md5(source), ''), coalesce(md5(text), ''))) AS key
  FROM documents
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY key) - 1 AS number FROM keyed
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM sums
), running AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(cap) OVER w, 0) AS BIGINT) AS capped,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS free
  FROM weighted WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT capped, free FROM running WHERE cap * free >= weight * (total - capped) ORDER BY cap / weight, capped LIMIT 1
), goals AS (
  SELECT r.source, r.source_size, least(CAST(r.cap AS DOUBLE), CAST(r.weight * (r.total - l.capped) AS DOUBLE) / CAST(l.free AS DOUBLE)) AS target
  FROM running r CROSS JOIN level l
), rated AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / CAST(g.source_size AS DOUBLE) ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('17:' || d.key || ':' || d.number), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""


#: All pairs that share a shingle, compared on their whole sets, and what they reach.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM worded
), entries AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), near AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b USING (shingle)
  WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (
  SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id, least(s.doc_id, coalesce(c.low, s.doc_id)) = s.doc_id AS kept
FROM sets s LEFT JOIN component c ON c.a = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": TOP_K_SQL, "op6_near_duplicates": NEAR_DUPLICATES_SQL, "op9_mixing": MIXING_SQL}
