"""The queries of the text operators; each covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, credentials, katz, language, licenses, media, minhash, negatives, packing, spelling, token_counts, toxicity, vectors
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    best = F.get(F.sort_array(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license")))), F.lit(0))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"), F.round(-best["d"], 6).alias("dice"), F.concat_ws(",", F.array_sort(F.array_distinct("matches.license"))).alias("licenses"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.to_media(table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language, op3_katz, op4_toxicity, op5_licenses, op6_bpe, op7_packing, op8_vectors, op9_minhash, op10_webp, op11_hard_negatives, op12_spelling, op13_secrets)}

#: Of the other text operators no result has an SQL form (see tests/llm for what each is held against).
ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS place
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 10""",
    "op13_secrets": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS (
  SELECT rid, 0 AS pattern, regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m, string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g FROM d
  UNION ALL SELECT rid, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 2, regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM d
  UNION ALL SELECT rid, 3, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(text, '[A-Za-z0-9+/_=-]{20,}') FROM d
  UNION ALL SELECT rid, 5, regexp_extract_all(text, '(?i:user_?name|user|login|account|client_?id|key_?id)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]{3,}'), string_split_regex(text, '(?i:user_?name|user|login|account|client_?id|key_?id)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]{3,}') FROM d
  UNION ALL SELECT rid, 6, regexp_extract_all(text, '(?:(?i:https?|wss?|ftps?|ssh|jdbc:[a-z0-9]+|postgres|postgresql|mysql|rediss?|mongodb|amqps?|s3)://|(?i:endpoint|hostname|host|server)["'']?\x20*[:=]\x20*["'']?)[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{3,}'), string_split_regex(text, '(?:(?i:https?|wss?|ftps?|ssh|jdbc:[a-z0-9]+|postgres|postgresql|mysql|rediss?|mongodb|amqps?|s3)://|(?i:endpoint|hostname|host|server)["'']?\x20*[:=]\x20*["'']?)[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{3,}') FROM d),
u AS (SELECT rid, pattern, unnest(range(len(m))) AS i, unnest(m) AS match, unnest(g[:len(m)]) AS gap FROM f WHERE len(m) > 0),
s AS (
  SELECT rid, pattern, match, length(match) AS size, sum(length(gap) + length(match)) OVER w AS stop, sum(len(regexp_extract_all(gap, '\n[ \t\r]*\n'))) OVER w AS scope
  FROM u WINDOW w AS (PARTITION BY rid, pattern ORDER BY i)),
k AS (
  SELECT rid, scope, (stop - size)::BIGINT AS start, stop::BIGINT AS stop, CASE
    WHEN pattern = 0 THEN CASE WHEN length(regexp_extract(match, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12 THEN 0 WHEN length(regexp_extract(match, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 THEN 4 END
    WHEN pattern = 1 THEN CASE WHEN size >= 18 THEN 1 END
    WHEN pattern = 2 THEN CASE WHEN size >= 16 THEN 2 END
    WHEN pattern = 3 THEN CASE WHEN regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[a-z]') THEN 3 END
    ELSE pattern END AS kind FROM s),
h AS (
  SELECT a.rid, a.kind, a.start, a.stop, bool_or(b.kind = 1) AS strong, bool_or(b.kind = 5) AS weak, bool_or(b.kind IN (0, 3, 4)) AS secret, bool_or(b.kind = 6) AS endpoint
  FROM k a JOIN k b ON a.rid = b.rid AND a.scope = b.scope AND abs(a.start - b.start) <= 500 WHERE a.kind >= 3 AND b.kind IS NOT NULL GROUP BY ALL),
t AS (
  SELECT rid, kind, start, stop FROM k WHERE kind < 3
  UNION ALL SELECT rid, kind, start, stop FROM h WHERE CASE WHEN kind IN (3, 4) THEN strong OR (weak AND endpoint) WHEN kind = 5 THEN secret AND endpoint ELSE (strong OR weak) AND secret END),
x AS (SELECT rid, kind, start, (['assign', 'access', 'hex', 'key', 'short', 'user', 'endpoint'])[kind + 1] || ':' || start || ':' || stop AS span FROM t),
r AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM x GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (rid)""",
}
