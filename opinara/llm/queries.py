"""The registered queries of the numbered operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, decontam, embed_dedup, html_main, lang_id, licenses, lsh_forest, negatives, pieces, quality, suffix_dedup, token_counts, url_filters
from .common import remove_path, shared_path, table

QUERIES: dict = {}
ORACLES: dict = {}

#: Fixed values of the query: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


ORACLES["op1_url_filters"] = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), a AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS authority FROM u
), p AS (
  SELECT page_id, translate(authority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(authority) + 1), '^[^?#]*') AS path FROM a
), r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), j AS (
  SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict FROM j WHERE k = 1
"""


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of this call's own holds half of the texts before all documents meet it: known and missing digests come mixed, and each distinct text is encoded once.
    docs, cache = table(spark, sf_dir, "documents"), shared_path(spark, "token-counts")
    known = docs.where(F.pmod(F.xxhash64("text"), F.lit(2)) == 0)
    token_counts.count_tokens(spark, known, piece_model(), cache)
    counted = token_counts.count_tokens(spark, docs, piece_model(), cache)
    remove_path(spark, cache)  # the counts have been read back from checkpoints
    return counted


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)).alias("held_out")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held)
    model = lang_id.learn(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return lang_id.identify(docs.select("doc_id", "text", "held_out"), model, keep=("held_out",))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.grade(docs, model)


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(piece_model()))


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


@query
def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.link_documents(table(spark, sf_dir, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), piece_model())


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLES["op12_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _license_sql() -> str:
    """Every block of every text against every template, and every word as the start of each phrase."""
    known = licenses.templates_table(licenses.TEMPLATES, licenses.THRESHOLD)
    templates = ", ".join(f"('{t['label']}', {t['width']}, {t['need']}, {_list(t['words'])})" for t in known)
    at = [f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(p.split(), 1))})" for p, _ in licenses.PHRASES]
    named = ", ".join(f"CASE WHEN len(p[{k}]) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.PHRASES, 1))
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t(label, width, need, own) AS (VALUES {templates}), b AS (
  SELECT r, width, unnest(range(0, greatest(0, len(w) - width - 1) + 1, width)) AS s, w FROM d, (SELECT DISTINCT width FROM t)
), m AS (
  SELECT r, label, len(list_filter(own, lambda x: list_contains(w[s + 1 : s + 2 * b.width], x))) AS n, need, len(own) AS size FROM b JOIN t ON b.width = t.width
), f AS (
  SELECT r, list(DISTINCT label) AS names, max(n / size) AS share FROM m WHERE n >= need GROUP BY r
), p AS (
  SELECT r, doc_id, len(w) AS n_words, [{', '.join(at)}] AS p FROM d
), q AS (
  SELECT *, flatten(p) AS places, list_sort(list_filter(list_distinct([{named}]), lambda x: x IS NOT NULL)) AS base FROM p
)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(base, ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(names, [])))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM q LEFT JOIN f USING (r)
"""


ORACLES["op11_license_scan"] = _license_sql()
