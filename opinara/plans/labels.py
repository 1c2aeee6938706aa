"""Queries on label caches and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from .registry import query
from .standins import table


@query("SELECT doc_id, sha256(source || chr(31) || lang || chr(31) || text) AS fingerprint FROM documents")
def fingerprint_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.fingerprint(F.col("source"), F.col("lang"), F.col("text")).alias("fingerprint"))


@query("""
WITH d AS (SELECT doc_id, n_chars % 21 / 10 - 1 AS rule FROM documents),
a AS (SELECT doc_id AS key, 0.5 AS score, doc_id % 4 <> 0 AS relevant FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT doc_id AS key, CAST(quality AS DOUBLE) AS score, toxic = 0 AS relevant FROM labels)
SELECT doc_id, CASE WHEN b.key IS NOT NULL THEN CASE WHEN b.relevant THEN b.score END WHEN a.key IS NOT NULL THEN CASE WHEN a.relevant THEN a.score END ELSE round(rule, 4) END AS sentiment,
  CASE WHEN b.key IS NOT NULL THEN 'layer1' WHEN a.key IS NOT NULL THEN 'layer0' ELSE 'rule' END AS backend FROM d LEFT JOIN a ON doc_id = a.key LEFT JOIN b ON doc_id = b.key
""")
def label_precedence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), F.lit(0.5).alias("score"), (F.col("doc_id") % 4 != 0).alias("relevant"))
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("double").alias("score"), (F.col("toxic") == 0).alias("relevant"))
    comments = docs.select("doc_id", F.round(F.col("n_chars") % 21 / 10 - 1, 4).alias("rule_score"))
    return L.resolve(comments, [(old, "doc_id"), (new, "doc_id")]).select("doc_id", "sentiment", "backend")


@query("""
WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS quality FROM documents WHERE doc_id % 3 > 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'unknown' WHEN a.doc_id IS NULL THEN 'dropped' WHEN a.quality IS DISTINCT FROM b.quality THEN 'changed' ELSE 'ok' END AS status
FROM a FULL JOIN b ON a.doc_id = b.doc_id
""")
def label_audit(spark, sf_dir):
    source = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id", F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("quality"))
    return L.audit(table(spark, sf_dir, "labels"), source, "doc_id", ["quality"])


@query("WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem WHERE l_orderkey % 7 > 0 OR l_linenumber <> 2 GROUP BY 1) SELECT l_orderkey, CAST(n AS BIGINT) AS n FROM g WHERE a <> 1 OR b <> n OR d <> n")
def index_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey % 7 > 0 OR l_linenumber <> 2").select("l_orderkey", (F.col("l_linenumber") - 1).alias("item"))
    return L.gaps(rows, "l_orderkey", "item")


@query("""
SELECT DISTINCT lang, source FROM (SELECT lang, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 INTERSECT SELECT lang, source FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
""")
def polarity_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.where("toxic = 1").select("lang", "source").intersect(rows.where("quality = 0").select("lang", "source"))


@query("""
WITH r AS (SELECT CASE WHEN toxic = 1 AND quality = 0 THEN 'rejected' WHEN quality = 0 THEN 'held' ELSE 'accepted' END AS status FROM labels)
SELECT CAST(count(*) AS BIGINT) AS considered, CAST(count(*) FILTER (WHERE status = 'rejected') AS BIGINT) AS rejected, round(count(*) FILTER (WHERE status = 'rejected') / count(*), 6) AS rate,
  count(*) FILTER (WHERE status = 'rejected') / count(*) <= 0.02 AS accepted FROM r
""")
def reject_ceiling(spark, sf_dir):
    status = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "rejected").when(F.col("quality") == 0, "held").otherwise("accepted")
    return L.reject_rate(table(spark, sf_dir, "labels").select(status.alias("status")))


@query("""
WITH v AS (SELECT p_brand AS key, p_size % 5 AS score, count(*) AS n, max((p_partkey % 2 = 0)::INT) AS p, min(p_partkey) AS first FROM part GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, p DESC, first) AS k, sum(n) OVER (PARTITION BY key) AS t, count(*) OVER (PARTITION BY key) AS c FROM v)
SELECT key, score, CAST(t AS BIGINT) AS n_votes, c > 1 AS conflict FROM k WHERE k = 1
""")
def majority_vote(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), (F.col("p_size") % 5).alias("score"), "p_partkey")
    return L.majority(rows, "key", "score", "p_partkey", F.col("p_partkey") % 2 == 0)


METRICS_SQL = "x AS (SELECT quality = 1 AS g, n_chars > 600 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND NOT p) AS tn, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM x)"


@query("WITH " + METRICS_SQL + " SELECT CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c")
def binary_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return L.binary_metrics(rows, F.col("quality") == 1, F.col("n_chars") > 600)


@query("""
WITH x AS (SELECT lang AS g, CASE WHEN text LIKE '% the %' THEN 'en' WHEN text LIKE '% der %' THEN 'de' WHEN text LIKE '% les %' THEN 'fr' ELSE 'es' END AS p FROM documents),
u AS (SELECT g AS label, 1 AS g, 0 AS p, g = p AS hit FROM x UNION ALL SELECT p, 0, 1, false FROM x),
c AS (SELECT label, sum(g) AS support, sum(p) AS predicted, sum(CASE WHEN hit AND g = 1 THEN 1 ELSE 0 END) AS tp FROM u GROUP BY 1)
SELECT label, CAST(support AS BIGINT) AS support, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 4) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 4) AS recall,
  round(2 * tp / (predicted + support), 4) AS f1 FROM c
""")
def multiclass_metrics(spark, sf_dir):
    guess = F.when(F.col("text").contains(" the "), "en").when(F.col("text").contains(" der "), "de").when(F.col("text").contains(" les "), "fr").otherwise("es")
    return L.class_metrics(table(spark, sf_dir, "documents").select("lang", guess.alias("guess")), "lang", "guess")


@query("""
SELECT event_id, CASE WHEN s > 0.2 THEN 'positive' WHEN s < -0.2 THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT event_id, greatest(-1.0, least(1.0, 2 * value / 500 - 1)) AS s FROM events)
""")
def score_labels(spark, sf_dir):
    from .standins import activity

    return activity(spark, sf_dir).select("event_id", L.label_of(F.col("sentiment")).alias("label"))


@query("""
WITH a AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS k FROM benchmark), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM labels)
SELECT item_id, doc_id FROM a JOIN b USING (k)
""")
def positional_join(spark, sf_dir):
    from ..operators.store import positional_join as join

    return join(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("item_id", "doc_id")
