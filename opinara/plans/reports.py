"""Queries on reports as they are published, imported labels, evaluation and products of posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as EV, identity as ID, importing as IM, publish as P, shelf as SH
from . import cases
from .registry import ORACLES, QUERIES, query
from .scores import reports
from .standins import OPINIONS_SQL, table


def _published(spark, sf_dir):
    """Reports of parts as products: several parts of one brand and name share an id."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("brand"), F.substring_index("p_name", " ", 2).alias("product_name"), "p_size")
    rows = reports(spark, sf_dir).join(part, "product")
    texts = lambda c: F.array(F.concat(F.lit(c), "product_name"), F.lit("see https://a.b/c"), F.lit(" "))
    return P.to_products(
        rows.select("*", F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("price"), F.lit("冰品").alias("category"), F.lit(2).alias("n_posts"), F.col("n_votes").alias("n_comments"), F.lit(None).cast("long").alias("n_eligible_comments"), F.col("n_votes").alias("n_unique_commenters"),
                    texts("good ").alias("rep_positive"), texts("bad ").alias("rep_negative"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("e"), F.col("product"))).alias("review_excerpt"), (F.col("p_size") % 5 == 0).alias("review_provisional"),
                    F.array(F.concat(F.lit("u"), F.col("p_size"))).alias("post_urls"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).cast("timestamp").alias("latest_post_date"))
    )


PUBLISHED_SQL = OPINIONS_SQL + """, pp AS (
  SELECT p_brand || '::' || array_to_string(string_split(p_name, ' ')[1:2], ' ') AS id, r.*, p_size, CASE WHEN p_size % 3 > 0 THEN p_size END AS price FROM r JOIN part ON product = p_partkey
), g AS (
  SELECT id, count(*) AS n, sum(2) AS n_posts, sum(n_votes) AS n_comments, sum(sw) AS w, sum(sws) AS ws, sum(sww) AS ww, sum(sw * (score_std * score_std + score_mean * score_mean)) AS sec,
    sum(positive_weight) AS a, sum(neutral_weight) AS b, sum(negative_weight) AS c, max(p_size) AS top, arg_max(price, p_size) FILTER (price IS NOT NULL) AS price, bool_or(p_size % 5 = 0) AS prov, len(list_distinct(list(p_size))) AS n_urls
  FROM pp GROUP BY 1
), h AS (
  SELECT *, 100 * (0.5 + ws) / (1 + w) AS fair, ws / w AS mu, sqrt(greatest(0, sec / w - (ws / w) * (ws / w))) AS sd, w * w / ww AS ne FROM g
), k AS (
  SELECT *, CASE WHEN ne < 3 THEN '資料不足' WHEN sd >= 0.26 THEN '評價兩極' WHEN mu >= 0.68 AND sd <= 0.25 THEN '一致好評' WHEN mu <= 0.45 AND sd <= 0.25 THEN '一致負評' ELSE '褒貶不一' END AS consensus, CASE WHEN ne < 3 THEN '低' WHEN ne < 8 THEN '中' ELSE '高' END AS confidence FROM h
)
"""


@query("WITH " + PUBLISHED_SQL + """
SELECT id, CAST(n_posts AS BIGINT) AS n_posts, CAST(n_comments AS BIGINT) AS n_comments, CAST(round_even(fair, 0) AS BIGINT) AS fair_score, CAST(round_even((least(greatest(fair, 20), 80) - 20) * 100 / 60, 0) AS BIGINT) AS recommendation_score, consensus, confidence,
  CASE WHEN consensus = '資料不足' OR confidence = '低' THEN '不足' WHEN confidence = '高' THEN '充足' ELSE '中等' END AS volume_level, CAST(price AS INTEGER) AS price, prov AS review_provisional, DATE '2024-01-01' + CAST(top AS INTEGER) AS latest_date, CAST(n_urls AS INTEGER) AS n_urls FROM k WHERE n > 1
""")
def published_products(spark, sf_dir):
    rows = _published(spark, sf_dir)
    several = rows.groupBy("id").count().where("count > 1").select("id")
    merged = P.merge_products(rows.join(several, "id"))
    return merged.select("id", "n_posts", "n_comments", "fair_score", "recommendation_score", "consensus", "confidence", "volume_level", "price", "review_provisional", "latest_date", F.size("post_urls").alias("n_urls"))


@query("WITH " + OPINIONS_SQL + " SELECT p_brand AS brand, CAST(count(*) AS BIGINT) AS n_products, CAST(sum(n_votes) AS BIGINT) AS n_comments FROM r JOIN part ON product = p_partkey GROUP BY 1")
def brand_summary_of_reports(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("brand"))
    return SH.brand_summary(reports(spark, sf_dir).join(part, "product").withColumns({"n_posts": F.lit(1), "n_comments": F.col("n_votes")})).select("brand", "n_products", "n_comments")


@query("""
WITH x AS (SELECT lang AS g, CASE WHEN text LIKE '% the %' THEN 'en' WHEN text LIKE '% der %' THEN 'de' WHEN text LIKE '% les %' THEN 'fr' ELSE 'es' END AS p FROM documents),
u AS (SELECT g AS label, 1 AS g, 0 AS p, g = p AS hit FROM x UNION ALL SELECT p, 0, 1, false FROM x),
c AS (SELECT label, sum(g) AS support, sum(p) AS predicted, sum(CASE WHEN hit AND g = 1 THEN 1 ELSE 0 END) AS tp FROM u GROUP BY 1),
m AS (SELECT label, support, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 4) AS p, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 4) AS r, round(2 * tp / (predicted + support), 4) AS f FROM c)
SELECT (SELECT round(avg(coalesce(g = p, false)::INT), 4) FROM x) AS accuracy, round(avg(p), 4) AS precision_macro, round(avg(r), 4) AS recall_macro, round(avg(f), 4) AS f1_macro, CAST(sum(support) AS BIGINT) AS support FROM m
""")
def macro_metrics(spark, sf_dir):
    guess = F.when(F.col("text").contains(" the "), "en").when(F.col("text").contains(" der "), "de").when(F.col("text").contains(" les "), "fr").otherwise("es")
    return EV.macro_metrics(table(spark, sf_dir, "documents").select("lang", guess.alias("guess")), "lang", "guess")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 40")
def label_sample(spark, sf_dir):
    return EV.sample(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), "7", 40)


@query("""
WITH s AS (SELECT doc_id, lang FROM documents WHERE doc_id % 5 > 0), l AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 6 > 0 UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 66 = 1),
o AS (SELECT doc_id, min(lang) AS lang, min(lang) IS NOT DISTINCT FROM max(lang) AS same FROM l GROUP BY 1)
SELECT coalesce(o.doc_id, s.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'unknown' WHEN o.doc_id IS NULL THEN 'dropped' ELSE 'changed' END AS fault FROM o FULL JOIN s ON o.doc_id = s.doc_id WHERE s.doc_id IS NULL OR o.doc_id IS NULL OR o.lang IS DISTINCT FROM s.lang
UNION SELECT doc_id, 'changed' FROM o WHERE NOT same UNION SELECT doc_id, 'repeated' FROM l GROUP BY 1 HAVING count(*) > 1
""")
def label_file_faults(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    given = docs.where("doc_id % 6 > 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang"))).unionByName(docs.where("doc_id % 66 = 1"))
    return IM.file_faults(given, docs.where("doc_id % 5 > 0"), "doc_id", ["lang"])


@query("""
WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 199 = 5 THEN '2.5' ELSE CAST(quality - 0.5 AS VARCHAR) END AS s, doc_id % 3 AS m FROM labels),
r AS (SELECT doc_id, s, CASE WHEN s = '' THEN 'skipped' WHEN s = '2.5' THEN 'rejected' ELSE 'accepted' END AS status FROM f), c AS (SELECT doc_id FROM labels WHERE doc_id % 4 = 0)
SELECT r.doc_id, CASE WHEN status = 'accepted' AND doc_id % 4 > 0 THEN CAST(s AS DOUBLE) WHEN status = 'accepted' THEN CAST(s AS DOUBLE) ELSE 9.0 END AS score FROM r WHERE status = 'accepted' OR doc_id % 4 = 0
""")
def label_import(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    key = F.sha2(F.col("doc_id").cast("string"), 256)
    score = F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 199 == 5, "2.5").otherwise((F.col("quality") - 0.5).cast("string"))
    rows = labels.select("doc_id", key.alias("fingerprint"), score.alias("llm_score"), F.when(score == "", "").otherwise("正").alias("llm_label"), F.lit("是").alias("is_relevant"))
    cache = labels.where("doc_id % 4 = 0").select("doc_id", key.alias("fingerprint"), F.lit("9.0").alias("llm_score"))
    merged = IM.import_rows(IM.sentiment_rows(rows), cache, ["fingerprint"], replace=True).merged
    return merged.select("doc_id", F.col("llm_score").cast("double").alias("score"))


def split_posts(spark, sf_dir):
    """Posts, one per part, with the golden fields: a row per product."""
    found = F.element_at(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(b).alias("b")) for f, b, _ in cases.EXTRACTIONS]), (F.col("p_partkey") % len(cases.EXTRACTIONS) + 1).cast("int"))
    posts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.lit("[商品] x").alias("title"), found["b"].alias("brand"), found["f"].alias("product_name"), F.lit(None).cast("string").alias("price"), F.lit(False).alias("is_reply"),
        F.array().cast("array<struct<tag:string,user:string,text:string>>").alias("comments"),
    )
    return ID.split_posts(posts).select(F.split_part("id", F.lit("_"), F.lit(1)).cast("long").alias("p_partkey"), "product_name", "price")


QUERIES["split_posts"] = split_posts
_values = ", ".join(f"({i}, '{n}', CAST({'NULL' if p is None else repr(str(p))} AS VARCHAR))" for i, (_, _, items) in enumerate(cases.EXTRACTIONS) for n, p in items)
ORACLES["split_posts"] = f"SELECT p_partkey, product_name, price FROM part JOIN (VALUES {_values}) v(i, product_name, price) ON p_partkey % {len(cases.EXTRACTIONS)} = i"


@query()
def cluster_names(spark, sf_dir):
    """Names of parts of a brand that are spelled alike. The sequence ratio has no SQL; a test compares clusters with brute force."""
    return ID.cluster_names(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.regexp_replace("p_name", " ", "").alias("name")))
