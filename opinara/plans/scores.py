"""Queries on product scores: shrinkage, consensus, ranking, publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import config as C
from ..operators import opinions as O, publish as P
from .registry import query
from .standins import OPINIONS_SQL, opinions, table


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.fair_scores(O.product_moments(O.one_vote(opinions(spark, sf_dir))))


@query(f"WITH {OPINIONS_SQL} SELECT product, CAST(n_votes AS BIGINT) AS n_votes, fair_score, score_mean, score_std, n_eff, consensus, confidence FROM r")
def product_score(spark, sf_dir):
    return reports(spark, sf_dir).select("product", "n_votes", "fair_score", "score_mean", "score_std", "n_eff", "consensus", "confidence")


@query(f"WITH {OPINIONS_SQL} SELECT consensus, confidence, CAST(count(*) AS BIGINT) AS n_products, round(avg(fair_score), 2) AS mean_score FROM r GROUP BY 1, 2")
def consensus_bands(spark, sf_dir):
    return reports(spark, sf_dir).groupBy("consensus", "confidence").agg(F.count("*").alias("n_products"), F.round(F.avg("fair_score"), 2).alias("mean_score"))


@query("""
WITH """ + OPINIONS_SQL + """
, x AS (SELECT product, usr, role, weight, row_number() OVER (PARTITION BY product, usr ORDER BY weight DESC, ord, role) AS k FROM o)
SELECT v.product, v.usr AS "user", round(stance, 8) AS stance, round(v.weight, 9) AS weight, x.role AS role FROM v JOIN x ON v.product = x.product AND v.usr = x.usr AND k = 1
""")
def one_vote_per_human(spark, sf_dir):
    return O.one_vote(opinions(spark, sf_dir)).select("product", "user", F.round("stance", 8).alias("stance"), F.round("weight", 9).alias("weight"), "role")


@query("""
WITH """ + OPINIONS_SQL + """
SELECT CAST(row_number() OVER (ORDER BY (confidence = '低' OR consensus = '資料不足'), fair_score DESC, product) AS INTEGER) AS rank, product, fair_score, consensus FROM r
ORDER BY rank LIMIT 100
""")
def report_rank(spark, sf_dir):
    top = O.filter_reports(reports(spark, sf_dir), limit=100)  # the first hundred, before they are numbered
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*O.report_order()))).select("rank", "product", "fair_score", "consensus")


@query(f"WITH {OPINIONS_SQL} SELECT product, fair_score, n_eff, CAST(n_votes AS BIGINT) AS n_votes FROM r WHERE fair_score >= 52 AND n_eff >= 8 AND n_votes >= 10")
def report_filters(spark, sf_dir):
    return O.filter_reports(reports(spark, sf_dir), min_score=52, min_n_eff=8, min_votes=10).select("product", "fair_score", "n_eff", "n_votes")


@query("""
WITH """ + OPINIONS_SQL + """
, e AS (SELECT product, positive_weight + neutral_weight + negative_weight AS t, * EXCLUDE (product) FROM r),
f AS (SELECT product, 100 * positive_weight / t AS a, 100 * neutral_weight / t AS b, 100 * negative_weight / t AS c FROM e),
g AS (SELECT *, floor(round(a, 9)) AS fa, floor(round(b, 9)) AS fb, floor(round(c, 9)) AS fc FROM f),
h AS (SELECT *, round(a - fa, 9) AS ra, round(b - fb, 9) AS rb, round(c - fc, 9) AS rc, 100 - fa - fb - fc AS l FROM g)
SELECT product, CAST(fa + CASE WHEN (rb > ra)::INT + (rc > ra)::INT < l THEN 1 ELSE 0 END AS BIGINT) AS positive,
       CAST(fb + CASE WHEN (ra >= rb)::INT + (rc > rb)::INT < l THEN 1 ELSE 0 END AS BIGINT) AS neutral,
       CAST(fc + CASE WHEN (ra >= rc)::INT + (rb >= rc)::INT < l THEN 1 ELSE 0 END AS BIGINT) AS negative FROM h
""")
def polarity_distribution(spark, sf_dir):
    split = O.percent_split(F.col("positive_weight"), F.col("neutral_weight"), F.col("negative_weight"))
    return reports(spark, sf_dir).select("product", *[c.alias(n) for c, n in zip(split, ("positive", "neutral", "negative"), strict=True)])


@query("""
WITH """ + OPINIONS_SQL + """
SELECT product, fair_score, CASE WHEN confidence <> '低' AND consensus <> '資料不足'
  THEN CAST(round_even((least(greatest(fair_score, 20), 80) - 20) * 100 / 60, 0) AS BIGINT) END AS recommendation FROM r
""")
def calibrated_recommendation(spark, sf_dir):
    sure = (F.col("confidence") != "低") & (F.col("consensus") != C.INSUFFICIENT)
    return reports(spark, sf_dir).select("product", "fair_score", O.recommendation(F.col("fair_score"), sure).alias("recommendation"))


@query("""
WITH """ + OPINIONS_SQL + """
, b AS (SELECT p_brand AS brand, r.product, fair_score, row_number() OVER (PARTITION BY p_brand ORDER BY fair_score DESC, product) AS k FROM r JOIN part ON p_partkey = product)
SELECT brand, CAST(k AS INTEGER) AS rank, product, fair_score FROM b WHERE k <= 3
""")
def top_products_of_brand(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("brand"))
    rank = F.row_number().over(Window.partitionBy("brand").orderBy(F.col("fair_score").desc(), "product"))
    return reports(spark, sf_dir).join(parts, "product").withColumn("rank", rank).where("rank <= 3").select("brand", "rank", "product", "fair_score")


@query("""
WITH """ + OPINIONS_SQL + """
, g AS (SELECT p_brand AS id, count(*) AS n, sum(sw) AS w, sum(sws) AS ws, sum(sww) AS ww, sum(sw * (score_std * score_std + score_mean * score_mean)) AS second, sum(n_votes) AS n_votes,
         arg_max(product, (n_eff, -product)) AS dominant FROM r JOIN part ON p_partkey = product GROUP BY 1)
SELECT id, CAST(n AS BIGINT) AS n_members, CAST(n_votes AS BIGINT) AS n_votes, dominant, round(100 * (0.5 + ws) / (1 + w), 1) AS fair_score,
       round(sqrt(greatest(0, second / w - (ws / w) * (ws / w))), 3) AS score_std, round(w * w / ww, 2) AS n_eff FROM g
""")
def pooled_merge(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("id"))
    return P.pooled_merge(reports(spark, sf_dir).join(parts, "product")).select("id", "n_members", "n_votes", "dominant", "fair_score", "score_std", "n_eff")


@query("""
WITH """ + OPINIONS_SQL + """
, s AS (SELECT l_partkey AS product, count(*) AS n, sum(CASE WHEN l_shipinstruct_like THEN 1 ELSE 0 END) AS k FROM (SELECT l_partkey, l_linenumber = 3 AND l_returnflag = 'R' AS l_shipinstruct_like FROM lineitem) GROUP BY 1),
p AS (SELECT product, CASE WHEN n >= 3 AND k / n >= 0.25 THEN 0.3 ELSE 1.0 END AS penalty FROM s)
SELECT product, penalty < 1 AS shill_flag, round(100 * (0.5 + penalty * sws) / (1 + penalty * sw), 1) AS fair_score, n_eff, score_std FROM r JOIN p USING (product)
""")
def shill_penalty(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product"), ((F.col("l_linenumber") == 3) & (F.col("l_returnflag") == "R")).alias("shill"))
    stats = P.shill_stats(lines.withColumn("counted", F.lit(True)))
    flagged = stats.where("shill_flag")
    scored = O.fair_scores(O.product_moments(O.one_vote(opinions(spark, sf_dir)), flagged))
    return scored.join(stats.select("product", "shill_flag"), "product").select("product", "shill_flag", "fair_score", "n_eff", "score_std")


@query("""
WITH e AS (SELECT l_partkey AS product, l_shipdate AS at_, CASE WHEN l_discount > 0.07 THEN NULL ELSE l_extendedprice END AS price, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)
SELECT product, max(at_) AS latest, arg_max(price, (at_, ord)) FILTER (WHERE price IS NOT NULL) AS price, CAST(count(*) FILTER (WHERE price IS NULL) AS BIGINT) AS unpriced FROM e GROUP BY 1
""")
def newest_price(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product"), F.col("l_shipdate").alias("at"), F.when(~(F.col("l_discount") > 0.07), F.col("l_extendedprice")).alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")
    )
    newest = F.max_by("price", F.when(F.col("price").isNotNull(), F.struct("at", "ord")))
    return lines.groupBy("product").agg(F.max("at").alias("latest"), newest.alias("price"), F.count(F.when(F.col("price").isNull(), 1)).alias("unpriced"))
