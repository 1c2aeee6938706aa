"""The driver's tables as opinions, activity, posts and comments, with matching SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_decay(date, as_of: str = AS_OF):
    return F.exp(-0.005 * F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), date)))


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as opinions of a customer on a part, older ones lighter."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("product"), F.col("o_custkey").alias("user"), F.when(F.col("l_returnflag") == "N", "author").otherwise("commenter").alias("role"),
        ((F.col("l_quantity") - 1) / 49).alias("score"), day_decay("o_orderdate").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("o_orderdate").alias("at"),
    )


OPINIONS_SQL = """
o AS (
  SELECT l_partkey AS product, o_custkey AS usr, CASE WHEN l_returnflag = 'N' THEN 'author' ELSE 'commenter' END AS role,
         (l_quantity - 1) / 49 AS score, exp(-0.005 * greatest(0, datediff('day', o_orderdate::DATE, DATE '2001-08-01'))) AS weight,
         l_orderkey * 10 + l_linenumber AS ord, o_orderdate AS at_
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), v AS (
  SELECT product, usr, CASE WHEN sum(weight) > 0 THEN sum(score * weight) / sum(weight) ELSE avg(score) END AS stance, avg(weight) AS weight
  FROM o GROUP BY 1, 2
), m AS (
  SELECT product, count(*) AS n_votes, sum(weight) AS sw, sum(weight * weight) AS sww, sum(weight * stance) AS sws, sum(weight * stance * stance) AS swss,
         sum(CASE WHEN stance > 0.6 THEN weight ELSE 0 END) AS positive_weight, sum(CASE WHEN stance BETWEEN 0.4 AND 0.6 THEN weight ELSE 0 END) AS neutral_weight,
         sum(CASE WHEN stance < 0.4 THEN weight ELSE 0 END) AS negative_weight
  FROM v GROUP BY 1
), q AS (
  SELECT *, sws / sw AS mean_, sqrt(greatest(0, swss / sw - (sws / sw) * (sws / sw))) AS std_, sw * sw / sww AS n_eff_ FROM m
), r AS (
  SELECT *, round(100 * (0.5 + sws) / (1 + sw), 1) AS fair_score, round(mean_, 4) AS score_mean, round(std_, 3) AS score_std, round(n_eff_, 2) AS n_eff,
         CASE WHEN n_eff_ < 3 THEN '資料不足' WHEN std_ >= 0.26 THEN '評價兩極' WHEN mean_ >= 0.68 AND std_ <= 0.25 THEN '一致好評'
              WHEN mean_ <= 0.45 AND std_ <= 0.25 THEN '一致負評' ELSE '褒貶不一' END AS consensus,
         CASE WHEN n_eff_ < 3 THEN '低' WHEN n_eff_ < 8 THEN '中' ELSE '高' END AS confidence
  FROM q
)
"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as comments of a user on a brand, with a sentiment from -1 to 1 and a text."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("brand"), "ts", F.concat(F.lit("order of "), "event_type", F.lit(" no. "), (F.col("event_id") % 7 * 1009).cast("string")).alias("text"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * F.col("value") / 500 - 1)).alias("sentiment")
    )


ACTIVITY_SQL = """
e AS (SELECT event_id, user_id, event_type AS brand, ts, 'order of ' || event_type || ' no. ' || CAST(event_id % 7 * 1009 AS VARCHAR) AS text, greatest(-1.0, least(1.0, 2 * value / 500 - 1)) AS sentiment FROM events)
"""
