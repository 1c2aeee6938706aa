"""Queries on rows for human labels: conversations as threads, turns as comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labelling_rows as LR
from .registry import query
from .standins import table


def threads(spark, sf_dir):
    """A post per conversation: its turns as comments in order; some without product, price, brackets or time."""
    k = F.col("conv_id")
    at = F.timestamp_seconds(1_700_000_000 + k * 1000 + F.col("turn") * 60)
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.when(F.col("turn") % 3 == 0, "推").when(F.col("turn") % 3 == 1, "→").otherwise("噓").alias("tag"), F.col("role").alias("user"), "text", F.when(F.col("turn") != 3, at).alias("posted_at")).alias("c"))
    posts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("comments"))  # a conversation's turns are few
    return posts.select(
        k.cast("string").alias("id"), F.lit("PTT").alias("source"), F.lit("CVS").alias("board"), F.concat(F.lit("https://board.example/"), k.cast("string")).alias("url"), F.when(k % 4 == 0, "plain").when(k % 4 == 1, "Re: 【 心得 】x").otherwise("[商品] 布丁").alias("title"),
        F.when(k % 2 == 0, "全家").otherwise("7-11").alias("brand"), F.when(k % 5 != 0, F.concat(F.lit("布丁"), k.cast("string"))).alias("product_name"), F.when(k % 3 == 0, "").when(k % 3 == 1, "35").alias("price"), "comments",
    )


ROWS_SQL = """
c AS (SELECT conv_id AS k, row_number() OVER w - 1 AS idx, CASE turn % 3 WHEN 0 THEN '推' WHEN 1 THEN '→' ELSE '噓' END AS tag, coalesce(role, '') AS u, coalesce(text, '') AS text, CASE WHEN turn <> 3 THEN strftime(make_timestamp((1700000000 + conv_id * 1000 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') ELSE '' END AS at_, turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, tag || ' ' || u || ': ' || text AS line FROM c),
m AS (SELECT *, concat_ws(chr(10), lag(line, 2) OVER w, lag(line, 1) OVER w, '>' || line, lead(line, 1) OVER w, lead(line, 2) OVER w) AS around FROM n WINDOW w AS (PARTITION BY k ORDER BY turn)),
p AS (SELECT *, CASE k % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'Re: 【 心得 】x' ELSE '[商品] 布丁' END AS title, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '心得' ELSE '商品' END AS ptag, CASE WHEN k % 2 = 0 THEN '全家' ELSE '7-11' END AS brand, CASE WHEN k % 5 <> 0 THEN '布丁' || k ELSE '' END AS product, CASE WHEN k % 3 = 1 THEN '35' ELSE '' END AS price FROM m),
r AS (SELECT k || '#' || lpad(CAST(idx AS VARCHAR), 3, '0') AS comment_id, 'PTT' AS source, 'CVS' AS board, CAST(k AS VARCHAR) AS post_id, 'https://board.example/' || k AS post_url, title AS post_title, brand AS post_brand, product AS product_name, price, ptag AS post_tag, u AS comment_user, tag AS comment_tag, text AS comment_text, at_ AS comment_posted_at,
  '貼文品牌=' || brand || '; 商品=' || CASE WHEN product = '' THEN 'unknown' ELSE product END || '; tag=' || CASE WHEN ptag = '' THEN 'unknown' ELSE ptag END || CASE WHEN price <> '' THEN '; 價格=' || price ELSE '' END || '; 標題=' || title AS context, '' AS sentiment, '' AS target_brand, '' AS is_comparative, '' AS favored_brand, '' AS notes, around FROM p)
"""


@query(f"WITH {ROWS_SQL} SELECT * FROM r")
def labelling_rows(spark, sf_dir):
    return LR.labelling_rows(threads(spark, sf_dir))


@query(f"WITH {ROWS_SQL} SELECT comment_id, context, around FROM r ORDER BY sha256('7:' || comment_id), comment_id LIMIT 100")
def labelling_sample(spark, sf_dir):
    return LR.labelling_sample(LR.labelling_rows(threads(spark, sf_dir)), 100, seed=7).select("comment_id", "context", "around")
