"""Queries on accounts: profiles, suspicion, bursts, merged runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as A, publish as P
from .registry import query
from .standins import ACTIVITY_SQL, activity, table


@query("WITH " + ACTIVITY_SQL + """
, s AS (SELECT user_id, brand, count(*) AS n, avg(sentiment) AS mean, min(ts) AS first FROM e GROUP BY 1, 2)
SELECT user_id, brand, CAST(n AS BIGINT) AS n, round(mean, 8) AS avg_sentiment FROM s
""")
def account_profile(spark, sf_dir):
    return A.brand_stats(activity(spark, sf_dir)).select("user_id", "brand", "n", F.round("mean", 8).alias("avg_sentiment"))


@query("WITH " + ACTIVITY_SQL + """
, s AS (SELECT user_id, brand, count(*) AS n, avg(sentiment) AS mean, min((ts, event_id)) AS first FROM e GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, first) AS k, sum(n) OVER (PARTITION BY user_id) AS total, count(*) OVER (PARTITION BY user_id) AS n_brands FROM s)
SELECT user_id, CAST(total AS BIGINT) AS total, CAST(n_brands AS BIGINT) AS n_brands, brand AS lean_brand FROM k WHERE k = 1
""")
def lean_brand(spark, sf_dir):
    return A.profiles(A.brand_stats(activity(spark, sf_dir))).select("user_id", "total", "n_brands", "lean_brand")


BURST_SQL = """
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, brand ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOURS FOLLOWING) AS n FROM e),
b AS (SELECT *, max(n >= 3) OVER (PARTITION BY user_id, brand ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS burst FROM c)
"""


@query("WITH " + ACTIVITY_SQL + ", " + BURST_SQL + "SELECT event_id, user_id, brand, burst FROM b")
def burst_flags(spark, sf_dir):
    return A.burst_flags(activity(spark, sf_dir)).select("event_id", "user_id", "brand", "burst")


@query("WITH " + ACTIVITY_SQL + ", " + BURST_SQL + "SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(avg(burst::INT), 4) AS burst_ratio FROM b GROUP BY 1")
def burst_ratio(spark, sf_dir):
    return A.burst_flags(activity(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("burst").cast("int")), 4).alias("burst_ratio"))


TEMPLATE_SQL = r"""
tt AS (SELECT user_id, regexp_replace(text, '[\s\pP]', '', 'g') AS t, count(*) AS n FROM e GROUP BY 1, 2),
tg AS (SELECT *, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS s FROM tt WHERE length(t) > 3),
tp AS (SELECT DISTINCT unnest([a.t, b.t]) AS t, a.user_id FROM tg a JOIN tg b ON a.user_id = b.user_id AND a.t < b.t AND len(list_intersect(a.s, b.s)) >= 0.8 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) - 1e-9),
tm AS (SELECT tg.user_id, CASE WHEN sum(n) >= 3 THEN sum(CASE WHEN n > 1 OR tp.t IS NOT NULL THEN n ELSE 0 END) / sum(n) ELSE 0 END AS template_like FROM tg LEFT JOIN tp ON tg.user_id = tp.user_id AND tg.t = tp.t GROUP BY 1)
"""
SUSPICION_SQL = "WITH " + ACTIVITY_SQL + ", " + BURST_SQL + ", " + TEMPLATE_SQL + """
, s AS (SELECT user_id, brand, count(*) AS n, avg(sentiment) AS mean FROM e GROUP BY 1, 2),
u AS (SELECT user_id, sum(n) AS total, max(n) AS most, max(mean) AS best, sum(mean) AS sm, count(*) AS k FROM s GROUP BY 1),
x AS (SELECT user_id, avg((abs(sentiment) >= 0.85)::INT) AS extreme FROM e GROUP BY 1), y AS (SELECT user_id, avg(burst::INT) AS burst FROM b GROUP BY 1),
f AS (SELECT user_id, total, CASE WHEN total >= 5 THEN CAST(round(CAST(least(1, (greatest(0, best) + abs(least(0, CASE WHEN k > 1 THEN (sm - best) / (k - 1) ELSE 0 END))) / 2) AS DECIMAL(20,12)), 4) AS DOUBLE) ELSE 0 END AS one_sided,
  CASE WHEN total >= 5 THEN CAST(round(CAST(most / total AS DECIMAL(20,12)), 4) AS DOUBLE) ELSE 0 END AS single_brand, CASE WHEN total >= 5 THEN CAST(round(CAST(extreme AS DECIMAL(20,12)), 4) AS DOUBLE) ELSE 0 END AS extreme, CASE WHEN total >= 5 THEN CAST(round(CAST(burst AS DECIMAL(20,12)), 4) AS DOUBLE) ELSE 0 END AS burst,
  CASE WHEN total >= 5 THEN CAST(round(CAST(template_like AS DECIMAL(20,12)), 4) AS DOUBLE) ELSE 0 END AS template_like
  FROM u JOIN x USING (user_id) JOIN y USING (user_id) JOIN tm USING (user_id)),
g AS (SELECT *, CAST(round(CAST(least(1, greatest(0, 0.35 * one_sided + 0.20 * single_brand + 0.20 * extreme + 0.10 * template_like + 0.15 * burst)) AS DECIMAL(20,12)), 4) AS DOUBLE) AS suspicion FROM f)
"""


@query(SUSPICION_SQL + "SELECT user_id, CAST(total AS BIGINT) AS total, one_sided, single_brand, extreme, template_like, burst FROM g")
def suspicion_features(spark, sf_dir):
    return A.suspicion(activity(spark, sf_dir)).select("user_id", "total", "one_sided", "single_brand", "extreme", "template_like", "burst")


@query(SUSPICION_SQL + ", h AS (SELECT user_id, suspicion, round(greatest(0.1, 1 - suspicion), 4) AS credibility FROM g) SELECT brand, CAST(count(*) AS BIGINT) AS n, round(sum(credibility * (sentiment + 1) / 2) / sum(credibility), 4) AS weighted_score FROM e JOIN h USING (user_id) GROUP BY 1")
def credibility_weighted_score(spark, sf_dir):
    rows = activity(spark, sf_dir)
    known = A.suspicion(rows).select("user_id", "credibility")
    w = F.coalesce("credibility", F.lit(1.0))
    return rows.join(known, "user_id", "left").groupBy("brand").agg(F.count("*").alias("n"), F.round(F.sum(w * (F.col("sentiment") + 1) / 2) / F.sum(w), 4).alias("weighted_score"))


@query(SUSPICION_SQL + ", k AS (SELECT row_number() OVER (ORDER BY suspicion DESC, total DESC, user_id) AS k, user_id, suspicion, total FROM g) SELECT CAST(k AS INTEGER) AS rank, user_id, suspicion, CAST(total AS BIGINT) AS total FROM k WHERE k <= 30")
def suspicion_listing(spark, sf_dir):
    from pyspark.sql import Window

    rows = activity(spark, sf_dir)
    order = (F.col("suspicion").desc(), F.col("total").desc(), "user_id")
    top = A.suspicion(rows).orderBy(*order).limit(30)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "user_id", "suspicion", "total")


@query("""
WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN '推' WHEN turn % 3 = 1 THEN '→' ELSE '噓' END AS tag, coalesce(text, '') AS text, CASE WHEN turn % 4 < 2 THEN 'a' ELSE 'b' END AS who FROM conversations),
l AS (SELECT *, CASE WHEN lag(who) OVER w IS DISTINCT FROM who THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT conv_id, who, CAST(count(*) AS BIGINT) AS n_merged, min(turn) AS first_turn, arg_min(tag, (tag = '→', turn)) AS tag, sha256(string_agg(text, '' ORDER BY turn)) AS text_sha256 FROM r GROUP BY conv_id, who, run
""")
def run_merge(spark, sf_dir):
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(turn % 3 == 0, "推").when(turn % 3 == 1, "→").otherwise("噓").alias("tag"), "text", F.when(turn % 4 < 2, "a").otherwise("b").alias("who")
    )
    merged = A.merge_runs(rows, ("conv_id",), ("turn",), "who", "tag", "text")
    return merged.select("conv_id", "who", "n_merged", F.col("first.turn").alias("first_turn"), "tag", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT c_custkey, substr(sha256('salt:' || c_custkey), 1, 12) AS user_hash FROM customer")
def hashed_accounts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", P.user_hash(F.col("c_custkey"), "salt").alias("user_hash"))


DRILL_SQL = SUSPICION_SQL + """
, top AS (SELECT user_id, suspicion, CAST(row_number() OVER (ORDER BY suspicion DESC, total DESC, user_id) AS INTEGER) AS rank FROM g QUALIFY row_number() OVER (ORDER BY suspicion DESC, total DESC, user_id) <= 30),
flagged AS (SELECT DISTINCT tt.user_id, tt.t FROM tt JOIN (SELECT user_id, sum(n) AS eligible FROM tt WHERE length(t) > 3 GROUP BY 1) q ON tt.user_id = q.user_id AND eligible >= 3 LEFT JOIN tp ON tp.user_id = tt.user_id AND tp.t = tt.t WHERE length(tt.t) > 3 AND (n > 1 OR tp.t IS NOT NULL)),
marked AS (SELECT top.rank, b.*, f.t IS NOT NULL AS template FROM b JOIN top USING (user_id) LEFT JOIN flagged f ON f.user_id = b.user_id AND f.t = regexp_replace(b.text, '[\\s\\pP]', '', 'g'))
"""


def _drilled(spark, sf_dir):
    """The 30 most suspicious accounts and their stored comments."""
    from ..operators import drilldown as DR
    from ..operators.store import shared_folder

    rows, path = activity(spark, sf_dir), shared_folder(spark, "activity")
    DR.store_activity(rows, path)
    listed = DR.suspects(rows)
    return listed, DR.stored_comments(spark, path, listed)


@query(DRILL_SQL + "SELECT rank, user_id, event_id, brand, ts, template, burst FROM marked")
def account_drilldown(spark, sf_dir):
    from ..operators import drilldown as DR

    return DR.marked_comments(_drilled(spark, sf_dir)[1]).select("rank", "user_id", "event_id", "brand", "ts", "template", "burst")


@query(DRILL_SQL + """
, s2 AS (SELECT user_id, brand, count(*) AS n, avg(sentiment) AS mean FROM e GROUP BY 1, 2),
lean AS (SELECT user_id, brand FROM (SELECT user_id, brand, avg(sentiment) AS mean, min((ts, event_id)) AS first FROM e GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, first) = 1),
head AS (SELECT rank, user_id, 0 AS part, unnest([0, 1, 2]) AS pos, unnest(['帳號可疑明細: ' || user_id, '總留言數: ' || g.total || '; 信度: ' || printf('%.2f', round(greatest(0.1, 1 - g.suspicion), 4)) || '; 可疑分: ' || printf('%.2f', g.suspicion) || '; 傾向品牌: ' || lean.brand, '品牌互動']) AS text
  FROM top JOIN g USING (user_id) JOIN lean USING (user_id)),
brands AS (SELECT rank, user_id, 1 AS part, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, brand) AS pos, '- ' || brand || ': 留言數=' || n || ', 平均情感=' || printf('%.2f', round(mean, 4)) AS text FROM s2 JOIN top USING (user_id)),
features AS (SELECT rank, user_id, 2 AS part, unnest(range(CASE WHEN total >= 5 THEN 6 ELSE 2 END)) AS pos, unnest(CASE WHEN total >= 5 THEN ['特徵明細', '- one_sided: ' || printf('%.2f', one_sided) || ' (偏向單一品牌正面、競品負面的程度)', '- single_brand: ' || printf('%.2f', single_brand) || ' (留言集中在單一品牌的程度)',
  '- extreme: ' || printf('%.2f', extreme) || ' (極端情感留言比例)', '- template_like: ' || printf('%.2f', template_like) || ' (完全重複或近似樣板留言比例)', '- burst: ' || printf('%.2f', burst) || ' (同品牌短時間爆發留言比例)'] ELSE ['特徵明細', '- 未達活動量門檻，未計算特徵'] END) AS text FROM top JOIN g USING (user_id)),
shown AS (SELECT rank, user_id, 3 AS part, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, '- [' || brand || '] ' || strftime(ts, '%Y-%m-%d %H:%M') || ' ' || text AS text FROM marked WHERE template
  UNION ALL SELECT rank, user_id, 4, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), '- [' || brand || '] ' || strftime(ts, '%Y-%m-%d %H:%M') || ' ' || text FROM marked WHERE burst),
titles AS (SELECT rank, user_id, unnest([3, 4]) AS part, 0 AS pos, unnest(['template_like 標記留言', 'burst 標記留言']) AS text FROM top),
nothing AS (SELECT rank, user_id, part, 1 AS pos, '- 無' AS text FROM titles t WHERE NOT EXISTS (SELECT 1 FROM shown WHERE shown.user_id = t.user_id AND shown.part = t.part)),
lines AS (SELECT * FROM head UNION ALL SELECT * FROM brands UNION ALL SELECT * FROM features UNION ALL SELECT * FROM titles UNION ALL SELECT * FROM nothing UNION ALL SELECT * FROM shown WHERE pos <= 10)
SELECT rank, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY part, pos) AS INTEGER) AS line, text FROM lines
""")
def account_details(spark, sf_dir):
    from ..operators import drilldown as DR

    listed, comments = _drilled(spark, sf_dir)
    marked = DR.marked_comments(comments)
    return DR.detail_lines(listed, marked, marked)
