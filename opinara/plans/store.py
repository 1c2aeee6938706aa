"""Queries on the store: snapshots, deltas, refreshes, windows, ages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import store as S
from .registry import query
from .standins import table

NOW = dt.datetime(2024, 2, 1)


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_snapshot(spark, sf_dir):
    return S.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "ts", "event_type")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def append_new(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    stored = orders.where("o_orderstatus = 'F'").select("o_custkey")
    return S.append_new(stored, orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def seen_anti(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(seen, "o_orderkey", "left_anti")


@query("""
WITH k AS (SELECT doc_id, quality, sha256('v2' || chr(31) || lower(trim(source)) || chr(31) || lang || chr(31) || text) AS key, sha256(source || chr(31) || text) AS legacy FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT key FROM k WHERE quality = 0 AND doc_id % 2 = 0), g AS (SELECT legacy FROM k WHERE quality = 0 AND doc_id % 2 = 1)
SELECT key, min(doc_id) AS doc_id FROM k WHERE key NOT IN (SELECT key FROM c) AND legacy NOT IN (SELECT legacy FROM g) GROUP BY 1
""")
def delta_export(spark, sf_dir):
    from ..operators.labels import export_delta, fingerprint

    docs = table(spark, sf_dir, "documents")
    key = fingerprint(F.lit("v2"), F.lower(F.trim("source")), F.col("lang"), F.col("text"))
    keyed = docs.select("doc_id", key.alias("key"), fingerprint(F.col("source"), F.col("text")).alias("legacy"))
    cached = keyed.join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    stored, old = cached.where("doc_id % 2 = 0").select("key"), cached.where("doc_id % 2 = 1").select("legacy")
    return export_delta(keyed, [(stored, "key"), (old, "legacy")], "key", "doc_id").select("key", "doc_id")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 6 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_custkey % 3 = 0 AS refreshed FROM customer
""")
def refresh_upsert(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    fetched = stored.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_custkey") % 6 == 0, "NEW").otherwise(" ").alias("c_mktsegment"))
    return S.refresh(stored, fetched, "c_custkey", ["c_acctbal"], ["c_mktsegment"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS origin FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'new' FROM supplier WHERE s_suppkey % 2 = 0")
def upsert_merge(spark, sf_dir):
    stored = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("old").alias("origin"))
    even = stored.where("s_suppkey % 2 = 0")
    new = even.withColumn("origin", F.lit("new")).unionByName(even.select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), F.lit("new").alias("origin")))
    return S.upsert(stored, new, "s_suppkey", replace=True)


@query("""
SELECT CAST(count(*) AS BIGINT) AS n_posts, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(count(DISTINCT source) AS BIGINT) AS n_sources, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents
""")
def store_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("n_posts"), F.sum("n_chars").alias("n_chars"), F.countDistinct("source").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


@query("""
WITH c AS (SELECT l_orderkey, list(l_shipdate) AS at_ FROM lineitem GROUP BY 1),
w AS (SELECT o_orderkey, o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-31 23:59:59.999999' AS inside, o_totalprice,
  len(list_filter(coalesce(at_, []), lambda x: x BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-31 23:59:59.999999')) AS n FROM orders LEFT JOIN c ON l_orderkey = o_orderkey)
SELECT o_orderkey AS id, CASE WHEN inside THEN o_totalprice END AS author_score, CAST(n AS BIGINT) AS n_comments, CASE WHEN inside THEN 'text' ELSE '' END AS review_text FROM w WHERE inside OR n > 0
""")
def time_window_posts(spark, sf_dir):
    comments = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_shipdate").alias("at"))).alias("comments"))
    posts = table(spark, sf_dir, "orders").join(comments, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("posted_at"), F.coalesce("comments", F.array().cast("array<struct<at:timestamp_ntz>>")).alias("comments"), F.col("o_totalprice").alias("author_score"), F.lit("text").alias("review_text")
    )
    window = S.TimeWindow(start=dt.date(1996, 3, 1), end=dt.date(1996, 3, 31))
    return S.filter_posts(posts, window).select("id", "author_score", F.size("comments").cast("long").alias("n_comments"), "review_text")


@query("SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-25' AND TIMESTAMP '2024-02-01'")
def refresh_candidates(spark, sf_dir):
    window = S.TimeWindow(recent_days=7, now=NOW)
    return table(spark, sf_dir, "events").where(window.holds(F.col("ts"))).select("event_id", "user_id")


@query("SELECT o_orderkey, round(exp(-0.005 * greatest(0, epoch(TIMESTAMP '1997-08-01 06:30:00' - o_orderdate) / 86400)), 9) AS decay FROM orders")
def decay_weight(spark, sf_dir):
    from ..operators.opinions import decay_weight as decay

    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(decay(F.col("o_orderdate"), F.lit("1997-08-01 06:30:00").cast("timestamp_ntz")), 9).alias("decay"))


@query("""
WITH d AS (SELECT event_id, datediff('day', ts::DATE, DATE '2024-02-01') AS d FROM events)
SELECT event_id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago' WHEN d < 30 THEN CAST(floor(d / 7) AS INT) || ' weeks ago' ELSE CAST(floor(d / 30) AS INT) || ' months ago' END AS age FROM d
""")
def relative_age(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.age_label(F.datediff(F.lit("2024-02-01").cast("date"), "ts")).alias("age"))


@query("SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 300 AS BIGINT) AS chunk FROM part")
def label_chunks(spark, sf_dir):
    return S.chunk_numbers(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 300).select("p_partkey", "chunk")


@query("SELECT event_type AS status, CAST(count(*) AS BIGINT) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def outcome_counters(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT p_brand AS brand, CAST(count(DISTINCT p_name) AS BIGINT) AS n_products, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_posts, CAST(count(l_orderkey) AS BIGINT) AS n_comments FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def brand_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    joined = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.groupBy(F.col("p_brand").alias("brand")).agg(F.countDistinct("p_name").alias("n_products"), F.countDistinct("l_orderkey").alias("n_posts"), F.count("l_orderkey").alias("n_comments"))


@query("WITH u AS (SELECT DISTINCT split_part(url, '?', 1) AS u, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages) SELECT host, CAST(count(*) AS BIGINT) AS n_urls, array_to_string(list_sort(list(u)), ' ') AS urls FROM u GROUP BY 1")
def distinct_urls(spark, sf_dir):
    url = F.split_part("url", F.lit("?"), F.lit(1))
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    urls = table(spark, sf_dir, "pages").select(host.alias("host"), url.alias("u")).distinct()
    return urls.groupBy("host").agg(F.count("*").alias("n_urls"), F.array_join(F.array_sort(F.collect_list("u")), " ").alias("urls"))
