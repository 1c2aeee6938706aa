"""Queries on text: parsing, predicates, similarity, names, categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import similar as SM
from ..operators.store import pinned
from .registry import query
from .standins import table

# An account stands for a two hundredth of a source's documents.
DUP_SQL = r"""
WITH d AS (SELECT doc_id, source || '-' || doc_id % 200 AS user_id, regexp_replace(lower(text), '[\s\pP]', '', 'g') AS t FROM documents),
f AS (SELECT user_id, t, min(doc_id) AS doc_id, count(*) AS n FROM d WHERE length(t) > 3 GROUP BY 1, 2),
c AS (SELECT *, string_split(t, '') AS c FROM f),
g AS (SELECT user_id, doc_id, n, list_distinct(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) AS s FROM c),
p AS (SELECT a.user_id, least(a.doc_id, b.doc_id) AS a, greatest(a.doc_id, b.doc_id) AS b, len(list_intersect(a.s, b.s)) AS k, len(a.s) + len(b.s) AS m FROM g a JOIN g b ON a.user_id = b.user_id AND a.doc_id < b.doc_id
      AND len(a.s) >= 0.8 * len(b.s) AND len(b.s) >= 0.8 * len(a.s))
"""


def _accounts(spark, sf_dir):
    user = F.concat_ws("-", "source", F.col("doc_id") % 200)
    return table(spark, sf_dir, "documents").select("doc_id", user.alias("user_id"), F.lower("text").alias("text"))


@query(DUP_SQL + "SELECT a, b, round(k / (m - k), 6) AS similarity FROM p WHERE k >= 0.8 * (m - k) - 1e-9")
def template_pairs(spark, sf_dir):
    rows = _accounts(spark, sf_dir).withColumn("t", TX.bare(F.col("text"))).where(F.length("t") > 3)
    folded = pinned(rows.groupBy("user_id", "t").agg(F.min("doc_id").alias("doc_id")).select("user_id", "doc_id", SM.packed_pairs(F.col("t")).alias("s")))
    return SM.similar_texts(folded, "user_id", "doc_id", "s", 0.8).withColumn("similarity", F.round("similarity", 6))


@query(DUP_SQL + """, h AS (SELECT DISTINCT user_id, unnest([a, b]) AS doc_id FROM p WHERE k >= 0.8 * (m - k) - 1e-9)
SELECT g.user_id, round(CASE WHEN sum(n) >= 3 THEN sum(CASE WHEN n > 1 OR h.doc_id IS NOT NULL THEN n ELSE 0 END) / sum(n) ELSE 0 END, 6) AS ratio FROM g LEFT JOIN h ON g.doc_id = h.doc_id AND g.user_id = h.user_id GROUP BY 1""")
def template_ratio(spark, sf_dir):
    from ..operators.accounts import template_ratio as ratio

    return ratio(_accounts(spark, sf_dir)).select("user_id", F.round("template_like", 6).alias("ratio"))


@query("""
WITH n AS (SELECT DISTINCT p_brand, p_name FROM part), g AS (SELECT p_brand, p_name, list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2))) AS s FROM n)
SELECT a.p_name AS a, b.p_name AS b, CAST(count(*) AS BIGINT) AS n_brands, min(round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6)) AS similarity
FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.p_name < b.p_name AND len(list_intersect(a.s, b.s)) >= 0.5 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) GROUP BY 1, 2
""")
def bigram_jaccard(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct().withColumns({"s": TX.bigrams(F.col("p_name")), "id": F.struct("p_brand", "p_name")})
    pairs = SM.similar_pairs(names, ["p_brand"], "id", "s", 0.5)
    return pairs.groupBy(F.col("a.p_name").alias("a"), F.col("b.p_name").alias("b")).agg(F.count("*").alias("n_brands"), F.min(F.round("similarity", 6)).alias("similarity"))


@query("""
WITH c AS (SELECT p_brand AS brand, p_name AS name, count(*) AS n FROM part GROUP BY 1, 2)
SELECT brand, name, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY brand ORDER BY n DESC, length(name) DESC, name) = 1
""")
def representative_name(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    best = F.struct(-F.col("n"), -F.length("name"), F.col("name"))
    return c.groupBy("brand").agg(F.min_by("name", best).alias("name"), F.max("n").alias("n"))


@query("SELECT conv_id, turn, regexp_matches(text, 'que|the') AND NOT regexp_matches(text, 'ment|tion') AS flagged FROM conversations")
def predicate_chain(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (t.rlike("que|the") & ~t.rlike("ment|tion")).alias("flagged"))


@query("""
WITH c AS (SELECT source AS product, text <> '' AS counted, text LIKE '%License%' AND text NOT LIKE '%password%' AS shill FROM documents)
SELECT product, CAST(count(*) FILTER (counted) AS BIGINT) AS n_comments, round(CASE WHEN count(*) FILTER (counted) >= 3 THEN count(*) FILTER (counted AND shill) / count(*) FILTER (counted) ELSE 0 END, 6) AS shill_ratio,
  CASE WHEN count(*) FILTER (counted) >= 3 THEN count(*) FILTER (counted AND shill) / count(*) FILTER (counted) ELSE 0 END >= 0.25 AS shill_flag FROM c GROUP BY 1
""")
def shill_stats(spark, sf_dir):
    from ..operators.publish import shill_stats as stats

    t = F.col("text")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("product"), (t != "").alias("counted"), (t.contains("License") & ~t.contains("password")).alias("shill"))
    return stats(rows).withColumn("shill_ratio", F.round("shill_ratio", 6))


@query("SELECT page_id, url, regexp_matches(url, '^https://([^/?#]*\\.)?example\\.(com|net)/en/') AS allowed FROM pages")
def url_allowlist(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", TX.allowed_url(F.col("url"), "https", ["example.com", "example.net"], "/en/").alias("allowed"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", TX.html_title(F.col("html")).alias("title"))


@query("""
SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS n_links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))), ' ') AS links FROM pages
""")
def html_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<p>"), 0)).cast("long").alias("n_paragraphs"), F.size(links).cast("long").alias("n_links"), F.array_join(F.array_sort(F.array_distinct(links)), " ").alias("links"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS BIGINT) AS n_fields FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.size(F.json_object_keys("props")), F.lit(0)).cast("long").alias("n_fields"))


@query("""
SELECT p_partkey, '【name】' || p_name AS form, p_name AS name, '：' || p_size AS size FROM part
""")
def field_map(spark, sf_dir):
    form = F.concat(F.lit("【name】"), "p_name", F.lit("\n【 size】:9\n【size】："), F.col("p_size").cast("string"), F.lit(" \n"))
    m = TX.field_map(form)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("【name】"), "p_name").alias("form"), m["name"].alias("name"), m["size"].alias("size"))


@query("SELECT page_id, CASE WHEN b <> '' THEN b ELSE 'local-' || substr(sha1(url), 1, 12) END AS post_id FROM (SELECT page_id, url, regexp_extract(url, '/([^/?#]+?)(?:\\.html?)?(?:[?#].*)?$', 1) AS b FROM pages)")
def post_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", TX.post_id(F.col("url")).alias("post_id"))
