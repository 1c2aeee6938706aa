"""Queries on categories of products: names of parts, with two words of the categories' vocabulary added to each by its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categories as CT
from ..operators import categories as CA, fingerprints as FP
from .registry import query
from .standins import table

VOCABULARY = sorted({w for words in CT.WORDS.values() for w in words} | {"泰式", "飯", "unknown", "限定"})
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def named(spark, sf_dir):
    """p_partkey, p_brand, name; two added words may make up a third."""
    n, k = len(VOCABULARY), F.col("p_partkey")
    words = F.array(*[F.lit(w) for w in VOCABULARY])
    word = lambda at: F.element_at(words, (at % n + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(word(k), word(F.floor(k / n) * 7 + k), F.lit("  "), "p_name").alias("name"))


def _rows(words, strong=None):
    return ", ".join(f"('{c}', {i}, '{w.lower()}', {w in (strong or {}).get(c, [])}, {w in CT.GENERIC})" for i, (c, ws) in enumerate(words.items()) for w in ws)


NAMED_SQL = f"""
n AS (SELECT p_partkey, p_brand, {_list(VOCABULARY)}[p_partkey % {len(VOCABULARY)} + 1] || {_list(VOCABULARY)}[(p_partkey // {len(VOCABULARY)} * 7 + p_partkey) % {len(VOCABULARY)} + 1] || '  ' || p_name AS name FROM part)
"""
BEST_SQL = f"""
w(category, i, word, strong, generic) AS (VALUES {_rows(CT.WORDS, CT.STRONG)}),
h AS (SELECT name, category, i, count(*) FILTER (strong) AS s, coalesce(max(length(word)) FILTER (strong), 0) AS ls, count(*) FILTER (NOT generic) AS k, coalesce(max(length(word)) FILTER (NOT generic), 0) AS lk, count(*) AS m
      FROM (SELECT DISTINCT name FROM n) JOIN w ON contains(lower(name), word) GROUP BY ALL),
b AS (SELECT name, category FROM h QUALIFY row_number() OVER (PARTITION BY name ORDER BY s DESC, ls DESC, k DESC, lk DESC, m DESC, i) = 1)
"""


@query(f"WITH {NAMED_SQL}, {BEST_SQL} SELECT p_partkey, name, coalesce(category, '其他') AS category FROM n LEFT JOIN b USING (name)")
def keyword_category(spark, sf_dir):
    return named(spark, sf_dir).select("p_partkey", "name", CA.guess(F.col("name")).alias("category"))


@query(f"""
WITH {NAMED_SQL.replace("'  ' || p_name", "' ' || p_name")}, {BEST_SQL}, o(category, i, word, strong, generic) AS (VALUES {_rows(CT.former_words())}),
f AS (SELECT name, arg_min(category, i) AS category FROM (SELECT DISTINCT name FROM n) JOIN o ON contains(lower(name), word) GROUP BY 1)
SELECT name AS product_name, coalesce(f.category, '其他') AS old_category, coalesce(b.category, '其他') AS new_category FROM (SELECT DISTINCT name FROM n) LEFT JOIN f USING (name) LEFT JOIN b USING (name)
""")
def category_audit(spark, sf_dir):
    return CA.audit(named(spark, sf_dir), "name")


@query(rf"""
WITH {NAMED_SQL}, {BEST_SQL}, l AS (
  SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '便當' WHEN 3 THEN ' 零食 ' WHEN 6 THEN 'nowhere' END AS label FROM n WHERE p_partkey % 3 = 0)
SELECT p_partkey, coalesce(CASE WHEN label <> 'nowhere' THEN trim(label) END, CASE WHEN p_size % 4 = 0 THEN '甜點' END, category, '其他') AS category
FROM n JOIN part USING (p_partkey) LEFT JOIN l USING (p_partkey) LEFT JOIN b ON n.name = b.name
""")
def resolved_category(spark, sf_dir):
    """A label by the category layer's key, given twice; else the stored category; else the words."""
    k = F.col("p_partkey")
    rows = named(spark, sf_dir).withColumn("brand", F.concat(F.lit("brand "), k.cast("string")))
    stored = table(spark, sf_dir, "part").select(k.alias("_p"), F.when(F.col("p_size") % 4 == 0, "甜點").otherwise("").alias("given"))
    label = F.when(k % 9 == 0, "便當").when(k % 9 == 3, " 零食 ").otherwise("nowhere")
    key = FP.category_key(F.col("brand"), F.col("name"))
    late = rows.where(k % 3 == 0).select(key.alias("key"), label.alias("category"), F.lit(2).alias("line"))
    early = rows.where((k % 9 == 0) | (k % 9 == 3)).select(key.alias("key"), F.lit("飲料").alias("category"), F.lit(1).alias("line"))
    rows = rows.join(stored, k == F.col("_p"))
    return CA.resolve(rows, late.unionByName(early), key, F.col("given"), F.col("name")).select("p_partkey", "category")
