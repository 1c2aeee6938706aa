"""Queries on the published shelf: search, chips, sorts, pages, overrides, checks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import publish as P, shelf as SH
from .registry import query
from .standins import table

PRODUCTS_SQL = """
s AS (SELECT l_partkey, count(*) AS volume, max(l_shipdate) AS latest, CASE WHEN count(*) > 20 THEN round(avg(l_quantity) * 2, 1) END AS score FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS name, p_type AS category, CASE WHEN p_size > 3 THEN p_retailprice END AS price, coalesce(volume, 0) AS volume, latest, score,
  datediff('day', latest::DATE, DATE '2001-12-31') * 1.0 AS age FROM part LEFT JOIN s ON l_partkey = p_partkey)
"""


def products(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("volume"), F.max("l_shipdate").alias("latest"), F.when(F.count("*") > 20, F.round(F.avg("l_quantity") * 2, 1)).alias("score"))
    return table(spark, sf_dir, "part").join(s, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.when(F.col("p_size") > 3, F.col("p_retailprice")).alias("price"),
        F.coalesce("volume", F.lit(0)).alias("volume"), "latest", "score", (F.datediff(F.lit("2001-12-31").cast("date"), "latest") * 1.0).alias("age"),
    )


def _ranked(rows, n, *order):
    """The first n by an order that ends in the id, numbered."""
    top = rows.orderBy(*order, "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order, "id"))).select("rank", "id", "brand")


def _sql(order, n=60):
    return f"WITH {PRODUCTS_SQL} SELECT CAST(row_number() OVER (ORDER BY {order}, id) AS INTEGER) AS rank, id, brand FROM p ORDER BY rank LIMIT {n}"


@query(_sql("round(score * pow(0.5, greatest(0, age) / 240) * (1 + 0.15 * ln(1 + volume)), 9) DESC NULLS LAST, score DESC NULLS LAST, brand"))
def sort_recent_recommendation(spark, sf_dir):
    value = F.round(SH.recent_recommendation(F.col("score"), F.col("volume"), F.col("age"), 240), 9)
    return _ranked(products(spark, sf_dir), 60, value.desc_nulls_last(), F.col("score").desc_nulls_last(), "brand")


@query(_sql("round(coalesce(pow(0.5, greatest(0, age) / 240), 0) * ln(1 + volume), 9) DESC NULLS LAST, volume DESC, brand"))
def sort_heat(spark, sf_dir):
    value = F.round(SH.heat(F.col("volume"), F.col("age"), 240), 9)
    return _ranked(products(spark, sf_dir), 60, value.desc_nulls_last(), F.col("volume").desc(), "brand")


@query(_sql("score DESC NULLS LAST, volume DESC, brand"))
def sort_score_down(spark, sf_dir):
    return _ranked(products(spark, sf_dir), 60, F.col("score").desc_nulls_last(), F.col("volume").desc(), "brand")


@query(_sql("score ASC NULLS LAST, volume DESC, brand"))
def sort_score_up(spark, sf_dir):
    return _ranked(products(spark, sf_dir), 60, F.col("score").asc_nulls_last(), F.col("volume").desc(), "brand")


@query(f"WITH {PRODUCTS_SQL} SELECT id, name, volume FROM p ORDER BY volume DESC, id LIMIT 30 OFFSET 30")
def second_page(spark, sf_dir):
    return products(spark, sf_dir).orderBy(F.col("volume").desc(), "id").limit(60).offset(30).select("id", "name", "volume")


@query(f"WITH {PRODUCTS_SQL} SELECT id, name, brand FROM p WHERE contains(lower(name || ' ' || brand), 'red') OR contains(regexp_replace(lower(name || ' ' || brand), '\\s+', '', 'g'), 'red')")
def search_products(spark, sf_dir):
    return products(spark, sf_dir).where(SH.search(" Red", "name", "brand")).select("id", "name", "brand")


@query(f"WITH {PRODUCTS_SQL} SELECT CASE WHEN brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN brand ELSE '其他' END AS chip, CASE category WHEN 'ECONOMY' THEN 'everyday' WHEN 'STANDARD' THEN 'everyday' ELSE 'special' END AS grp, CAST(count(*) AS BIGINT) AS n, CAST(count(score) AS BIGINT) AS scored FROM p GROUP BY 1, 2")
def chips(spark, sf_dir):
    chip = SH.fold(F.col("brand"), ["Brand#1", "Brand#2", "Brand#3"], "其他")
    group = F.when(F.col("category").isin("ECONOMY", "STANDARD"), "everyday").otherwise("special")
    return products(spark, sf_dir).groupBy(chip.alias("chip"), group.alias("grp")).agg(F.count("*").alias("n"), F.count("score").alias("scored"))


@query(f"WITH {PRODUCTS_SQL} SELECT id, latest FROM p WHERE latest BETWEEN TIMESTAMP '2001-06-01' AND TIMESTAMP '2001-09-30' AND score IS NOT NULL")
def recent_scored(spark, sf_dir):
    import datetime as dt

    rows = products(spark, sf_dir)
    return rows.where(SH.in_dates(F.col("latest"), dt.datetime(2001, 6, 1), dt.datetime(2001, 9, 30)) & F.col("score").isNotNull()).select("id", "latest")


@query(f"WITH {PRODUCTS_SQL} SELECT id, brand, CASE WHEN id % 10 = 1 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 10 = 2 THEN 12.5 WHEN id % 10 = 3 THEN NULL ELSE price END AS price FROM p WHERE id % 10 <> 0")
def override_apply(spark, sf_dir):
    rows = products(spark, sf_dir).select("id", "brand", "name", "price")
    k = F.col("id") % 10
    overrides = rows.where(k < 4).select("id", F.lit(1).alias("line"), F.when(k == 1, "renamed").alias("name"), F.when(k == 2, "12.5").when(k == 3, "__CLEAR__").alias("price"), F.when(k == 0, "EXCLUDE").alias("exclude"))
    return P.apply_overrides(rows, overrides, {"name": "string", "price": "double"})


@query("SELECT c_custkey AS id, 'negative balance' AS broken FROM customer WHERE c_acctbal < 0")
def payload_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("note"))
    return P.violations(rows, ["balance"], ["note"])


@query("SELECT l_orderkey AS id, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def unique_id(spark, sf_dir):
    return P.repeated_ids(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


@query("""
WITH m AS (SELECT o_custkey AS product, list_distinct(list(l_returnflag || l_linestatus)) AS b, o_orderkey, bool_or(l_discount > 0.09) AS other, bool_or(l_tax > 0.07) AS own FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 3),
f AS (SELECT product, unnest(b) AS brand FROM m), c AS (SELECT product, brand, count(*) AS n FROM f GROUP BY 1, 2), g AS (SELECT product, array_to_string(list(brand ORDER BY n DESC, brand), ',') AS competitor_brands FROM c GROUP BY 1)
SELECT product, CAST(count(*) AS BIGINT) AS mentions, CAST(count(*) FILTER (other) AS BIGINT) AS other_preferred, CAST(count(*) FILTER (own) AS BIGINT) AS own_preferred, any_value(competitor_brands) AS competitor_brands FROM m JOIN g USING (product) GROUP BY 1
""")
def competitor_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("brands"), F.bool_or(F.col("l_discount") > 0.09).alias("other_preferred"), F.bool_or(F.col("l_tax") > 0.07).alias("own_preferred"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("product"))
    return SH.competitor_stats(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))).withColumn("competitor_brands", F.array_join("competitor_brands", ","))
