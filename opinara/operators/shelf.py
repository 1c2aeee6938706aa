"""The shelf: searching, filtering, grouping, sorting and paging of published products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def search(needle: str, *columns: str) -> Column:
    """Case-insensitive substring of the joined columns, also with white space left out."""
    text = F.lower(F.concat_ws(" ", *columns))
    want = needle.strip().lower()
    squeezed = "".join(want.split())
    return text.contains(want) | F.regexp_replace(text, r"(?U)\s+", "").contains(squeezed) if want else F.lit(True)


def fold(value: Column, known: list[str], rest: str) -> Column:
    return F.when(value.isin(known), value).otherwise(rest)


def in_dates(at: Column, start=None, end=None) -> Column:
    """Inclusive; undated rows go as soon as there is a bound."""
    out = F.lit(True)
    if start is not None:
        out = out & (at >= F.lit(start))
    if end is not None:
        out = out & (at <= F.lit(end))
    return F.coalesce(out, F.lit(False))


def decay(hours: Column, half_life: float) -> Column:
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), hours) / half_life), F.lit(0.0))


def recent_recommendation(score: Column, volume: Column, age: Column, half_life: float = 24.0) -> Column:
    return score * decay(age, half_life) * (1 + 0.15 * F.log1p(volume))


def heat(volume: Column, age: Column, half_life: float = 24.0) -> Column:
    return decay(age, half_life) * F.log1p(volume)


def competitor_stats(mentions: DataFrame) -> DataFrame:
    """Per product: comments that name another brand, preferences either way, and the brands by how often they are named."""
    flat = mentions.select("product", F.explode("brands").alias("brand")).groupBy("product", "brand").agg(F.count("*").alias("n"))
    brands = flat.groupBy("product").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "brand"))), lambda x: x["brand"]).alias("competitor_brands"))
    counts = mentions.groupBy("product").agg(F.count_if(F.size("brands") > 0).alias("mentions"), F.count_if("other_preferred").alias("other_preferred"), F.count_if("own_preferred").alias("own_preferred"))
    return counts.join(brands, "product", "left")


def brand_summary(reports: DataFrame) -> DataFrame:
    """Per brand: products, posts and comments of its reports, most products first."""
    g = reports.groupBy("brand").agg(F.count("*").alias("n_products"), F.sum("n_posts").alias("n_posts"), F.sum("n_comments").alias("n_comments"))
    return g.orderBy(F.col("n_products").desc(), F.col("n_posts").desc(), "brand")


def override_excerpts(products: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Excerpts of an override file (key, excerpt) in place of others; they aren't provisional."""
    new = overrides.select(F.col(key).alias("_k"), F.col("excerpt").alias("_e"))
    out = products.join(new, F.col(key) == F.col("_k"), "left")
    return out.withColumns({"excerpt": F.coalesce("_e", "excerpt"), "review_provisional": F.col("review_provisional") & F.col("_e").isNull()}).drop("_k", "_e")
