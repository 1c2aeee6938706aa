"""Snapshots of results: written without accounts, read with defaults for fields that older ones lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.publish import names_in
from .snapshots import Snapshots

REPORT_SCHEMA = """
brand string, product_name string, product_key string, fair_score double, consensus string, confidence string, n_eff double, score_std double, score_mean double, n_posts long, n_comments long,
n_eligible_comments long, n_unique_commenters long, score_weight_sum double, score_weighted_sum double, score_weight_square_sum double, positive_weight double, neutral_weight double, negative_weight double,
rep_positive array<string>, rep_negative array<string>, price int, category string, competitor_mention_count long, competitor_preference_count long, competitor_own_preference_count long,
competitor_brands array<string>, shill_ratio double, shill_flag boolean, latest_post_date timestamp, review_excerpt string, review_provisional boolean, post_urls array<string>, generated_at timestamp
"""
NO_TEXTS = "array<string>"
#: What a field that isn't there means; a review counts as provisional until it is known not to be.
DEFAULTS = {
    "product_key": "product_name", "consensus": "'資料不足'", "confidence": "'低'", "n_eff": "0D", "score_std": "0D", "score_mean": "0D", "n_posts": "0L", "n_comments": "0L", "n_eligible_comments": "n_comments", "n_unique_commenters": "n_comments",
    "score_weight_sum": "0D", "score_weighted_sum": "0D", "score_weight_square_sum": "0D", "positive_weight": "0D", "neutral_weight": "0D", "negative_weight": "0D", "rep_positive": "array()", "rep_negative": "array()",
    "competitor_mention_count": "0L", "competitor_preference_count": "0L", "competitor_own_preference_count": "0L", "competitor_brands": "array()", "shill_ratio": "0D", "shill_flag": "false", "review_excerpt": "''", "review_provisional": "true", "post_urls": "array()",
}


PROFILE_SCHEMA = "user_id string, source string, brand_stats map<string,struct<count:long,avg:double>>, lean_brand string, suspicion double, features map<string,double>, credibility double, total long"
PROFILE_DEFAULTS = {"source": "'PTT'", "brand_stats": "map()", "suspicion": "0D", "features": "map()", "credibility": "1D", "total": "0L"}


def write_results(reports: DataFrame, path: str, generated_at) -> int:
    """A new version of the results without contributors, stamped; a field that names accounts is an error. Readers see the version before until this one is whole."""
    out = reports.drop("contributors", "profiles")
    if bad := [n for n in names_in(out.schema) if n.split(".")[-1] in ("user", "contributors", "profiles") or n.split(".")[-1].startswith("suspicion_")]:
        raise ValueError(f"fields name accounts: {bad}")
    return Snapshots(out.sparkSession, path).write(out.withColumn("generated_at", F.lit(generated_at).cast("timestamp")), "json")


def _filled(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.coalesce(F.col(c), F.expr(d).cast(kinds[c])) for c, d in defaults.items()})


def read_results(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The reports of a version, the latest by default; None if there is none."""
    rows = Snapshots(spark, path).read(REPORT_SCHEMA, version, mode="FAILFAST")
    return None if rows is None else _filled(rows, DEFAULTS)


def results_or_none(spark: SparkSession, path: str | None) -> DataFrame | None:
    return read_results(spark, path) if path else None


def write_profiles(profiles: DataFrame, path: str) -> int:
    """Account profiles, for internal use alone: never beside what is published."""
    return Snapshots(profiles.sparkSession, path).write(profiles, "json")


def read_profiles(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """Profiles with what older versions lack filled in: an account nothing is known of is trusted."""
    rows = Snapshots(spark, path).read(PROFILE_SCHEMA, version, mode="FAILFAST")
    return None if rows is None else _filled(rows, PROFILE_DEFAULTS)


def brand_choices(reports: DataFrame | None, every: str = "全部") -> list[str]:
    """What the choice of brands offers: all of them first, then each brand, most products first. A brand is an entry of a small fixed list."""
    from ..operators.shelf import brand_summary

    return [every] if reports is None else [every, *(r["brand"] for r in brand_summary(reports).collect())]
