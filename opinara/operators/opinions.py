"""Opinions: decay weights, one vote per human, fair scores, consensus and ranking.

An opinions frame has product, user, role, score (0 to 1), weight and ord (a total order for ties).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C


def decay_weight(posted_at, as_of, rate: float = C.TIME_DECAY) -> Column:
    """exp(-rate * days), 1 without a date or with a rate of 0; the future counts as today."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(F.to_timestamp_ltz(as_of)) - F.unix_micros(F.to_timestamp_ltz(posted_at))) / F.lit(86_400e6))
    return F.coalesce(F.exp(-F.lit(rate) * days), F.lit(1.0)) if rate > 0 else F.lit(1.0)


def one_vote(opinions: DataFrame) -> DataFrame:
    """One row per product and user: weighted stance, mean weight, role of the heaviest opinion (the first of equal ones)."""
    heavy = F.struct(-F.col("weight"), F.col("ord"), F.col("role"))
    return opinions.groupBy("product", "user").agg(
        F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.when(F.sum("weight") > 0, F.sum("weight"))), F.avg("score")).alias("stance"),
        F.avg("weight").alias("weight"),
        F.min_by("role", heavy).alias("role"),
    )


def consensus(mean, std, n_eff) -> Column:
    return (
        F.when(n_eff < C.N_EFF_MIN, C.INSUFFICIENT).when(std >= C.HIGH_STD, C.POLARISED)
        .when((mean >= C.HIGH_MEAN) & (std <= C.LOW_STD), C.PRAISED).when((mean <= C.LOW_MEAN) & (std <= C.LOW_STD), C.PANNED).otherwise(C.MIXED)
    )


def confidence(n_eff) -> Column:
    out = None
    for limit, name in C.CONFIDENCE_BANDS:
        out = F.when(n_eff < limit, name) if out is None else out.when(n_eff < limit, name)
    return out.otherwise("高")


def product_moments(votes: DataFrame, penalised: DataFrame | None = None) -> DataFrame:
    """Sums per product. ``penalised``: products (product) whose votes count for less."""
    if penalised is not None:
        flags = penalised.select("product").distinct().withColumn("penalty", F.lit(C.SHILL_PENALTY))
        votes = votes.join(flags, "product", "left").withColumn("weight", F.col("weight") * F.coalesce("penalty", F.lit(1.0)))
    w, s = F.col("weight"), F.col("stance")
    return votes.groupBy("product").agg(
        F.count("*").alias("n_votes"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * s).alias("sws"), F.sum(w * s * s).alias("swss"),
        F.sum(F.when(s > 0.6, w).otherwise(0.0)).alias("positive_weight"), F.sum(F.when(s.between(0.4, 0.6), w).otherwise(0.0)).alias("neutral_weight"), F.sum(F.when(s < 0.4, w).otherwise(0.0)).alias("negative_weight"),
    )


def fair_scores(moments: DataFrame) -> DataFrame:
    """fair_score (shrunk to the prior), weighted mean and deviation, effective number, consensus and confidence."""
    mean = F.coalesce(F.try_divide(F.col("sws"), F.col("sw")), F.lit(0.0))
    std = F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("swss"), F.col("sw")), F.lit(0.0)) - mean * mean))
    n_eff = F.coalesce(F.try_divide(F.col("sw") * F.col("sw"), F.col("sww")), F.lit(0.0))
    fair = 100 * (C.PRIOR_STRENGTH * C.PRIOR_MEAN + F.col("sws")) / (C.PRIOR_STRENGTH + F.col("sw"))
    full = moments.withColumns({"_mean": mean, "_std": std, "_n_eff": n_eff})
    return full.withColumns(
        {
            "fair_score": F.round(F.when(F.col("n_votes") > 0, fair), 1), "score_mean": F.round("_mean", 4), "score_std": F.round("_std", 3), "n_eff": F.round("_n_eff", 2),
            "consensus": consensus(F.col("_mean"), F.col("_std"), F.col("_n_eff")), "confidence": confidence(F.col("_n_eff")),
        }
    ).drop("_mean", "_std", "_n_eff")


def report_order() -> list[Column]:
    """Scored products first, then those of enough evidence, then by score; the product breaks ties."""
    weak = (F.col("confidence") == "低") | (F.col("consensus") == C.INSUFFICIENT)
    return [F.col("fair_score").isNull().asc(), weak.asc(), F.col("fair_score").desc_nulls_last(), F.col("product").asc()]


def filter_reports(reports: DataFrame, min_score=None, min_n_eff=None, min_votes=None, limit=None, min_posts=None, min_comments=None) -> DataFrame:
    """HAVING over reports; a null score fails ``min_score``. Negative bounds are errors."""
    for name, value in (("min_score", min_score), ("min_n_eff", min_n_eff), ("min_votes", min_votes), ("limit", limit), ("min_posts", min_posts), ("min_comments", min_comments)):
        if value is not None and value < 0:
            raise ValueError(f"{name} is negative: {value}")
    for column, least in (("fair_score", min_score), ("n_eff", min_n_eff), ("n_votes", min_votes), ("n_posts", min_posts), ("n_comments", min_comments)):
        if least is not None:
            reports = reports.where(F.col(column) >= least)
    return reports.orderBy(*report_order()).limit(limit) if limit is not None else reports


def percent_split(positive, neutral, negative) -> list[Column]:
    """Whole percentages that add up to 100, the largest remainders rounded up; null where nothing weighs."""
    total = F.nullif(positive + neutral + negative, F.lit(0.0))
    exact = [100 * x / total for x in (positive, neutral, negative)]
    floor = [F.floor(F.round(x, 9)) for x in exact]
    rest = [F.round(x - f, 9) for x, f in zip(exact, floor, strict=True)]
    left = 100 - (floor[0] + floor[1] + floor[2])
    out = []
    for i in range(3):
        ahead = sum(((rest[j] >= rest[i]) if j < i else (rest[j] > rest[i])).cast("int") for j in range(3) if j != i)
        out.append((floor[i] + (ahead < left).cast("int")).cast("long"))
    return out


def recommendation(fair_score, confident) -> Column:
    """20..80 stretched to 0..100, half to even; null without confidence."""
    return F.when(confident, F.bround((F.least(F.greatest(fair_score, F.lit(20.0)), F.lit(80.0)) - 20) * 100 / 60, 0).cast("long"))
