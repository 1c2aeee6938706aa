"""Accounts: profiles per user and brand, suspicion features, bursts, templates, run merging.

An activity frame has user_id, brand, sentiment (-1 to 1), ts event_id (a total order) and, for suspicion, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from ..functions import text as TX
from .similar import packed_pairs, similar_texts
from .store import pinned


def brand_stats(activity: DataFrame) -> DataFrame:
    """Per user and brand: count, mean sentiment and the first event."""
    return activity.groupBy("user_id", "brand").agg(F.count("*").alias("n"), F.avg("sentiment").alias("mean"), F.min(F.struct("ts", "event_id")).alias("first"))


def profiles(stats: DataFrame) -> DataFrame:
    """Per user: brand map, total, the brand liked best (the first seen of equal ones)."""
    best = F.struct(F.col("mean"), -F.unix_micros(F.to_timestamp_ltz("first.ts")), -F.col("first.event_id"))
    entries = F.array_sort(F.collect_list(F.struct("brand", F.struct(F.col("n").alias("count"), F.round("mean", 4).alias("avg")).alias("stat"))))
    return stats.groupBy("user_id").agg(F.sum("n").alias("total"), F.count("*").alias("n_brands"), F.max_by("brand", best).alias("lean_brand"), F.map_from_entries(entries).alias("brand_stats"))


def burst_flags(activity: DataFrame, keys: tuple[str, ...] = ("user_id", "brand"), hours: int = C.BURST_HOURS, least: int = C.BURST_COUNT) -> DataFrame:
    """Rows covered by some window of ``hours`` from an event on (inclusive) with ``least`` events or more.

    A window is full if the event ``least - 1`` places on lies within it; a row is covered if the last such start before it is near enough.
    Both frames run forward only, so an account of any size takes one pass.
    """
    span = hours * 3_600_000_000
    ordered = Window.partitionBy(*keys).orderBy("_at")
    rows = activity.withColumn("_at", F.unix_micros(F.to_timestamp_ltz("ts")))
    rows = rows.withColumn("_start", F.when(F.lead("_at", least - 1).over(ordered) - F.col("_at") <= span, F.col("_at")))
    near = F.col("_at") - F.max("_start").over(ordered.rangeBetween(Window.unboundedPreceding, 0)) <= span
    return rows.withColumn("burst", F.coalesce(near, F.lit(False))).drop("_at", "_start")


def alike_texts(activity: DataFrame, least: int = 3) -> DataFrame:
    """user_id, text_id, n, flagged: an account's texts of more than three characters, each once with its number, and whether another equals it or nearly so.

    Accounts of fewer than ``least`` such texts have none flagged. ``text_key`` gives a row's text_id.
    """
    bare = TX.bare(F.coalesce("text", F.lit("")))
    texts = activity.select("user_id", bare.alias("t")).where(F.length("t") > 3).groupBy("user_id", "t").agg(F.count("*").alias("n"))
    # Pairs of characters are made and written once; rows go by a digest, not by their text.
    keyed = pinned(texts.select("user_id", "n", F.xxhash64("user_id", "t").alias("text_id"), packed_pairs(F.col("t")).alias("s")))
    enough = keyed.groupBy("user_id").agg(F.sum("n").alias("_total"), F.count("*").alias("_kinds")).where(F.col("_total") >= least)
    # Only accounts of two different texts or more have pairs to look for.
    several = keyed.join(enough.where("_kinds > 1").select("user_id"), "user_id", "left_semi")
    partner = similar_texts(several, "user_id", "text_id", "s", C.TEMPLATE_SIMILARITY, pairs=False).select(F.col("id").alias("text_id"), F.lit(True).alias("_hit"))
    found = keyed.drop("s").join(enough.select("user_id", F.lit(True).alias("_enough")), "user_id", "left").join(partner, "text_id", "left")
    flagged = F.coalesce(F.col("_enough") & ((F.col("n") > 1) | F.coalesce("_hit", F.lit(False))), F.lit(False))
    return found.select("user_id", "text_id", "n", flagged.alias("flagged"), F.coalesce("_enough", F.lit(False)).alias("enough"))


def text_key(user: Column, text: Column) -> Column:
    return F.xxhash64(user, TX.bare(F.coalesce(text, F.lit(""))))


def template_ratio(activity: DataFrame, least: int = 3) -> DataFrame:
    """user_id, template_like: the share of an account's texts, of those with more than three characters, that equal another of its texts or nearly so.

    Equal texts are folded first; 0 for accounts of fewer than ``least`` such texts.
    """
    return alike_texts(activity, least).groupBy("user_id").agg((F.sum(F.when(F.col("flagged"), F.col("n")).otherwise(0)) / F.sum("n")).alias("template_like"))


def template_flags(activity: DataFrame, least: int = 3) -> DataFrame:
    """The rows with ``template``: whether another of the account's texts equals theirs or nearly so."""
    found = alike_texts(activity, least).where("flagged").select(F.col("text_id").alias("_t"), F.lit(True).alias("_hit"))
    rows = activity.withColumn("_key", F.when(F.length(TX.bare(F.coalesce("text", F.lit("")))) > 3, text_key(F.col("user_id"), F.col("text"))))
    return rows.join(found, F.col("_key") == F.col("_t"), "left").withColumn("template", F.coalesce("_hit", F.lit(False))).drop("_key", "_t", "_hit")


def round_exact(value, digits: int = 4):
    """Half up on the decimal value, so that ties do not turn on the noise of binary fractions."""
    return F.round(value.cast("decimal(20,12)"), digits).cast("double")


def suspicion(activity: DataFrame) -> DataFrame:
    """Features, suspicion score and credibility per user; accounts of little activity are above suspicion. The activity has texts, too."""
    per_brand = burst_flags(activity).groupBy("user_id", "brand").agg(
        F.count("*").alias("n"), F.avg("sentiment").alias("mean"), F.count_if(F.abs("sentiment") >= C.EXTREME).alias("extreme"), F.count_if("burst").alias("burst")
    )
    total = F.sum("n")
    users = per_brand.groupBy("user_id").agg(
        total.alias("total"), (F.max("n") / total).alias("single_brand"), F.max("mean").alias("best"), F.sum("mean").alias("sum_means"), F.count("*").alias("brands"),
        (F.sum("extreme") / total).alias("extreme"), (F.sum("burst") / total).alias("burst"),
    )
    others = F.coalesce(F.try_divide(F.col("sum_means") - F.col("best"), F.col("brands") - 1), F.lit(0.0))
    one_sided = F.least(F.lit(1.0), (F.greatest(F.lit(0.0), F.col("best")) + F.abs(F.least(F.lit(0.0), others))) / 2)
    out = users.join(template_ratio(activity), "user_id", "left").withColumns({"one_sided": one_sided, "template_like": F.coalesce("template_like", F.lit(0.0))})
    active = F.col("total") >= C.MIN_ACTIVITY
    out = out.select("user_id", "total", *[F.when(active, round_exact(F.col(n))).otherwise(0.0).alias(n) for n in C.SUSPICION_WEIGHTS])
    score = sum((F.lit(w) * F.col(n) for n, w in C.SUSPICION_WEIGHTS.items()), F.lit(0.0))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return out.withColumn("suspicion", round_exact(score)).withColumn("credibility", F.round(F.greatest(F.lit(C.WEIGHT_FLOOR), 1 - F.col("suspicion")), 4))


def merge_runs(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], who: str, tag: str, text: str, at: str | None = None, pause_hours: float | None = None) -> DataFrame:
    """Consecutive rows of one speaker become one: texts joined, the first tag that is no arrow, the first row's place. A pause in ``at`` longer than ``pause_hours`` parts a run, too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((F.lag(who).over(w) != F.col(who)).cast("int"), F.lit(1))
    if pause_hours is not None:
        micros = F.unix_micros(F.to_timestamp_ltz(at))
        new = F.when(micros - F.lag(micros).over(w) > int(pause_hours * 3_600_000_000), 1).otherwise(new)
    rows = rows.withColumn("_run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(*order)
    return rows.groupBy(*keys, "_run", who).agg(
        F.count("*").alias("n_merged"), F.min(place).alias("first"), F.min_by(tag, F.struct((F.col(tag) == "→").alias("arrow"), place.alias("at"))).alias(tag),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.coalesce(text, F.lit("")).alias("text")))), lambda x: x["text"]), "").alias(text),
    )
