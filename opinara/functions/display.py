"""What the shelf shows of a product, as Columns: labels, tones, dates, freshness."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import config as C

# Groups of categories, brands in order, volume levels.
CATEGORY_GROUPS = {"正餐": ["便當", "鹹食", "泡麵"], "甜點": ["甜點"], "冰品": ["冰品"], "飲料": ["飲料", "乳品"], "麵包": ["麵包"], "零食": ["零食"], "其他": ["其他", "周邊"]}
SHOWN_BRANDS = ["7-11", "全家", "萊爾富", "OK", "美聯社", "其他"]
VOLUME = {"高": "充足", "中": "中等", "低": "不足"}
VOLUME_PERCENT = {"充足": 78, "中等": 52}
STALE_DAYS = 14
OTHER = "其他"


def by_value(value: Column, table: dict, rest=None) -> Column:
    """A lookup in a small table of constants."""
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out if rest is None else out.otherwise(F.lit(rest))


def display_brand(brand: Column) -> Column:
    return F.when(brand.isin(SHOWN_BRANDS), brand).otherwise(OTHER)


def brand_rank(brand: Column) -> Column:
    """The place of a brand in the shelf's order, unknown ones last."""
    return by_value(display_brand(brand), {b: i for i, b in enumerate(SHOWN_BRANDS)}, len(SHOWN_BRANDS))


def display_category(category: Column) -> Column:
    """The shelf's group of a category; blank and unknown ones are 其他."""
    return by_value(F.trim(F.coalesce(category, F.lit(""))), {c: g for g, cs in CATEGORY_GROUPS.items() for c in cs}, OTHER)


def volume_level(confidence: Column, consensus: Column, n_posts: Column) -> Column:
    """充足, 中等 or 不足: 不足 without enough data, and one thread alone is never 充足."""
    tier = by_value(confidence, VOLUME, "不足")
    return F.when(consensus == C.INSUFFICIENT, "不足").when((n_posts < 2) & (tier == "充足"), "中等").otherwise(tier)


def volume_percent(level: Column) -> Column:
    return by_value(level, VOLUME_PERCENT, 28)


def consensus_tone(consensus: Column) -> Column:
    return F.when(consensus == C.PRAISED, "good").when(consensus.isin(C.POLARISED, C.MIXED), "mixed").otherwise("low")


def score_tone(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 70, "high").when(score >= 50, "middle").otherwise("low")


def sentiment_segments(confidence: Column, positive: Column, neutral: Column, negative: Column) -> Column:
    """Whole shares of the three polarities; empty with low confidence or nothing to show."""
    values = [F.coalesce(x, F.lit(0)) for x in (positive, neutral, negative)]
    total = values[0] + values[1] + values[2]
    shares = F.array(*[F.struct(F.lit(n).alias("label"), F.greatest(F.lit(0), F.floor(v / total * 100 + 0.5)).cast("int").alias("value")) for n, v in zip(("正評", "中立", "負評"), values, strict=True)])
    return F.when((confidence != "低") & (total > 0), shares).otherwise(F.array().cast("array<struct<label:string,value:int>>"))


def display_confidence(confidence: Column, n_posts: Column) -> Column:
    """One thread alone is never 高."""
    return F.when((n_posts < 2) & (confidence == "高"), "中").otherwise(confidence)


def evidence_note(confidence: Column, consensus: Column) -> Column:
    return F.when((confidence == "低") | (consensus == C.INSUFFICIENT), "資料仍少，排名已降權，請保守解讀").when(confidence == "中", "樣本量中等，可作為初步參考").otherwise("樣本量較充足")


def competitor_line(mentions: Column, other_preferred: Column, brands: Column) -> Column:
    """A line on competitors; empty where none is mentioned."""
    named = F.when(F.size(brands) > 0, F.array_join(brands, "、")).otherwise("未辨識")
    return F.when(mentions > 0, F.format_string("競品提及: %d 則，其中 %d 則偏好他牌；競品: %s", mentions, other_preferred, named)).otherwise("")


def age_days(at: Column, now: Column) -> Column:
    """Days, with fractions, since a time; null if it is unknown."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400e6)


def is_stale(at: Column, now: Column, days: float = STALE_DAYS) -> Column:
    return F.coalesce(age_days(at, now) > days, F.lit(False))


def display_date(at: Column) -> Column:
    """The day in Taipei of a UTC time, as 2024/05/13."""
    return F.date_format(F.from_utc_timestamp(at.cast("timestamp"), "Asia/Taipei"), "yyyy/MM/dd")


def date_offset(day: Column, first: Column) -> Column:
    return F.datediff(day.cast("date"), first.cast("date"))


def offset_date(offset: Column, first: Column) -> Column:
    return F.date_add(first.cast("date"), offset)


def normal_range(start: Column, end: Column, first: Column, last: Column) -> Column:
    """A struct of bounds, both empty where they hold everything anyway."""
    whole = (start == first) & (end == last)
    return F.struct(F.when(whole, "").otherwise(start).alias("from_date"), F.when(whole, "").otherwise(end).alias("to_date"))


def preset_start(preset: Column, today: Column) -> Column:
    """The first day of a preset range (1w, 2w, 1m or 3m) up to today; null for all."""
    day = today.cast("date")
    return F.when(preset == "1w", F.date_sub(day, 7)).when(preset == "2w", F.date_sub(day, 14)).when(preset == "1m", F.add_months(day, -1)).when(preset == "3m", F.add_months(day, -3))
