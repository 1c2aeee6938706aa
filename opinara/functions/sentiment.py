"""Lexicon sentiment as a Column: every hit weighs its word, negation and intensifier."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import config as C
from .text import tag_prior

# The lexicon.
POSITIVE = {"好吃": 1.0, "好喝": 1.0, "喜歡": 0.8, "推薦": 0.9, "回購": 1.0, "香": 0.6, "濃": 0.5, "脆": 0.4, "嫩": 0.6, "划算": 0.7, "不錯": 0.6, "可以": 0.3, "讚": 0.9, "優": 0.7, "滿意": 0.8}
NEGATIVE = {"難吃": -1.0, "難喝": -1.0, "失望": -0.8, "不推": -0.9, "雷": -0.9, "踩雷": -1.0, "乾": -0.5, "膩": -0.6, "油": -0.4, "鹹": -0.5, "貴": -0.5, "空虛": -0.7, "普通": -0.2, "沒味道": -0.7, "糟": -0.9}
NEGATIONS = ["不", "沒", "無", "沒有", "別"]
INTENSIFIERS = {"超": 1.3, "很": 1.2, "蠻": 1.1, "有點": 0.8, "稍微": 0.7, "太": 1.2}
COMPOUNDS = {
    "乾": ["餅乾", "肉乾", "豆乾", "果乾", "乾麵", "乾拌"], "油": ["麻油", "奶油", "醬油", "油雞", "油飯", "油條", "油蔥", "油漆"],
    "香": ["香草", "香蕉", "香菇", "香腸", "香料", "香檳", "香芋", "香菜"], "鹹": ["鹹酥雞", "鹹水雞", "鹹蛋", "鹹食"], "濃": ["濃湯"], "雷": ["打雷", "雷神"], "貴": ["貴妃"],
}


def _clamp(x) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def text_score(text: Column) -> Column:
    """Mean of the hits in -1..1; 0 without one. A hit inside a compound noun is none."""
    text = F.trim(F.coalesce(text, F.lit("")))
    lexicon = F.array(*[
        F.struct(F.lit(w).alias("word"), F.lit(v).alias("value"), F.array(*[F.struct(F.lit(c).alias("all"), F.lit(c.index(w)).alias("at")) for c in COMPOUNDS.get(w, [])]).cast("array<struct<all:string,at:int>>").alias("inside"))
        for w, v in {**POSITIVE, **NEGATIVE}.items()
    ])
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))

    def weigh(entry, p):
        before = F.substring(text, F.greatest(F.lit(1), p - 4), F.least(F.lit(4), p - 1))
        sign = F.when(before.rlike("|".join(NEGATIONS)), -1.0).otherwise(1.0)
        louder = F.greatest(F.lit(1.0), *[F.when(before.contains(k), f).otherwise(1.0) for k, f in INTENSIFIERS.items()])
        return _clamp(entry["value"] * sign * louder)

    def hits(entry):
        here = F.filter(places, lambda p: (F.substring(text, p, F.length(entry["word"])) == entry["word"]) & ~F.exists(entry["inside"], lambda c: (p - c["at"] >= 1) & (F.substring(text, p - c["at"], F.length(c["all"])) == c["all"])))
        return F.transform(here, lambda p: weigh(entry, p))

    # Only words that stand in the text at all are looked for place by place.
    found = F.flatten(F.transform(F.filter(lexicon, lambda e: F.contains(text, e["word"])), hits))
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(found) > 0, _clamp(total / F.size(found))).otherwise(0.0)


def comment_score(tag: Column, text: Column) -> Column:
    return F.round(_clamp(C.TAG_PRIOR_WEIGHT * tag_prior(tag) + (1 - C.TAG_PRIOR_WEIGHT) * text_score(text)), 4)
