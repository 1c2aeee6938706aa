"""Whose product a comment praises, as Columns.

Brand names in a comment are first replaced by one private character per brand; which brand a
comparison favours is then a matter of patterns over those characters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import let

# Brands and their names, comparison words, praise.
BRANDS = {
    "7-11": ["7-11", "711", "7-eleven", "小7", "小七", "seven", "統一超"],
    "全家": ["全家", "FamilyMart", "family mart", "Fami!ce", "fami"],
    "萊爾富": ["萊爾富", "Hi-Life", "hilife"],
    "OK": ["OK超商", "OKmart", "OK"],
    "美聯社": ["美聯社"],
}
COMPARISONS = ["比較", "比", "還是", "輸", "贏", "勝過", "不如", "屌打", "CP值", "cp值", "沒有", "沒"]
PRAISE = ["好", "好吃", "更好", "較好", "比較好", "比較好吃", "讚", "優", "香", "划算", "便宜", "高", "強", "勝", "贏", "屌打"]
AUTHORITATIVE = ["llm-backfill", "codex"]
OWN_FLOOR = 0.4

OTHER = "其他"
_MARK = {b: chr(0xE000 + i) for i, b in enumerate(BRANDS)}
_ANY = "[-]"
_NONE = "[^-]"
_GOOD = "(?:" + "|".join(sorted(map(re.escape, PRAISE), key=len, reverse=True)) + ")"


def brand_pattern(names: list[str]) -> str:
    """Any of the names; one of Latin letters or digits must not run on into other letters, but may touch Han characters."""
    wordy = r"[\p{L}\p{M}\p{N}\p{Pc}&&[^\p{IsHan}]]"
    parts = [rf"(?<!{wordy}){re.escape(n)}(?!{wordy})" if n.isascii() else re.escape(n) for n in sorted(names, key=len, reverse=True)]
    return "(?iu)(?:" + "|".join(parts) + ")"


def infer_brand(*texts: Column) -> Column:
    """The first brand, in order, that the first text naming any names; others are 其他."""
    found = [F.when(t.rlike(brand_pattern(names)), b) for t in texts for b, names in BRANDS.items()]
    return F.coalesce(*found, F.lit(OTHER))


def marked(text: Column) -> Column:
    """The text with a brand's private character in place of each of its names. Give it NFKC text."""
    for brand, names in BRANDS.items():
        text = F.regexp_replace(text, brand_pattern(names), _MARK[brand])
    return text


def _brand_of(char: Column) -> Column:
    out = None
    for b, c in _MARK.items():
        out = F.when(char == c, b) if out is None else out.when(char == c, b)
    return out


def mentioned(text: Column) -> Column:
    """Brands a marked text names, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.contains(c), F.lit(b)) for b, c in _MARK.items()])))


def _first(text: Column, pattern: str) -> Column:
    return _brand_of(F.regexp_extract(text, "(?s)" + pattern, 1))


def favoured(text: Column, own: Column) -> Column:
    """The brand that a marked comparison favours; null if it doesn't say."""
    near_good = f"(?=.{{0,12}}{_GOOD})"
    after = f".{{0,12}}?({_ANY})"
    compared = F.when(text.rlike(f"(?s)比(?!較){near_good}{after}"), F.coalesce(_first(text, f"({_ANY}){_NONE}{{0,12}}比(?!較)(?=.{{0,12}}{_ANY}){near_good}"), F.when(_first(text, f"比(?!較){near_good}{after}") != own, own)))
    rather = F.coalesce(_first(text, f"({_ANY}){_NONE}{{0,10}}(?:比較|較){near_good}"), _first(text, f"{_GOOD}{_NONE}{{0,12}}(?:比較|較){_NONE}{{0,10}}({_ANY})"))
    still = _first(text, f"(?:還是|還4){_NONE}{{0,12}}({_ANY})(?=.{{0,12}}{_GOOD})")
    lacks = _first(text, f"沒有?{_NONE}{{0,12}}({_ANY})(?=.{{0,12}}{_GOOD})")
    loses = _first(text, f"(?:輸|不如){_NONE}{{0,12}}({_ANY})")
    wins = F.coalesce(_first(text, f"({_ANY}){_NONE}{{0,12}}(?:贏|勝過|屌打|勝)"), F.when(text.rlike(f"(?s)(?:贏|勝過|屌打|勝){_NONE}{{0,12}}{_ANY}"), own))

    def at(distance: int) -> Column:
        gap = f"{_NONE}{{{distance}}}"
        before = F.regexp_extract_all(text, F.lit(f"(?s)({_ANY}){gap}{_GOOD}"), 1)
        behind = F.regexp_extract_all(text, F.lit(f"(?s){_GOOD}{gap}({_ANY})"), 1)
        return F.array_distinct(F.concat(before, behind))

    nearest = F.filter(F.array(*[at(d) for d in range(9)]), lambda x: F.size(x) > 0)
    close = F.when((F.size(nearest) > 0) & (F.size(F.get(nearest, F.lit(0))) == 1), _brand_of(F.get(F.get(nearest, F.lit(0)), F.lit(0))))
    return F.coalesce(compared, rather, still, lacks, loses, wins, close)


def attribution(own: Column, text: Column, sentiment: Column, backend: Column) -> Column:
    """include, sentiment, brands named, other_preferred, own_preferred. Give it NFKC text."""
    # Each step's value stands in the next once: the marked text is read by dozens of patterns, the verdict by each field.
    return let(marked(text), lambda t: let(F.filter(mentioned(t), lambda b: b != own), lambda others: _verdict(own, text, t, others, sentiment, backend)))


def _verdict(own: Column, text: Column, t: Column, others: Column, sentiment: Column, backend: Column) -> Column:
    tone = F.lower(text).rlike("|".join(re.escape(c.lower()) for c in COMPARISONS))
    # Who is favoured is asked only of a comparison with another brand.
    compared = F.when(F.size(others) > 0, tone).otherwise(F.lit(False))
    return let(F.struct(compared.alias("compared"), F.when(compared, F.coalesce(favoured(t, own) == own, F.lit(False))).otherwise(F.lit(False)).alias("own_wins")), lambda v: _fields(v["compared"], v["own_wins"], others, sentiment, backend))


def _fields(compared: Column, own_wins: Column, others: Column, sentiment: Column, backend: Column) -> Column:
    lifted = F.when(backend.isin(AUTHORITATIVE) & sentiment.isNotNull(), sentiment).otherwise(F.greatest(F.coalesce(sentiment, F.lit(0.0)), F.lit(OWN_FLOOR)))
    return F.struct(
        ((F.size(others) == 0) | own_wins).alias("include"), F.when(own_wins, lifted).otherwise(sentiment).alias("sentiment"), others.alias("brands"),
        (compared & ~own_wins).alias("other_preferred"), own_wins.alias("own_preferred"),
    )
