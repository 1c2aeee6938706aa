"""Cells of label files as Columns: normal labels, candidate lists, indices, rewrites. Bad cells are null, or errors where ``strict``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .display import by_value

# The forms a label may have.
SENTIMENTS = {"正": "positive", "正向": "positive", "positive": "positive", "pos": "positive", "+": "positive", "負": "negative", "負向": "negative", "negative": "negative", "neg": "negative", "-": "negative", "中": "neutral", "中性": "neutral", "neutral": "neutral", "neu": "neutral", "0": "neutral"}
BOOLEANS = {"是": True, "true": True, "t": True, "yes": True, "y": True, "1": True, "否": False, "false": False, "f": False, "no": False, "n": False, "0": False}
FAVOURED = {"本牌": "own", "own": "own", "post": "own", "他牌": "other", "競品": "other", "other": "other", "competitor": "other", "平手": "tie", "差不多": "tie", "tie": "tie", "draw": "tie", "不明": "unknown", "未知": "unknown", "無": "unknown", "none": "unknown", "unknown": "unknown", "": "unknown"}
REWRITES = "array<struct<source_index:int,text:string>>"


def _label(value: Column, table: dict, what: str, strict: bool) -> Column:
    t = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    got = by_value(t, table)
    return F.when(got.isNull(), F.raise_error(F.concat(F.lit(f"unknown {what}: "), t)).cast("string")).otherwise(got.cast("string")) if strict else got


def sentiment_label(value: Column, strict: bool = True) -> Column:
    return _label(value, SENTIMENTS, "sentiment label", strict)


def boolean_label(value: Column, strict: bool = True) -> Column:
    return _label(value, BOOLEANS, "boolean label", strict).cast("boolean")


def favoured_label(value: Column, strict: bool = True) -> Column:
    return _label(value, FAVOURED, "favoured brand", strict)


def target_label(value: Column) -> Column:
    """own, other or none; what isn't known names another brand."""
    t = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(t.isin("本牌", "own", "post"), "own").when(t.isin("無", "none", "unknown", ""), "none").otherwise("other")


def numbered(candidates: Column) -> Column:
    """``0. text`` lines of a list of candidates."""
    return F.array_join(F.transform(candidates, lambda c, i: F.concat(i.cast("string"), F.lit(". "), c)), "\n")


def parse_numbered(cell: Column) -> Column:
    """The candidates of ``0. text`` lines, numbered without gaps; null if the cell is malformed."""
    text = F.coalesce(cell, F.lit(""))
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n"))
    good = F.transform(lines, lambda line, i: F.regexp_extract(line, r"^\s*([0-9]+)\.\s+(.+)$", 1) == i.cast("string"))
    return F.when(F.forall(good, lambda g: g), F.transform(lines, lambda line: F.regexp_extract(line, r"^\s*[0-9]+\.\s+(.+)$", 1)))


def parse_indices(cell: Column, most: int = 3) -> Column:
    """``1|3`` as distinct indices, at most ``most``; blank has none; null if malformed."""
    text = F.coalesce(cell, F.lit(""))
    parts = F.transform(F.split(text, r"\|"), lambda p: F.when(p.rlike("^[+]?[0-9]+$"), p.try_cast("int")))
    good = F.forall(parts, lambda p: p.isNotNull()) & (F.size(parts) <= most) & (F.size(F.array_distinct(parts)) == F.size(parts))
    return F.when(F.trim(text) == "", F.array().cast("array<int>")).when(F.coalesce(good, F.lit(False)), parts)


def parse_rewrites(cell: Column, most: int = 3) -> Column:
    """A JSON list of {source_index, text} and nothing else, with distinct indices from 0 on; blank has none; null if malformed."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    items = F.from_json(text, "array<map<string,string>>")
    exact = F.forall(items, lambda m: (F.array_sort(F.map_keys(m)) == F.array(F.lit("source_index"), F.lit("text"))) & m["source_index"].rlike("^[0-9]+$") & m["text"].isNotNull())
    # A number has no quotes around it, and a text has.
    quoted = text.rlike(r'"source_index"\s*:\s*"') | text.rlike(r'"text"\s*:\s*[^"\s]')
    parsed = F.from_json(text, REWRITES)
    indices = F.transform(parsed, lambda r: r["source_index"])
    good = text.startswith("[") & exact & ~quoted & (F.size(items) <= most) & (F.size(F.array_distinct(indices)) == F.size(indices))
    return F.when(text == "", F.array().cast(REWRITES)).when(F.coalesce(good, F.lit(False)), parsed)


def width_garbage(text: Column) -> Column:
    """Half-width kana or Hangul, or full-width Latin letters or digits."""
    return text.rlike(r"[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF61}-\x{FFDC}\x{FFE8}-\x{FFEE}]")
