"""Text as Columns: normal forms, bigrams, cleaners, parsers, predicates."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .. import config as C


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def token(text: pd.Series) -> pd.Series:
    """NFKC and full case folding, trimmed."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold().strip())


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that stands in the expression, and is computed, once; also inside other lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def override_text(text: Column) -> Column:
    """The normal form of legacy label keys: no end marks. Give it NFKC text."""
    return F.trim(F.regexp_replace(squeeze(text), r"[!！?？。．.]+$", ""))


def bare(text: Column) -> Column:
    """Without white space and punctuation."""
    return F.regexp_replace(text, r"(?U)[\s\p{P}]", "")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a text of one character stands for itself."""
    chars = F.split(text, "")  # once, as reaching the n-th character of a string takes n steps
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.length(text) - 1), F.slice(chars, F.lit(2), F.length(text) - 1), lambda a, b: F.concat(a, b))
    return F.when(F.length(text) >= 2, F.array_distinct(pairs)).when(F.length(text) == 1, F.array(text)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def tag_prior(tag: Column) -> Column:
    tag = F.trim(tag)
    return F.when(tag.startswith("推"), 1.0).when(tag.startswith("噓"), -1.0).otherwise(0.0)


def push_count(text: Column) -> Column:
    """爆 is 100, XX is -10, Xn is -n and X alone -1, blank is 0; what is no number, and null, is null."""
    t = F.trim(text)
    number = lambda c: F.when(c.rlike("^[+-]?[0-9]+$"), c.try_cast("int"))
    return F.when(t == "", 0).when(t == "爆", 100).when(t == "XX", -10).when(t == "X", -1).when(t.startswith("X"), -number(F.substring(t, 2, 20))).otherwise(number(t))


def author_score(text: Column) -> Column:
    """An author's mark on 0..100: n/10, n/5, stars, or a plain number (up to 10 with 分 counts tenfold)."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    ten, five = F.regexp_extract(text, number + r"\s*/\s*10", 1), F.regexp_extract(text, number + r"\s*/\s*5", 1)
    stars = F.length(F.regexp_replace(text, "[^★⭐]", ""))
    plain = F.regexp_extract(text, number, 1).try_cast("double")
    value = (
        F.when(ten != "", ten.try_cast("double") * 10).when(five != "", five.try_cast("double") * 20).when(stars > 0, stars * 20.0)
        .when(plain.isNotNull(), F.when(plain.between(0, 10) & text.contains("分"), plain * 10).otherwise(plain))
    )
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def post_id(url: Column) -> Column:
    """The URL's last part without its ending, else a short digest."""
    base = F.regexp_extract(url, r"/([^/?#]+?)(?:\.html?)?(?:[?#].*)?$", 1)
    return F.when(base != "", base).otherwise(F.concat(F.lit("local-"), F.substring(F.sha1(F.coalesce(url, F.lit(""))), 1, 12)))


def comment_time(text: Column, posted_at: Column, year: int | None = None) -> Column:
    """A whole date, or month/day and a time in a post's year: the next or last year where that is more than 180 days off.

    Without a post's time the year is ``year``. A day that the year lacks is null.
    """
    t = F.trim(text)
    part = lambda k: F.regexp_extract(t, r"^([0-9]{1,2})/([0-9]{1,2})\s+([0-9]{1,2}):([0-9]{2})$", k).try_cast("int")
    at = lambda y: F.try_make_timestamp(y, part(1), part(2), part(3), part(4), F.lit(0))
    posted = posted_at.cast("timestamp")
    own = F.coalesce(F.year(posted), F.lit(year).cast("int"))
    same = at(own)
    off = (F.unix_seconds(same) - F.unix_seconds(posted)) / 86400
    whole = F.try_to_timestamp(F.when(t.rlike("^[0-9]{4}-"), t), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(whole, F.when(same.isNotNull(), F.when(off < -180, at(own + 1)).when(off > 180, at(own - 1)).otherwise(same)))


def board_time(text: Column) -> Column:
    """A thread's time, as ``Mon May 13 20:15:30 2024`` or ``2024-05-13 20:15:30``; null if neither."""
    bare_day = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}\s+", "")
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(bare_day, r"\s+", " "), F.lit("MMM d HH:mm:ss yyyy")), F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd HH:mm:ss")))


def field_map(body: Column) -> Column:
    """【key】value pairs of a form, a value up to the next key at a line's start; of repeated keys the later one counts."""
    pattern = F.lit(r"(?s)【\s*([^】\n]+?)\s*】\s*(.*?)(?=\n\s*【|\z)")
    text = F.regexp_replace(body, r"\r\n?", "\n")
    keys = F.transform(F.regexp_extract_all(text, pattern, 1), lambda k: F.regexp_replace(k, r"(?U)\s", ""))
    values = F.transform(F.regexp_extract_all(text, pattern, 2), lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", ""))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))


def allowed_url(url: Column, scheme: str, hosts: list[str], prefix: str) -> Column:
    """Scheme, host and path prefix all fit."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    inside = F.lit(False)
    for h in hosts:
        inside = inside | (host == h) | host.endswith("." + h)
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == scheme) & inside & path.startswith(prefix), F.lit(False))


def shill(text: Column) -> Column:
    """A word of paid praise, and none of the harmless contexts."""
    return text.rlike("|".join(C.SHILL_WORDS)) & ~text.rlike("|".join(C.SHILL_CONTEXTS))


# Remarks that say nothing about a product, and echoes of others' complaints.
OFF_TOPIC = "沒看到|買不到|找不到|缺貨|改名|停產|哪裡有|沒有賣|沒在賣|漲價|降價|調漲|區域限定|限定區|庫存|截圖|圖片|照片|拍照|陰影|謝謝.*分享|感謝.*分享|加碼分享"
ECHO = r"^\s*(原來|果然|難怪|所以)\S{0,8}(雷|難吃|踩雷|很差|好硬|份量.*少|縮水|貴)"
FIRST_HAND = "我|自己|吃過|喝過|買過|試過|昨天|今天|剛剛|剛|上次|之前|回購|不會再買"


def off_topic(text: Column) -> Column:
    return text.rlike(OFF_TOPIC)


def echo(text: Column) -> Column:
    """A reaction to the post's complaint, not an experience of one's own."""
    return text.rlike("(?U)" + ECHO) & ~text.rlike(FIRST_HAND)
