"""Cleaners of names, authors, links and remarks, and small lookups, as Columns. Give them NFKC text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .attribution import BRANDS, OTHER
from .text import squeeze, token

# Links, which end where Han text begins; remarks of a board's staff; asides on prices and gifts in brackets.
LINK = r"(?i)(?:https?://|www\.)[^\s　-〿一-鿿＀-￯]+"
STAFF = r"(?:板務|版務|公告|置底|板規|版規|推文標記)"
PROMO_ASIDE = r"(?i)價|折|券|贈|送|兌換|集章|優惠|特價|原價|嚐鮮|友善|珍食|限定|活動|搭配|跨店|任選|第[二三四五六七八九十0-9]+件|買[0-9]|coupon|促"
REPRESENTATIVES = 3


def clean_author(raw: Column) -> Column:
    """An account's name without the nickname in brackets."""
    return F.trim(F.regexp_replace(raw, r"\s*\(.*?\)\s*$", ""))


def title_name(title: Column) -> Column:
    """A title without its reply mark and the product tag."""
    return F.trim(F.regexp_replace(title, r"(?i)^\s*(?:Re:\s*)?[\[［]商品[\]］]\s*", ""))


def is_product_title(title: Column) -> Column:
    return title.contains("[商品]") | title.contains("［商品］")


def absolute_url(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(href, F.lit("/"))))


def review_after_score(raw: Column) -> Column:
    """What follows a mark in its field, without the note on marks below 60."""
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r\n?", "\n"))
    text = F.regexp_replace(text, r"^\s*[:：]?\s*(?:[0-9]+(?:\.[0-9]+)?(?:\s*/\s*(?:5|10|100))?\s*(?:分)?|[★⭐]+)", "")
    return F.regexp_replace(F.regexp_replace(text, r"^\s*[（(]?\s*未滿\s*60\s*分為不推薦\s*[）)]?\s*", ""), r"(?U)^\s+|\s+$", "")


def raw_name(text: Column) -> Column:
    """The normal form of a form's product field: single spaces, no colons in front."""
    return F.trim(F.regexp_replace(squeeze(F.coalesce(text, F.lit(""))), "^[：:]+", ""))


def unwrap_brackets(text: Column) -> Column:
    """Square brackets go with what they hold; round ones leave a qualifier of up to four letters, if it tells no price or promotion."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[【].*?[\]】]", " ")
    qualifier = rf"(?U)[\(（](?!(?:[^\)）]*(?:{PROMO_ASIDE[4:]})))\s*([\w&&[^0-9]]{{1,4}})\s*[\)）]"
    return F.regexp_replace(F.regexp_replace(text, qualifier, " $1 "), r"[\(（].*?[\)）]", " ")


def strip_links(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, LINK, " "))


def clean_representatives(texts: Column, most: int = REPRESENTATIVES) -> Column:
    """Without links, blanks and repeats, the first few in order."""
    return F.slice(F.array_distinct(F.filter(F.transform(texts, strip_links), lambda x: x != "")), 1, most)


def representative_comment(text: Column, brand: Column) -> Column:
    """Without links, a brand's name as a label in front, brackets and marks at the edges."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), LINK, " "))
    names = {b: "|".join(sorted({rf"\Q{n}\E" for n in (b, *ns)}, key=len, reverse=True)) for b, ns in BRANDS.items()}
    label = None
    for b, either in names.items():
        pattern = F.lit(rf"(?i)^(?:{either})(?=[\s:：])[\s:：]*")
        label = F.when(brand == b, pattern) if label is None else label.when(brand == b, pattern)
    s = F.regexp_replace(s, label.otherwise(F.lit("(?!)")), F.lit(""))
    s = squeeze(F.regexp_replace(s, r"[\[(（【].*?[\])）】]", " "))
    edge = r"[\s:：,，.。!！?？~～\-]+"
    return F.trim(F.regexp_replace(s, f"^{edge}|{edge}$", ""))


def structural_noise(text: Column) -> Column:
    """Nothing but signs, or a remark of the board's staff."""
    plain = F.regexp_replace(text, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]", "")
    return ~plain.rlike(r"[\x{3400}-\x{9fff}A-Za-z0-9]") | text.rlike(f"^{STAFF}$")


@F.pandas_udf(T.StringType())
def matched_parentheses(text: pd.Series) -> pd.Series:
    """Without parentheses that have no partner."""

    def clean(t):
        if t is None:
            return None
        open_at, drop = [], set()
        for i, c in enumerate(t):
            if c == "(":
                open_at.append(i)
            elif c == ")" and not open_at:
                drop.add(i)
            elif c == ")":
                open_at.pop()
        drop.update(open_at)
        return "".join(c for i, c in enumerate(t) if i not in drop)

    return text.map(clean)


def render_sentences(sentences: Column) -> Column:
    """Sentences of an excerpt in a row, each with one full stop."""
    edge = "[。！？!?；; ，]+"
    plain = F.transform(sentences, lambda s: F.regexp_replace(F.regexp_replace(s, ",", "，"), f"^{edge}|{edge}$", ""))
    return F.array_join(F.transform(F.filter(plain, lambda s: s != ""), lambda s: F.concat(s, F.lit("。"))), " ")


def canonical_brand(value: Column) -> Column:
    """The brand that a name or one of its aliases stands for, else the name itself."""
    t, out = token(value), F.trim(value)
    for b, names in reversed(BRANDS.items()):
        out = F.when(t.isin(sorted({n.casefold() for n in (b, *names)})), b).otherwise(out)
    return out


def same_brand(actual: Column, wanted: str | None) -> Column:
    """Equal in form, or two names of one brand; nothing wanted fits all."""
    if not (wanted or "").strip():
        return F.lit(True)
    want = F.lit(wanted)
    return (token(actual) == token(want)) | (token(canonical_brand(actual)) == token(canonical_brand(want)))


def first_field(fields: Column, *keys: str) -> Column:
    """The value of the first key that has one, else of the first field whose name holds a key."""
    compact = ["".join(k.split()) for k in keys]
    exact = [F.nullif(F.try_element_at(fields, F.lit(k)), F.lit("")) for k in compact]
    loose = F.filter(F.map_entries(fields), lambda e: e["key"].rlike("|".join(rf"\Q{k}\E" for k in keys)) & (e["value"] != ""))
    return F.coalesce(*exact, F.get(loose, F.lit(0))["value"])


def evidence(n_eff: Column, n_comments: Column) -> Column:
    return F.when(n_eff > 0, n_eff).otherwise(F.coalesce(n_comments, F.lit(0)).cast("double"))


def extraction_status(names: Column) -> Column:
    """empty, garbage (a name of digits or promotion only) or ok."""
    bad = F.exists(names, lambda n: n.rlike("^(?:[0-9]+|元|價格|售價|原價|會員|特價|優惠|點數)+$"))
    return F.when(F.size(names) == 0, "empty").when(bad, "garbage").otherwise("ok")


UNKNOWN = OTHER
