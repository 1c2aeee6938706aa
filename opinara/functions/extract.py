"""Products and prices of a form's free text, as Columns over NFKC text.

A line is tidied, then read in several ways; the first reading that finds something counts. Fields of several lines
are read line by line, a line of prices going to the name before it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import names as N
from .cleaners import unwrap_brackets
from .names import let

# Limits of a price, and patterns of prices, bundles, asides and tails.
LEAST, MOST, MOST_SHARED = 15, 400, 999
UNIT = "支|入|個|包|瓶|罐|杯|盒|組|件|份"
PRICE = r"(?<![0-9])([0-9]{1,3})(?![0-9])\s*(?:元|台幣)?"
IN_RANGE = r"(?<![0-9])(1[5-9]|[2-9][0-9]|[1-3][0-9]{2}|400)(?![0-9])\s*(?:元|台幣)?"
BUNDLE = rf"([2-6])\s*(?:{UNIT})\s*\$?\s*([0-9]{{2,3}})\s*(?:元)?"
TRAILING = r"^(.+?)\s*(?:各)?\s*([0-9]{2,3})\s*元?$"
BEFORE_PROMO = (
    r"^(.+?)([0-9]{2,3})(?:元)?(?:搭|取件|隨買|跨店|買[一二三四五六七八九十0-9]+[送得支個入包瓶罐杯盒組件份]|第[二三四五六七八九十0-9]+件|任選|滿額|加購|優惠|半價|"
    r"[買滿][0-9]+[送打折抽]|好康|活動|限時|特惠|促銷|折扣).*$"
)
SAME_PRICE = r"^\s*(.+?)\s*(?:[/／]\s*)?(?:都|各)\s*([0-9]{2,3})\s*(?:元)?\s*\$?\s*$"
FLAVOURS = r"([^-－/／]{2,}?)[-－]([^-－/／]*?、[^-－/／]*?)(雙風味|雙口味|雙口感|兩種口味|兩款口味)"
QUALIFIER = (
    r"([0-9]{1,3})?\s*元?\s*(?:友善|嚐鮮價|嘗鮮價|嚐鮮|嘗鮮|促銷價|加購價|優惠價|特惠價|活動價|會員價|原價|售價|特價|優惠|促銷|單價|總價|價格|價|折價後|打折後|折後|折價|打折|領券|自助結帳|結帳|i珍食|惜福|限店|"
    r"第[一兩二三四五六七八九十0-9]+[件瓶隻支個杯份]|任[一兩二三四五六七八九十0-9]*[件瓶隻支個杯份]?折?|任|[一兩二三四五六七八九十0-9]+折|折|商品)+$"
)
NOTE = r"[/／｜|，,]\s*[^/／｜|0-9]*(?:一起結帳|結帳|忘記|不確定|不知道|沒注意|沒記|可能是|大概是|忘了)[^/／｜|0-9]*$"
GIFT = (
    r"(?:[/／、,，+＋]?\s*(?:消費滿[0-9]*|任[一兩二三四五六七八九十0-9]+[件瓶個支杯份]?|買[一兩二三四五六七八九十0-9]+[件瓶個支杯份]?|[一兩二三四五六七八九十0-9]+件)\s*[一兩二三四五六七八九十0-9]*折?\s*(?:免費)?送.*"
    r"|[/／、,，+＋]\s*[0-9]{0,3}\s*元?\s*(?:免費)?送.*|[0-9]{1,3}\s*元\s*(?:免費)?送.*)$"
)
PAYMENT = r"付款|支付|刷卡|信用卡|金融卡|聯邦卡|國泰卡|中信卡|玉山卡|台新卡|悠遊卡|一卡通|icash|ipass|i\s*pass|line\s*pay|linepay|街口|全支付|全盈|apple\s*pay|google\s*pay|samsung\s*pay"
TEMPLATE = "(區域型商品請註明 試吃試用品請標示價格0元)"
REVIEW_STARTS = r"^\s*[：:]?\s*[【\[]?\s*心得\s*[】\]]?\s*[:：]"
PRICE_LINE = r"(?i)^\s*(?:價格|售價|價錢|原價|特價|目前|活動價|NT\$?|\$|[0-9]+\s*(?:ML|毫升|G|公克|克))"
SUFFIXES = ["三明治", "御飯糰", "飯糰", "便當", "軟歐", "貝果", "可頌", "餐包", "蛋餅", "義大利麵", "霜淇淋", "冰淇淋", "布丁", "泡芙", "蛋糕", "拉麵", "麵包", "吐司", "土司"]
COMBO = r"[0-9]+\s*(?:入|包|個|顆|片|杯|瓶|罐|盒|組|件|份)"

ITEMS = "array<struct<name:string,price:int>>"


def _item(name: Column, price: Column | None) -> Column:
    return F.struct(name.cast("string").alias("name"), (F.lit(None) if price is None else price).cast("int").alias("price"))


def _one(name: Column, price: Column | None) -> Column:
    return F.array(_item(name, price))


def _shortened(text: Column, pattern: str) -> Column:
    """Without the pattern, unless hardly anything were left."""
    return let(text, lambda t: F.when(F.length(F.trim(F.regexp_replace(t, pattern, ""))) >= 2, F.trim(F.regexp_replace(t, pattern, ""))).otherwise(t))


def tidy(line: Column, brand: Column) -> Column:
    """A line without brand, brackets, friendly hours, decimals of prices, multipliers and asides on price, gifts and payment."""
    s = N.replaced(line, (r"^[：:]+\s*", ""), ("(?i)Fami!ce", "Famice"), (r"\$([0-9])", "$1"), (r"([0-9])\$", "$1"))
    s = N.strip_brand(F.regexp_replace(unwrap_brackets(s), r"[\[\(（【][^\]\)）】]*$", " "), brand)
    s = N.replaced(s, ("友善時光", " "), (r"[/／]?\s*[0-9]{1,3}\s*時光\s*$", ""), (r"([0-9]+)\.[0-9]+(?=\s*元)", "$1"), (r"\s*[xX*×]\s*0?\.[0-9]+\s*", " "))
    s = _shortened(_shortened(s, NOTE), GIFT)
    return N.replaced(s, (rf"(?i)[/／｜|]\s*[^/／｜|0-9]*(?:{PAYMENT})[^/／｜|0-9]*(?=[0-9]{{2,3}}\s*(?:元)?)", " "), (rf"(?i)([0-9]{{2,3}}元)\s*[/／｜|]\s*[^/／｜|]*(?:{PAYMENT}).*$", "$1"))


def squashed(text: Column) -> Column:
    """One run of letters and digits: no separators, remarks or white space."""
    return N.replaced(text, (r"(?<=[一-鿿])[xX×](?=[一-鿿])", " "), (N.SEPARATOR, " "), (N.TITLE_PREFIX, " "), (N.NOISE, " "), (r"(?U)\s+", ""))


def prices(text: Column, most: int = MOST) -> Column:
    """All prices in range, those of bundles by the piece (half up) and after the others."""
    plain = F.transform(F.regexp_extract_all(F.regexp_replace(text, BUNDLE, " "), F.lit(PRICE), 1), lambda p: p.cast("int"))
    counts, totals = F.regexp_extract_all(text, F.lit(BUNDLE), 1), F.regexp_extract_all(text, F.lit(BUNDLE), 2)
    pieces = F.zip_with(counts, totals, lambda c, t: F.floor(t.cast("double") / c.cast("double") + 0.5).cast("int"))
    fit = lambda ps: F.filter(ps, lambda p: p.between(LEAST, most))
    return let(fit(plain), lambda p: F.when(F.size(p) > 0, p).otherwise(fit(pieces)))


def best_price(text: Column) -> Column:
    """The last price."""
    return let(prices(text), lambda p: F.get(p, F.size(p) - 1))


def first_price(text: Column) -> Column:
    return F.get(prices(text, MOST_SHARED), F.lit(0))


def segments(text: Column, brand: Column) -> Column:
    """A name in front of each price; a bundle's price by the piece."""
    names, found = F.regexp_extract_all(text, F.lit("(?s)(.*?)" + IN_RANGE), 1), F.regexp_extract_all(text, F.lit("(?s)(.*?)" + IN_RANGE), 2)
    count = lambda n: F.regexp_extract(n, rf"([2-6])\s*(?:{UNIT})\s*$", 1)
    piece = lambda n, p: F.when(count(n) == "", p.cast("int")).otherwise(F.floor(p.cast("double") / F.nullif(count(n), F.lit("")).cast("double") + 0.5).cast("int"))
    items = F.zip_with(names, found, lambda n, p: _item(N.cleaned(F.regexp_replace(n, rf"[2-6]\s*(?:{UNIT})\s*$", ""), brand), piece(n, p)))
    return F.filter(items, lambda i: (F.length(i["name"]) >= 2) & ~i["name"].rlike(N.PRICE_LABEL) & i["price"].between(LEAST, MOST))


def _priced(text: Column, pattern: str, *strip: str) -> Column:
    """One name with one price, if the pattern fits; null otherwise."""
    price = F.regexp_extract(text, pattern, 2).try_cast("int")

    def named(name):
        return let(F.trim(N.replaced(name, *[(p, "") for p in (N.QUANTITY, N.OPTIONAL, *strip)])), lambda plain: F.when((F.length(name) >= 2) & price.between(LEAST, MOST) & (F.length(plain) >= 2), _one(plain, price)))

    return let(F.regexp_extract(text, pattern, 1), named)


def _same_price(s: Column) -> Column:
    """Names set apart by slashes or commas that share one price."""
    listed, price = F.regexp_extract(s, SAME_PRICE, 1), F.regexp_extract(s, SAME_PRICE, 2).try_cast("int")
    names = F.transform(F.split(listed, "[/／、]"), lambda n: N.replaced(n, (N.NOISE, " "), (r"(?U)^\s+|\s+$", ""), ("[，,、]+$", ""), (r"(?U)\s+", "")))
    items = F.transform(F.filter(names, lambda n: F.length(n) >= 2), lambda n: _item(n, price))
    return F.when(listed.rlike("[/／、]") & price.between(LEAST, MOST) & (F.size(items) >= 2), items)


def _shared_prefix(s: Column) -> Column:
    """One prefix with several flavours."""
    prefix, flavours, mark = (F.regexp_extract(s, FLAVOURS, k) for k in (1, 2, 3))
    end = F.when(mark.contains("口味"), "口味").otherwise("風味")
    kinds = F.filter(F.transform(F.split(flavours, "、"), lambda f: F.trim(f)), lambda f: f != "")
    items = let(best_price(s), lambda p: F.transform(kinds, lambda f: _item(F.regexp_replace(F.concat(prefix, f, end), r"(?U)\s+", ""), p)))
    return F.when((F.length(F.trim(prefix)) >= 2) & (F.size(kinds) >= 2), items)


def _plain(s: Column, brand: Column) -> Column:
    """A squashed text: several priced names, one before or after promotions, or a name alone."""

    def alone(bare):
        return F.coalesce(_priced(bare, TRAILING), _one(F.coalesce(F.nullif(F.regexp_replace(bare, "[0-9]{2,3}元?$", ""), F.lit("")), s), None))

    return let(
        segments(s, brand),
        lambda found: F.coalesce(F.when((F.size(found) >= 2) | ((F.size(found) == 1) & s.rlike(BUNDLE)), found), _priced(s, TRAILING, N.PROMO, N.PROMO_TAIL), _priced(s, BEFORE_PROMO), let(F.regexp_replace(s, N.PROMO, ""), alone)),
    )


def read_line(line: Column, brand: Column) -> Column:
    """The items of one line; a combination of two packs counts as its first."""
    both = r"^([^+＋]+?)[+＋](.+)$"

    def readings(s):
        combo = F.regexp_extract(s, both, 1).rlike(COMBO) & F.regexp_extract(s, both, 2).rlike(COMBO)
        text = squashed(F.when(combo, F.regexp_extract(s, both, 1)).otherwise(s))
        first = lambda i: F.array(_item(F.trim(N.replaced(i["name"], (N.QUANTITY, ""), (N.OPTIONAL, ""))), F.coalesce(i["price"], first_price(s))))
        plain = let(text, lambda x: _plain(x, brand))
        return F.coalesce(F.when(~combo, F.coalesce(_same_price(s), _shared_prefix(s))), let(plain, lambda p: F.when(combo, let(F.get(p, F.lit(0)), first)).otherwise(p)))

    return let(tidy(line, brand), readings)


def _lines(raw: Column) -> Column:
    """A field's lines up to the review, without links and the form's own words."""
    every = F.transform(F.split(raw, r"\r?\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    starts = F.filter(F.transform(every, lambda x, i: F.when(x.rlike(REVIEW_STARTS), i)), lambda i: i.isNotNull())
    until = F.coalesce(F.get(starts, F.lit(0)), F.size(every))
    return F.filter(F.slice(every, F.lit(1), until), lambda x: (x != "") & ~x.rlike("^[：:]+$") & (x != TEMPLATE) & ~x.rlike("(?i)https?://"))


def _several_lines(lines: Column, read: Column, brand: Column) -> Column:
    """Items of lines, given with what each one reads as; a line of prices goes to the name before it."""
    state = f"struct<items:{ITEMS},name:string>"

    def make(items, name):
        return F.struct(items.cast(ITEMS).alias("items"), name.cast("string").alias("name")).cast(state)

    def add(done, pair):
        line, price = pair["line"], pair["price"]
        more = F.when(F.size(pair["several"]) >= 2, pair["several"]).otherwise(F.filter(pair["read"], lambda i: (i["name"] != "") & i["price"].isNotNull()))
        name = F.coalesce(F.nullif(F.get(pair["read"], F.lit(0))["name"], F.lit("")), done["name"])
        context = F.when(done["name"].isNotNull() & price.isNotNull(), make(F.concat(done["items"], _one(done["name"], price)), F.lit(None))).otherwise(done)
        return F.when(line.rlike(PRICE_LINE), context).otherwise(let(more, lambda m: F.when(F.size(m) > 0, make(F.concat(done["items"], m), F.lit(None))).otherwise(make(done["items"], name))))

    pairs = F.zip_with(lines, read, lambda x, r: F.struct(x.alias("line"), r.alias("read"), segments(x, brand).alias("several"), best_price(x).alias("price")))
    # Nothing priced: the first line's name, short lines that go on with it, and the first price further down.
    later = lambda ps: F.get(F.filter(F.transform(F.slice(ps, F.lit(2), F.size(ps)), lambda p: p["price"]), lambda p: p.isNotNull()), F.lit(0))
    goes_on = lambda x: (F.length(x) <= 16) & ~x.rlike(PRICE) & ~x.rlike(N.PROMO) & ~x.rlike(N.OPTIONAL) & (F.length(squashed(x)) >= 2)
    more = F.transform(F.filter(F.slice(lines, F.lit(2), F.size(lines)), goes_on), squashed)

    def items(ps):
        anywhere = let(F.get(ps, F.lit(0))["read"], lambda r: _one(F.concat(F.get(r, F.lit(0))["name"], F.array_join(F.filter(more, lambda x: ~F.contains(F.get(r, F.lit(0))["name"], x)), "")), F.coalesce(F.get(r, F.lit(0))["price"], later(ps))))
        return let(F.aggregate(ps, make(F.array().cast(ITEMS), F.lit(None)), add)["items"], lambda f: F.when(F.size(f) > 0, f).otherwise(anywhere))

    shared = let(tidy(F.array_join(lines, " "), brand), _same_price)
    return F.coalesce(shared, let(pairs, items))


def _parallel(line: Column) -> Column:
    """The parts of a line set apart by white space, if there are several and each ends as products' names do; null otherwise."""
    ends = "(?:" + "|".join(SUFFIXES) + ")(?:[/／]?[0-9]*元?)$"
    return let(F.split(F.regexp_replace(line, r"^[：:]+\s*", ""), r"(?U)\s+"), lambda parts: F.when((F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(ends)), parts))


def without_qualifiers(items: Column) -> Column:
    """Names without a shop's words on prices at their end; a price swallowed by these becomes the item's. No name shrinks below three characters."""

    def one(i):
        end = F.regexp_extract(i["name"], QUALIFIER, 0)
        rest = F.regexp_replace(F.regexp_replace(i["name"], QUALIFIER, ""), r"(?U)[、,，.。/／|｜\-\s]+$", "")
        bare = F.regexp_replace(rest, N.QUANTITY, "")
        swallowed = F.regexp_extract(i["name"], QUALIFIER, 1).try_cast("int")
        price = F.coalesce(i["price"], F.when(swallowed.between(LEAST, MOST), swallowed))
        return F.when((end != "") & (F.length(rest) >= 3), _item(F.when(F.length(bare) >= 2, bare).otherwise(rest), price)).otherwise(i)

    return F.transform(items, one)


def reply_part(raw: Column) -> Column:
    """What a reply says in front of its signature."""
    return F.regexp_replace(raw, r"(?s)(?:^|\n)[：:]?\s*--\s*(?:\n.*)?$", "")


def extract_products(raw: Column, brand: Column) -> Column:
    """array<struct<name, price>>: the products of a form's field by rules. Give it NFKC text."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", "")

    def read(lines):
        parts = _parallel(F.get(lines, F.lit(0)))
        return let(F.struct(F.coalesce(parts, lines).alias("lines"), parts.isNotNull().alias("parallel")), chosen)

    def chosen(c):
        return let(F.transform(c["lines"], lambda x: read_line(x, brand)), lambda r: F.when(c["parallel"], F.transform(r, lambda x: F.get(x, F.lit(0)))).when(F.size(r) > 1, _several_lines(c["lines"], r, brand)).when(F.size(r) == 1, F.get(r, F.lit(0))).otherwise(_one(F.lit(""), None)))

    return without_qualifiers(let(_lines(text), read)).cast(ITEMS)


def with_labels(rules: Column, labelled: Column) -> Column:
    """A label's items in place of the rules'; the rules lend a price where both name one product and the label has none. Null: not labelled; empty: no usable name."""
    lent = (F.size(labelled) == 1) & (F.size(rules) == 1) & F.get(labelled, F.lit(0))["price"].isNull() & F.get(rules, F.lit(0))["price"].isNotNull()
    return F.when(labelled.isNull(), rules).when(lent, _one(F.get(labelled, F.lit(0))["name"], F.get(rules, F.lit(0))["price"])).otherwise(labelled)
