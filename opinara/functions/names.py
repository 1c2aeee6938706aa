"""Names of products as Columns: cleaning, the display name, the key under which spellings meet, and what is no name. Give them NFKC text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .attribution import BRANDS
from .cleaners import title_name, unwrap_brackets
from .text import let

# Patterns of what isn't part of a name, word lists of forms and flavours, spellings of one thing.
SEPARATOR = r"(?U)(?:(?<!\d)\.(?!\d)|(?<!\d)%|%(?![\w一-鿿])|[#:/／｜|,，。!！?？~～\-_=+])+"
TITLE_PREFIX = r"^\s*(商品|心得|情報|問題|請益|討論|問卦)\s*"
NOISE = (
    r"(無限回購|期間限定|季節限定|超好吃|好不好吃|好吃嗎|小心得|新口味|心得|開箱|踩雷|地雷|評價|回購|分享|請益|請問|詢問|推薦|推不推|"
    r"反推|實測|試吃|食記|簡評|必買|不推|超商|好吃|難吃|最新|聯名|大推|激推|微雷|不雷|二訪|回味)"
)
OPTIONAL = r"((?:[0-9]+(?:\.[0-9]+)?|[一二三四五六七八九十]+)\s*(入|包|個|顆|片|枚|杯|瓶|罐|盒|組|ml|毫升|g|公克|克|支)|(特大杯|大杯|中杯|小杯|口味|數量|容量|規格|加量|限定|新品|新上市))"
PROMO = (
    r"([0-9]+元|\$[0-9]+|買[一二三四五六七八九十0-9]+[送得]|第[二三四五六七八九十0-9]+件[0-9]*折|任選[0-9]+件?[0-9]*元?|[買滿][0-9]+[送打折抽]|[0-9]+買[一二三四五六七八九十0-9]+[支個入包瓶罐杯盒組件]?|"
    r"可以抽抽樂|抽抽樂|集點|加購|酷碰[券價]?|酷澎[券價]?|限時特價|目前特價|原價|特價|價格|售價|價錢|台幣|特惠|促銷|優惠|折扣|買就送|滿額|加價購)"
)
PROMO_TAIL = r"(隨買|跨店|取件|搭配|好康|活動|優惠|加購|半價|滿額).*$"
PROMO_SUFFIX = r"(?:點數兌換|免費兌換的?|兌換|預購加點數|會員特價.*|會員優惠.*|任選.*|打折.*)$"
QUANTITY = r"[兩三四五六七八九十0-9]+[支個入包瓶罐杯盒組件份]$"
TAIL_PRICE_NOISE = r"[0-9]{2,3}(?:ibon|票券|[xX×]|折|件|點|瓶|杯|金).*$"
TAIL_FILLER = r"(?:嘗鮮價|嚐鮮價|半價|單件|價|都|一|的|膜)$"
GARBAGE = (
    r"(?i)^[0-9]{1,3}$|^unknown$|^任[0-9]|^折後$|^消費滿|^期間|^友善時光$|^牧場直送$|FMC|系列商品|即期品|兩件|兩瓶|合購|加購|app|折價券|好康|扣|跨店|指定商品|點數換|"
    r"^任[0-9二三四五六七八九十]|^[0-9]+元$|^[0-9]+金|^ps|^配\S{0,3}$|^記得|^最近\S{0,2}$|^大卡$|^OP$|^i珍食|^APP券|^惜福|^555|^36[0-9]{3}|(?:ibon|票券).*(?:ibon|票券)|.{60,}"
)
PRICE_LABEL = r"^(價格|售價|價錢|原價|特價|目前特價|活動價|台幣)+$"
FRAGMENTS = ["今日", "會員", "軟歐", "搭配", "奶茶", "單瓶", "前者", "後者", "打折", "元", "任選", "購入", "友善", "雞排", "油雞", "全家", "全品項", "買兩個", "元新品"]
CATEGORIES = ["便當", "鹹食", "泡麵", "麵包", "甜點", "冰品", "飲料", "乳品", "零食", "周邊", "其他"]
PURCHASE = r"[買滿][一二三四五六七八九十兩0-9]+(?:件|個|元|支|包|杯|入|盒|瓶|份)|第[二三四五六七八九十0-9]+件|滿額|加價購"
GIVEAWAY = r"免費|贈送|贈品|兌換|換購|送$"
SYNONYMS = {"蕃薯": "地瓜", "番薯": "地瓜", "起士": "起司", "芝士": "起司", "優格": "優酪", "吐司": "土司", "哈蜜瓜": "哈密瓜", "贅澤": "贅沢"}
FORMS = ["霜淇淋", "冰淇淋", "雪糕", "冰棒", "冰沙", "甜筒", "麵包", "餅乾", "脆條", "飯糰", "便當", "飲料"]
ICE = ["霜淇淋", "冰淇淋", "雪糕", "冰棒", "冰沙", "甜筒"]
FLAVOURS = [
    "原味", "辣", "麻辣", "起司", "地瓜", "乳酪", "巧克力", "可可", "哈密瓜", "芒果", "荔枝", "水蜜桃", "桃", "蘋果", "青蘋果", "木瓜", "香蕉", "奇異果", "火龍果", "鳳梨", "葡萄柚", "葡萄", "柳橙", "橘", "橙", "芭樂", "莓", "草莓", "野莓", "蔓越莓",
    "抹茶", "焙茶", "紅茶", "綠茶", "烏龍", "咖啡", "奶茶", "牛奶", "鮮奶", "優酪", "香草", "焦糖", "蜂蜜", "海鹽", "檸檬", "柚", "藍莓", "芋頭", "花生", "開心果", "栗子", "榛果", "堅果", "芝麻", "紅豆", "綠豆", "玉米",
    "牛肉", "豬肉", "雞肉", "鮪魚", "鮭魚", "椒麻", "麻油", "咖哩", "蒜", "蔥", "辣椒",
]
UNKNOWN = "unknown"


def replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), pairs, text)


def brand_case(brand: Column, patterns: dict[str, str]) -> Column:
    """A brand's pattern, as a column: so the text it is applied to stands in the expression once. Other brands' fits nothing."""
    out = None
    for b, p in patterns.items():
        out = F.when(brand == b, F.lit(p)) if out is None else out.when(brand == b, F.lit(p))
    return out.otherwise(F.lit("(?!)"))


def strip_brand(text: Column, brand: Column) -> Column:
    """Without the names of the brand, those of Latin letters only where no letter or digit touches them."""
    whole = lambda n: rf"(?<![A-Za-z0-9])\Q{n}\E(?![A-Za-z0-9])" if any(c.isascii() and c.isalnum() for c in n) else rf"\Q{n}\E"
    return F.regexp_replace(text, brand_case(brand, {b: "(?i)" + "|".join(whole(n) for n in sorted({b, *names}, key=len, reverse=True)) for b, names in BRANDS.items()}), F.lit(" "))


def _letters(text: Column) -> Column:
    """No white space, and of marks only a point or percent that belongs to the name."""
    return replaced(text, (r"(?U)\s+", ""), (r"(?U)[^\w.%一-鿿]+", ""))


def cleaned(name: Column, brand: Column) -> Column:
    """A name as extracted: no brand, remarks, amounts or promotions."""
    s = strip_brand(unwrap_brackets(F.regexp_replace(name, "(?i)Fami!ce", "Famice")), brand)
    s = replaced(s, (r"(?<=[一-鿿])[xX×](?=[一-鿿])", " "), (SEPARATOR, " "), (TITLE_PREFIX, " "), (NOISE, " "), (OPTIONAL, " "), (PROMO, " "), (PROMO_SUFFIX, " "), (PROMO_TAIL, " "), (QUANTITY, ""))
    return _letters(s)


def canonical_name(name: Column, brand: Column) -> Column:
    """The name to show: cleaned, without what clings to its end, a doubled name once, one spelling of each thing; unknown if nothing is left."""
    s = strip_brand(unwrap_brackets(F.trim(F.coalesce(name, F.lit("")))), brand)
    s = _letters(replaced(s, (SEPARATOR, " "), (TITLE_PREFIX, " "), (NOISE, " "), (OPTIONAL, " "), (PROMO, " ")))
    s = replaced(s, (TAIL_PRICE_NOISE, ""), (r"[0-9]{1,3}$", ""), (TAIL_FILLER, ""), (r"^(.{3,})\1.?$", "$1"))
    return F.coalesce(F.nullif(replaced(s, *SYNONYMS.items()), F.lit("")), F.lit(UNKNOWN))


def merge_key(name: Column) -> Column:
    """What spellings of one product share: letters and digits only, in lower case."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w一-鿿]+", ""), F.lit("")), F.lit(UNKNOWN))


def is_condition(name: Column) -> Column:
    """How to get a thing, not what it is: a purchase to make and a gift."""
    compact = F.regexp_replace(name, r"(?U)\s+", "")
    return compact.rlike(PURCHASE) & compact.rlike(GIVEAWAY)


def is_garbage(name: Column) -> Column:
    return name.rlike(GARBAGE)


def is_junk(name: Column) -> Column:
    """No product's name: prices, promotions, fragments, a bare category."""

    def junk(s):
        size = F.greatest(F.length(s), F.lit(1))
        digits, promo = F.regexp_count(s, F.lit("[0-9]")), F.length(s) - F.length(F.regexp_replace(s, "預購|加點數|點數|會員|特價|優惠|原價|售價|目前|元", ""))
        whole = "即時救援|即期救援|救援價|^(?:今日|會員|搭配|友善|購入)(?:價|[0-9]+折|一)?$|^(?:[0-9]+|元|價格|售價|原價|會員|目前|特價|優惠|預購|加點數|點數|塊|套餐|打折|換|的話|任選)+$|" + PRICE_LABEL
        return (s == "") | s.isin(CATEGORIES + FRAGMENTS) | s.rlike(whole) | is_condition(s) | ((digits >= 2) & (digits / size >= 0.35) & s.rlike("塊|套餐|打折|點數|換")) | ((promo >= 2) & (promo / size >= 0.5))

    return let(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", ""), junk)


def title_fallback(title: Column, brand: Column) -> Column:
    """The name that a post's title gives."""
    return let(title_name(F.coalesce(title, F.lit(""))), lambda plain: let(cleaned(plain, brand), lambda found: F.when((F.length(found) >= 2) & ~is_junk(found), found).otherwise(plain)))


def words_in(text: Column, words: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def is_bare_form(name: Column) -> Column:
    """A form alone, as ice cream, without a flavour."""
    return (F.size(words_in(name, FORMS)) > 0) & (F.trim(F.regexp_replace(name, "|".join(FORMS), "")) == "")
