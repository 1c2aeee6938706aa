"""Review sentences as Columns: splitting, what a sentence tells, its score, likeness. Give texts in NFKC."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .names import canonical_name, let, words_in
from .sentiment import NEGATIVE, POSITIVE

# Lines that end a review, lines that are left out, a form's labels; how sentences end, start and go on; what sentences may tell.
SIGNATURE = r"(?i)^\s*(?:--+|Sent from|※\s*發信站|發信站|文章網址)"
LINKED = "(?i)https?://"
DROPPED = r"^\s*(?:https?://|[（(]?區域型商品|試吃試用品|[-—─＝=]{2,}|※|◎|●|▲|Sent from|發信站|文章網址|批踢踢|˙|·)"
LABEL = r"^\s*[【\[]?\s*(?:心得|商品名稱|商品|便利商店|廠商名稱|價格|評分|分數|口味)\s*[】\]]?\s*[:：]"
SENTENCE = r"[^。！？!?；;\n]+[。！？!?；;]?"
STARTS = "^(?:味道|口感|整體|價格|價位|份量|吃起來|喝起來|我自己|我覺得|建議|另外|而且|重要的是)"
GOES_ON = "^(?:帶|並|且|以及|而且)"
INTRO = "今天|昨天|之前|記得|原本|剛剛|下班|路過|逛到|看到|買來|入手|開箱|分享|先上圖|網路說|大家都說|聽說"
REPORTED = "網路說|大家都說|聽說"
FIRST_HAND = "我|自己|吃起來|喝起來|入口|咬下|回購|再買|不會再買"
PRODUCT_FORMS = ["霜淇淋", "冰淇淋", "雪糕", "冰棒", "冰沙", "甜筒", "涼麵", "麵包", "餅乾", "脆條", "飯糰", "便當", "飲料"]
DECISIONS = ["回購", "再買", "不會再買", "推薦", "不推", "值得", "可以試", "不值得", "耐吃"]
ASPECTS = {
    "taste": ["味道", "口味", "甜", "鹹", "酸", "苦", "辣", "香", "濃", "淡", "膩", "奶味", "茶味", "咖啡味"],
    "texture": ["口感", "軟", "硬", "脆", "酥", "滑順", "綿密", "濕潤", "乾", "柴", "嫩", "Q彈", "嚼勁"],
    "ingredient": ["果乾", "內餡", "外皮", "餡料", "夾心", "配料", "醬汁", "湯頭", "麵體", "肉片", "肉塊", "果肉", "顆粒", "碎粒", "堅果", "起司", "珍珠"],
    "portion": ["份量", "分量", "內容量", "大小", "飽足", "吃不飽", "給得多", "給的多", "太少", "好大", "很大", "超大", "好小", "很小", "一大", "料多", "料少"],
    "value": ["價格", "價位", "單價", "划算", "便宜", "偏貴", "太貴", "好貴", "很貴", "不貴", "CP值", "cp值", "值得", "塊", "元"],
    "preparation": ["加熱", "微波", "冷藏", "退冰", "融化", "冰過", "熱熱吃", "冷冷吃"],
    "comparison": ["比較像", "比起", "不如", "勝過", "還原度", "類似", "更好吃", "比較好"],
}
CANDIDATES = 300
LENGTH = 180
CLAUSES = 70
SHORTEST = 18
ALIKE = 0.78

PRAISE, BLAME = ([w for w in words if len(w) >= 2] for words in (POSITIVE, NEGATIVE))
BREAK = "\x1d"  # no text holds it, as lines end there


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _hard_wrapped(lines: Column) -> Column:
    """Four lines or more, half of them of one length, the most frequent one (of equally frequent ones the first)."""

    def judge(lengths):
        each = F.array_distinct(lengths)
        counts = F.transform(each, lambda n: F.size(F.filter(lengths, lambda m: m == n)))
        return let(F.struct(each.alias("each"), counts.alias("counts")), lambda c: let(F.array_max(c["counts"]), lambda top: (F.size(lengths) >= 4) & (top >= 3) & (2 * top >= F.size(lengths)) & (F.get(c["each"], F.array_position(c["counts"], top) - 1) >= 10)))

    return let(F.transform(lines, F.length), judge)


def _rejoined(lines: Column) -> Column:
    """Lines of a block in one text: those that go on from the line before without a line break."""

    def glue(line, i):
        before = F.get(lines, i - 1)
        open_end = ~before.rlike("[。！？!?；;)）]$") & ((F.length(before) >= 28) | ((F.length(before) >= 6) & (F.length(line) <= 8) & line.rlike(GOES_ON)))
        on = before.rlike("[,，、:：]$") | open_end
        return F.when(i == 0, line).when(on & line.rlike(STARTS), F.concat(F.lit("。"), line)).when(on, line).otherwise(F.concat(F.lit("\n"), line))

    return F.when(_hard_wrapped(lines), F.array_join(lines, "")).otherwise(F.array_join(F.transform(lines, glue), ""))


def _chunks(fragment: Column) -> Column:
    """A long fragment in runs of clauses: a run ends where the next clause would make it too long, if it isn't too short."""
    clauses = F.filter(F.transform(F.split(fragment, "[,，]"), _strip), lambda c: c != "")
    done = F.array().cast("array<string>")

    def step(state, clause):
        longer = F.when(state["now"] == "", clause).otherwise(F.concat(state["now"], F.lit(","), clause))
        full = (F.length(longer) > CLAUSES) & (F.length(state["now"]) >= SHORTEST)
        return F.struct(F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"]).alias("done"), F.when(full, clause).otherwise(longer).alias("now"))

    runs = lambda cs: F.aggregate(cs, F.struct(done.alias("done"), F.lit("").alias("now")), step, lambda s: F.array_append(s["done"], s["now"]))
    return F.when(F.length(fragment) <= CLAUSES, F.array(fragment)).otherwise(let(clauses, lambda cs: F.when(F.size(cs) > 1, runs(cs)).otherwise(F.array(fragment))))


def sentences(text: Column) -> Column:
    """Sentences of a review: nothing after a signature, no lines with links or of a form, wrapped lines joined, long sentences cut between clauses."""

    def kept(lines):
        end = F.array_position(F.transform(lines, lambda line: line.rlike(SIGNATURE)), True)
        return F.when(end > 0, F.slice(lines, F.lit(1), end.cast("int") - 1)).otherwise(lines)

    lines = let(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R|[\x1c-\x1e]"), _strip), kept)
    clean = lambda line: F.regexp_replace(_strip(F.regexp_replace(line, LABEL, "")), r"\(\s*[?!？]?\s*\)", "")
    marked = F.transform(lines, lambda line: F.when(line.rlike(LINKED) | line.rlike(DROPPED), F.lit(BREAK)).otherwise(clean(line)))
    blocks = F.split(F.array_join(F.filter(marked, lambda m: m != ""), "\n"), BREAK)
    joined = F.transform(blocks, lambda b: let(F.filter(F.split(b, "\n"), lambda line: line != ""), _rejoined))
    found = F.flatten(F.transform(joined, lambda b: F.regexp_extract_all(b, F.lit(SENTENCE), F.lit(0))))
    edge = r"[ ：:、\-—─]+"
    plain = F.transform(found, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), f"^{edge}|{edge}$", ""))
    return F.filter(F.flatten(F.transform(plain, _chunks)), lambda s: s != "")


def compact(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def _neighbours(text: Column, term: Column) -> Column:
    """The characters before and after each place of a term."""

    def sides(parts):
        last = F.size(parts) - 2
        before = lambda p, i: F.substring(F.when(i > 0, F.concat(term, p)).otherwise(p), -1, 1)
        after = lambda i: F.substring(F.when(i < last, F.concat(F.get(parts, i + 1), term)).otherwise(F.get(parts, i + 1)), 1, 1)
        return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p, i: F.struct(before(p, i).alias("b"), after(i).alias("a")))

    return let(F.split(F.replace(text, term, F.lit(BREAK)), BREAK), sides)


def _told(text: Column, names: Column, term: Column) -> Column:
    """Whether a term stands anywhere else than as part of the product's name."""
    named = F.flatten(F.transform(names, lambda n: _neighbours(n, term)))
    same = lambda x, y: (x != "") & (x == y)
    free = let(named, lambda ns: F.exists(_neighbours(text, term), lambda o: ~F.exists(ns, lambda n: same(n["b"], o["b"]) | same(n["a"], o["a"]))))
    return free & ~((text == term) & F.array_contains(names, term))


def product_forms(name: Column) -> Column:
    """The names that a sentence may repeat, as compact text."""
    return F.transform(F.filter(F.array(name, canonical_name(name, F.lit(""))), lambda n: F.length(n) >= 2), compact)


def aspects(text: Column, names: Column | None = None) -> Column:
    """Aspects that a compact sentence names, where ``names`` are given other than in the product's name."""
    terms = F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(w.casefold()).alias("term")) for a, words in ASPECTS.items() for w in words])
    told = lambda t: F.contains(text, t["term"]) if names is None else F.when(F.contains(text, t["term"]), _told(text, names, t["term"])).otherwise(False)
    return F.array_distinct(F.transform(F.filter(terms, told), lambda t: t["aspect"]))


def of_other_form(text: Column, name: Column) -> Column:
    """Whether a compact sentence speaks of a product of another form, as ice cream where the product is noodles."""
    own, other = F.lit(False), F.lit(False)
    for form in PRODUCT_FORMS:
        has = F.contains(name, F.lit(form))
        own = own | has
        other = other | (~has & text.rlike(f"(?:這|那|一).{{0,8}}(?:支|個|款).{{0,12}}{form}|(?:買|吃).{{0,16}}{form}"))
    return own & other


def decisions(sentence: Column, text: Column) -> Column:
    """Words of a verdict, none in what others are said to think."""
    return F.when(sentence.rlike(REPORTED), 0).otherwise(F.size(words_in(text, DECISIONS)))


def sentiments(text: Column) -> Column:
    return F.size(words_in(text, [*PRAISE, *BLAME]))


def polarity(sentence: Column) -> Column:
    """How many more times words of praise stand in it than words of blame."""
    s = F.lower(sentence)
    times = lambda w: (F.length(s) - F.length(F.replace(s, F.lit(w), F.lit("")))) / len(w)
    return sum((times(w) for w in PRAISE), F.lit(0)) - sum((times(w) for w in BLAME), F.lit(0))


def sentence_score(sentence: Column, place: Column, n_aspects: Column, n_decisions: Column, n_sentiments: Column, author_score: Column) -> Column:
    """What a reader learns: aspects, verdicts, judgements, experience; less for introductions."""
    points = 3.0 * n_aspects + 2.5 * F.least(n_decisions, F.lit(2)) + 1.25 * F.least(n_sentiments, F.lit(3))
    for holds, more in ((n_aspects == 0, -2.0), (F.length(sentence).between(12, 80), 1.0), (sentence.rlike(FIRST_HAND), 0.75), (sentence.rlike(INTRO), -2.5)):
        points = points + F.when(holds, more).otherwise(0.0)
    return points + F.coalesce(F.least(F.abs(author_score - 50) / 50, F.lit(1.0)), F.lit(0.0)) + F.least(place, F.lit(10)) * 0.05


def _bare(text: str) -> str:
    return re.sub(r"[^\w一-鿿]+", "", text).casefold()


def _alike(a: str, b: str) -> bool:
    if not a or not b:
        return False
    if a in b or b in a:
        return True
    m = difflib.SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= ALIKE and m.quick_ratio() >= ALIKE and m.ratio() >= ALIKE


@F.pandas_udf(T.BooleanType())
def alike_any(text: pd.Series, others: pd.Series) -> pd.Series:
    """Whether a text says what one of the others says: one within the other, or a sequence ratio of 0.78; Spark has no such ratio."""
    return pd.Series([t is not None and o is not None and any(_alike(_bare(t), _bare(x)) for x in o) for t, o in zip(text, others, strict=True)], dtype="boolean")


@F.pandas_udf(T.ArrayType(T.StringType()))
def unlike(texts: pd.Series, others: pd.Series) -> pd.Series:
    """Texts of an array in order, the first ``CANDIDATES`` that are like none of the others and like none before."""

    def pick(all_of, against):
        kept, seen = [], [_bare(x) for x in ([] if against is None else against) if x]
        for t in [] if all_of is None else all_of:
            if t and len(kept) < CANDIDATES and not any(_alike(_bare(t), s) for s in seen):
                kept.append(t)
                seen.append(_bare(t))
        return kept

    return pd.Series([pick(t, o) for t, o in zip(texts, others, strict=True)], dtype=object)
