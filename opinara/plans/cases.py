"""Functions of text and labels over the whole part table: each row takes one of a list of inputs, the oracle holds the results to expect.

``golden`` registers such a query. Inputs are literals of the domain, as the driver's tables hold no such text; rows and their number are the table's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..functions import attribution as AT, cleaners as CL, display as D, extract as E, labelling as LB, names as N, sentences as SN, sentiment as SE, text as TX
from ..operators import fingerprints as FP, identity as ID
from ..operators.similar import spread
from .registry import ORACLES, QUERIES
from .standins import table

KINDS = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def _sql(value, kind: str) -> str:
    text = "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)
    return f"CAST({text} AS {KINDS[kind]})"


def golden(name: str, inputs: dict[str, str], outputs: dict[str, str], rows: list[tuple], f: Callable[..., list[Column]]) -> None:
    """Row n of the table takes case n modulo their number; f maps the inputs to the outputs. Kinds are Spark's names of types."""
    fields = [*inputs.items(), *outputs.items()]

    def run(spark, sf_dir):
        cases = F.array(*[F.struct(*[F.lit(v).cast(k).alias(c) for v, (c, k) in zip(r[: len(inputs)], inputs.items(), strict=True)]) for r in rows])
        df = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.element_at(cases, (F.col("p_partkey") % len(rows) + 1).cast("int")).alias("_c")).select("p_partkey", "_c.*")
        return df.select("p_partkey", *inputs, *[c.cast(k).alias(n) for c, (n, k) in zip(f(*[F.col(c) for c in inputs]), outputs.items(), strict=True)])

    run.__name__ = name
    QUERIES[name] = run
    values = ", ".join(f"({i}, " + ", ".join(_sql(v, k) for v, (_, k) in zip(r, fields, strict=True)) + ")" for i, r in enumerate(rows))
    columns = ", ".join(f'"{c}"' for c, _ in fields)
    ORACLES[name] = f"SELECT p_partkey, {columns} FROM part JOIN (VALUES {values}) v(i, {columns}) ON p_partkey % {len(rows)} = i"


S, I, D2, B, TS, DT = "string", "int", "double", "boolean", "timestamp_ntz", "date"

golden("push_counts", {"raw": S}, {"push_count": I}, [("爆", 100), ("XX", -10), ("X3", -3), ("X", -1), ("", 0), (" 12 ", 12), ("-4", -4), ("+5", 5), ("xx", None), ("a", None), ("X1a", None), (None, None)], lambda t: [TX.push_count(t)])
golden("author_scores", {"raw": S}, {"author_score": D2}, [("85", 85.0), ("8/10", 80.0), ("8/100", 80.0), ("4 / 5", 80.0), ("★★★★", 80.0), ("★⭐☆", 40.0), ("8分", 80.0), ("8", 8.0), ("250", 100.0), ("7.5/10", 75.0), ("無", None), ("", None), (None, None)], lambda t: [TX.author_score(t)])
golden(
    "comment_times", {"raw": S, "posted": TS}, {"at": TS},
    [("05/02 12:30", "2025-05-01 00:00:00", "2025-05-02 12:30:00"), ("01/01 00:05", "2025-12-31 23:00:00", "2026-01-01 00:05:00"), ("12/31 23:55", "2026-01-01 00:10:00", "2025-12-31 23:55:00"), ("02/29 08:15", "2024-03-01 00:00:00", "2024-02-29 08:15:00"), ("02/29 08:15", "2023-10-01 00:00:00", None),
     ("01/10 10:00", "2024-07-11 00:00:00", "2025-01-10 10:00:00"), ("2024-05-01 10:00:00", "2020-01-01 00:00:00", "2024-05-01 10:00:00"), ("3/4 5:06", None, "2021-03-04 05:06:00"), ("13/01 10:00", "2024-07-11 00:00:00", None), ("soon", "2024-07-11 00:00:00", None), (None, "2024-07-11 00:00:00", None)],
    lambda t, p: [TX.comment_time(t, p, 2021)],
)
golden("board_times", {"raw": S}, {"at": TS}, [("Mon May 13 20:15:30 2024", "2024-05-13 20:15:30"), ("Wed May  1 02:05:03 2024", "2024-05-01 02:05:03"), ("2024-05-13 20:15:30", "2024-05-13 20:15:30"), ("13/5/2024", None), ("", None), (None, None)], lambda t: [TX.board_time(t)])
golden(
    "lexicon_sentiment", {"tag": S, "text": S}, {"sentiment": D2},
    [("推", "超好吃", 1.0), ("→", "不好吃", -0.4), ("噓", "難吃又貴", -0.9), ("→", "餅乾", 0.0), ("推", "", 0.6), ("→", "有點鹹", -0.2), ("→", "奶油很香", 0.288), ("推", "推薦回購", 0.98), ("噓 ", "香草普通", -0.68), ("→", None, 0.0)],
    lambda g, t: [SE.comment_score(g, t)],
)
golden(
    "comment_predicates", {"text": S}, {"off_topic": B, "echo": B, "shill": B, "noise": B},
    [("我家附近買不到", True, False, False, False), ("謝謝你的分享", True, False, False, False), ("原來這麼難吃", False, True, False, False), ("果然我吃過就難吃", False, False, False, False), ("業配吧", False, False, True, False), ("葉配", False, False, True, False), ("茶葉蛋好吃", False, False, False, False), ("專業推文", False, False, False, False), ("!!!", False, False, False, True), ("板務", False, False, False, True), ("😀☀", False, False, False, True), ("好吃", False, False, False, False)],
    lambda t: [TX.off_topic(t), TX.echo(t), TX.shill(t), CL.structural_noise(t)],
)
golden("brand_inference", {"vendor": S, "body": S}, {"brand": S}, [("小七 布丁", "全家", "7-11"), ("cookie", "", "其他"), ("全家OK便利", "", "全家"), ("OK 布丁", "", "OK"), ("布丁", "比全家好吃", "全家"), ("Hi-Life", None, "萊爾富"), ("", "", "其他")], lambda v, b: [AT.infer_brand(v, b)])
golden(
    "attribution_cases", {"text": S, "score": D2, "backend": S}, {"include": B, "sentiment": D2, "brands": S, "other_preferred": B, "own_preferred": B},
    [("全家這款好吃", 0.5, "lexicon", True, 0.5, "", False, False), ("比小7好吃", 0.1, "lexicon", True, 0.4, "7-11", False, True), ("小7的比較好吃", 0.5, "lexicon", False, 0.5, "7-11", True, False), ("小7也有賣", 0.0, "lexicon", False, 0.0, "7-11", False, False), ("cookie 很好吃", 0.9, "lexicon", True, 0.9, "", False, False),
     ("比小7好吃", -0.5, "llm-backfill", True, -0.5, "7-11", False, True), ("輸小7", -0.5, "lexicon", False, -0.5, "7-11", True, False), ("屌打小7", 0.5, "lexicon", True, 0.5, "7-11", False, True)],
    lambda t, s, b: (lambda a: [a["include"], a["sentiment"], F.array_join(a["brands"], ","), a["other_preferred"], a["own_preferred"]])(AT.attribution(F.lit("全家"), t, s, b)),
)
golden("aliases", {"actual": S}, {"canonical": S, "same": B}, [("小七", "7-11", True), ("7-ELEVEN", "7-11", True), ("７-11", "7-11", True), ("全家", "全家", False), ("某店", "某店", False), (None, None, None)], lambda a: [CL.canonical_brand(a), CL.same_brand(a, "seven")])

#: (field, brand, products with prices): fixed values.
EXTRACTIONS = [
    ("BF薄荷岩鹽檸檬糖35", "", [("BF薄荷岩鹽檸檬糖", 35)]), ("抹茶霜淇淋兩支55抹茶千層59", "", [("抹茶霜淇淋", 55), ("抹茶千層", 59)]), ("：\n大大大香辣鹹酥雞/59\n兩件88元", "", [("大大大香辣鹹酥雞", 59)]), ("詹姆士香蒜胡椒肉骨茶泡麵 79元", "", [("詹姆士香蒜胡椒肉骨茶泡麵", 79)]),
    ("莊園牛奶霜淇淋49\n取件優惠買一送一", "", [("莊園牛奶霜淇淋", 49)]), ("https://example.test/deal/999\nBF薄荷岩鹽檸檬糖35", "", [("BF薄荷岩鹽檸檬糖", 35)]), ("抹茶霜淇淋/草莓蛋糕都55元", "", [("抹茶霜淇淋", 55), ("草莓蛋糕", 55)]),
    ("：\n沙漠之星(石榴洛神氣泡飲)、\n法老的紅寶石(草莓氣泡飲)、\n拉神之眼(柑橘氣泡飲)/各49$", "", [("沙漠之星", 49), ("法老的紅寶石", 49), ("拉神之眼", 49)]), ("：四季檸檬酷繽球/酷碰價39元", "全家", [("四季檸檬酷繽球", 39)]), ("： 核桃腰果稻禾壽司組/55 /38時光", "全家", [("核桃腰果稻禾壽司組", 55)]),
    ("：厚奶拿鐵/酷碰券特大杯59", "全家", [("厚奶拿鐵", 59)]), ("：鹽花生焦糖捲蛋糕/友善$34", "全家", [("鹽花生焦糖捲蛋糕", 34)]), ("：楊枝甘露果C果昔 嚐鮮價$79", "萊爾富", [("楊枝甘露果C果昔", 79)]), ("：白蘭氏養蔘元氣凍/折價後$49", "全家", [("白蘭氏養蔘元氣凍", 49)]), ("：法朋蛋黃酥霜淇淋  49 第二隻10元", "7-11", [("法朋蛋黃酥霜淇淋", 49)]),
    ("：褲褲兔中秋款光柵扇/消費滿200免費送", "全家", [("褲褲兔中秋款光柵扇", None)]), ("：炙燒燒肉拌麵89元+5元送可樂", "全家", [("炙燒燒肉拌麵", 89)]), ("：明治指定巧克力兩件8折送手機掛繩", "7-11", [("明治指定巧克力", None)]), ("：廣達香肉鬆飯糰/ 一起結帳不確定價格", "OK", [("廣達香肉鬆飯糰", None)]), ("：光泉優質蛋白牛奶/一起結帳忘記了", "OK", [("光泉優質蛋白牛奶", None)]),
    ("：五窨茉莉茶后 40元限店", "全家", [("五窨茉莉茶后", None)]), ("：世界的山將 - 夢幻唐揚雞 / 單價59", "7-11", [("世界的山將夢幻唐揚雞", 59)]), ("：燻雞起司米披薩卷/79X0.7", "7-11", [("燻雞起司米披薩卷", 79)]), ("：雪淋霜-甜鹽蜜語牛奶/24.5元", "7-11", [("雪淋霜甜鹽蜜語牛奶", 24)]), ("：牧場直送生食鮮蛋/150元", "全家", [("牧場直送生食鮮蛋", 150)]),
    ("：牧場直送4.0花生牛奶雪糕/45元", "全家", [("牧場直送4.0花生牛奶雪糕", 45)]), ("：開運黑糖發糕/59元", "7-11", [("開運黑糖發糕", 59)]), ("：光泉午后時光紅茶39", "全家", [("光泉午后時光紅茶", 39)]), ("：翻轉布丁3入+統一布丁3入/75元", "7-11", [("翻轉布丁", 75)]), ("巧克力+香草霜淇淋/59", "7-11", [("巧克力香草霜淇淋", 59)]),
    ("度小月擔仔炊粉湯 友善時光 56", "全家", [("度小月擔仔炊粉湯", 56)]), ("乖乖玉米脆條-蘋果牛奶、木瓜牛奶雙風味 / 35元", "", [("乖乖玉米脆條蘋果牛奶風味", 35), ("乖乖玉米脆條木瓜牛奶風味", 35)]),
]
_shown = lambda items: "；".join(f"{n}={'' if p is None else p}" for n, p in items)
golden("extract_products", {"field": S, "brand": S}, {"products": S}, [(f, b, _shown(w)) for f, b, w in EXTRACTIONS], lambda f, b: [F.array_join(F.transform(E.extract_products(TX.nfkc(f), b), lambda i: F.concat(i["name"], F.lit("="), F.coalesce(i["price"].cast("string"), F.lit("")))), "；")])
golden(
    "product_names", {"name": S, "brand": S}, {"canonical": S, "key": S, "junk": B, "garbage": B, "condition": B, "bare_form": B},
    [("全家 草莓大福 好吃嗎", "全家", "草莓大福", "草莓大福", False, False, False, False), ("蕃薯起士", "", "地瓜起司", "地瓜起司", False, False, False, False), ("霜淇淋", "", "霜淇淋", "霜淇淋", False, False, False, True), ("冰品", "", "冰品", "冰品", True, False, False, False), ("買六件送杯墊", "", "買六件送杯墊", "買六件送杯墊", False, False, False, False), ("ABC可樂", "", "ABC可樂", "abc可樂", False, False, False, False)],
    lambda n, b: [N.canonical_name(n, b), N.merge_key(N.canonical_name(n, b)), N.is_junk(n), N.is_garbage(n), N.is_condition(n), N.is_bare_form(n)],
)
golden(
    "cleaners", {"text": S}, {"author": S, "title": S, "links": S, "comment": S, "brackets": S},
    [("amy (Amy)", "amy", "amy (Amy)", "amy (Amy)", "amy", "amy  Amy "), ("Re: [商品] 大福", "Re: [商品] 大福", "大福", "Re: [商品] 大福", "Re: 大福", "Re:   大福"), ("看https://a.b/c很好 www.x.y", "看https://a.b/c很好 www.x.y", "看https://a.b/c很好 www.x.y", "看 很好", "看 很好", "看https://a.b/c很好 www.x.y"), ("全家：大福(無糖)。", "全家：大福(無糖)。", "全家：大福(無糖)。", "全家：大福(無糖)。", "大福", "全家：大福 無糖 。"), ("糖(買一送一)", "糖", "糖(買一送一)", "糖(買一送一)", "糖", "糖 ")],
    lambda t: [CL.clean_author(t), CL.title_name(t), CL.strip_links(t), CL.representative_comment(t, F.lit("全家")), CL.unwrap_brackets(t)],
)
golden("parentheses", {"text": S}, {"matched": S}, [("a(b)c", "a(b)c"), ("a(b", "ab"), ("a)b(c)", "ab(c)"), ("((x)", "(x)"), ("", ""), (None, None)], lambda t: [CL.matched_parentheses(t)])
golden(
    "sentence_split", {"text": S}, {"sentences": S},
    [("味道很香。口感偏脆！https", "味道很香。|口感偏脆!|https"), ("第一行\n看 https://a.b\n第二行", "第一行|第二行"), ("好吃\n--\n簽名", "好吃"), ("", ""), (None, ""), ("麵包本體吃起來也軟\n帶點彈牙", "麵包本體吃起來也軟帶點彈牙"), ("【心得】：很香\n※ 發信站\n後面", "很香"), ("甜(?)的，\n我覺得不錯", "甜的,。|我覺得不錯"),
     ("之前吃過一款桃我開心塔是\n\n半顆杏桃搭配硬塔皮，這款\n\n則是杏桃片搭配奶霜蛋糕，\n\n切片後罐頭水蜜桃感降低，\n\n加上柔軟奶霜蛋糕整體很順\n\n口，有點像在吃迷你生日蛋\n\n糕的感覺(?)\n\n--", "之前吃過一款桃我開心塔是半顆杏桃搭配硬塔皮,這款則是杏桃片搭配奶霜蛋糕,切片後罐頭水蜜桃感降低,加上柔軟奶霜蛋糕整體很順口|有點像在吃迷你生日蛋糕的感覺"),
     ("（但補充一下因為還沒烤過之前就吃光了，所以不知道烤過會如何）\n我覺得黑糖味道很濃郁而且不會太甜", "(但補充一下因為還沒烤過之前就吃光了,所以不知道烤過會如何)|我覺得黑糖味道很濃郁而且不會太甜")],
    lambda t: [F.array_join(SN.sentences(TX.nfkc(t)), "|")],
)
golden(
    "sentence_aspects", {"text": S, "name": S}, {"told": S, "named": S, "other_form": B},
    [("滿滿果乾切片軟歐", "滿滿果乾切片軟歐", "", "texture,ingredient", False), ("果乾的確也是滿滿", "滿滿果乾切片軟歐", "ingredient", "texture,ingredient", False), ("這不是一支鹹甜口味的雪糕", "白醋涼麵", "taste", "taste", True), ("奶香很明顯，甜度不高", "", "taste", "taste", False), ("CP 值高", "布丁", "value", "value", False), ("吃起來就是奶油餅乾", "這不是菠蘿麵包", "texture", "texture", True), ("", "", "", "", False)],
    lambda t, n: [F.array_join(SN.aspects(SN.compact(t), SN.product_forms(n)), ","), F.array_join(SN.aspects(SN.compact(t)), ","), SN.of_other_form(SN.compact(t), SN.compact(n))],
)
golden(
    "normal_labels", {"raw": S}, {"sentiment": S, "flag": B, "favoured": S, "target": S},
    [("正向", "positive", None, None, "other"), (" NEG ", "negative", None, None, "other"), ("0", "neutral", False, None, "other"), ("是", None, True, None, "other"), ("本牌", None, None, "own", "own"), ("差不多", None, None, "tie", "other"), ("", None, None, "unknown", "none"), ("no", None, False, None, "other"), (None, None, None, "unknown", "none")],
    lambda t: [LB.sentiment_label(t, strict=False), LB.boolean_label(t, strict=False), LB.favoured_label(t, strict=False), LB.target_label(t)],
)
golden(
    "label_cells", {"candidates": S, "indices": S, "rewrites": S}, {"texts": S, "cited": S, "rewritten": S},
    [("0. a\n1. b", "0|1", '[{"source_index": 1, "text": "x"}]', "a;b", "0;1", "1=x"), ("0. a\n2. b", "1|1", '[{"source_index": 1}]', None, None, None), ("", "", "", "", "", ""), ("a", "-1", "{}", None, None, None), ("0. a b ", "3", '[{"source_index": "1", "text": "x"}]', "a b ", "3", None), (None, "0|1|2|3", "x", "", None, None)],
    lambda c, i, r: [F.array_join(LB.parse_numbered(c), ";"), F.array_join(F.transform(LB.parse_indices(i), lambda x: x.cast("string")), ";"), F.array_join(F.transform(LB.parse_rewrites(r), lambda x: F.concat_ws("=", x["source_index"].cast("string"), x["text"])), ";")],
)
golden(
    "shelf_labels", {"brand": S, "category": S, "confidence": S, "consensus": S, "n_posts": I, "score": I}, {"shown_brand": S, "brand_rank": I, "category_group": S, "volume": S, "percent": I, "tone": S, "score_tone": S, "shown_confidence": S, "note": S},
    [("7-11", "便當", "高", "一致好評", 1, 80, "7-11", 0, "正餐", "中等", 52, "good", "high", "中", "樣本量較充足"), ("全家", "乳品", "高", "評價兩極", 5, 60, "全家", 1, "飲料", "充足", 78, "mixed", "middle", "高", "樣本量較充足"), ("某店", " ", "中", "資料不足", 2, None, "其他", 5, "其他", "不足", 28, "low", "none", "中", "資料仍少，排名已降權，請保守解讀"), ("OK", "鹹食", "低", "一致負評", 1, 10, "OK", 3, "正餐", "不足", 28, "low", "low", "低", "資料仍少，排名已降權，請保守解讀"), ("萊爾富", "車", "中", "褒貶不一", 1, 70, "萊爾富", 2, "其他", "中等", 52, "mixed", "high", "中", "樣本量中等，可作為初步參考")],
    lambda b, c, f, s, n, x: [D.display_brand(b), D.brand_rank(b), D.display_category(c), D.volume_level(f, s, n), D.volume_percent(D.volume_level(f, s, n)), D.consensus_tone(s), D.score_tone(x), D.display_confidence(f, n), D.evidence_note(f, s)],
)
golden(
    "freshness", {"at": TS, "preset": S}, {"age": D2, "stale": B, "shown": S, "offset": I, "starts": DT},
    [("2024-05-01 12:00:00", "1w", 19.5, True, "2024/05/01", 30, "2024-05-14"), ("2024-05-10 20:00:00", "2w", 10.166667, False, "2024/05/11", 39, "2024-05-07"), ("2024-05-07 00:00:00", "1m", 14.0, False, "2024/05/07", 36, "2024-04-21"), (None, "3m", None, False, None, None, "2024-02-21"), ("2024-05-22 00:00:00", "all", -1.0, False, "2024/05/22", 51, None)],
    lambda t, p: (lambda now: [F.round(D.age_days(t, now), 6), D.is_stale(t, now), D.display_date(t), D.date_offset(t, F.lit("2024-04-01")), D.preset_start(p, F.lit("2024-05-21"))])(F.lit("2024-05-21 00:00:00").cast("timestamp")),
)
golden("name_routing", {"text": S}, {"routed": S}, [("草莓好吃", "草莓大福"), ("泡芙不錯", "巧克力泡芙"), ("好吃推薦", None), ("草莓跟泡芙", None), ("", None)], lambda t: [ID.routed(t, F.array(F.lit("草莓大福"), F.lit("巧克力泡芙")))])


def fingerprints(spark, sf_dir):
    """All label layers' keys of documents: their source as brand, language as tag, text as field."""
    t, lang, source = F.col("text"), F.col("lang"), F.col("source")
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(
        "doc_id", FP.sentiment_key(source, lang, t).alias("sentiment"), FP.sentiment_key_v2(source, lang, t, source, lang, lang).alias("sentiment_v2"), FP.product_key(source, lang, t).alias("product"), FP.product_key_v2(source, lang, t, lang).alias("product_v2"),
        FP.excerpt_key(lang, source, t).alias("excerpt"), FP.excerpt_key_v2(lang, source, t, source, lang, lines).alias("excerpt_v2"), FP.picks_key(source, lang, lines, lines, lang).alias("picks"), FP.category_key(source, t).alias("category"), FP.grounding_key(t, source).alias("grounding"),
    )


QUERIES["fingerprints"] = fingerprints
_parts = lambda *p: "sha256(" + " || chr(31) || ".join(p) + ")"
_sq = r"trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g'))"
ORACLES["fingerprints"] = (
    rf"WITH d AS (SELECT doc_id, source, lang, {_sq} AS t, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+', ' ', 'g'))) AS l FROM documents), "
    r"e AS (SELECT *, trim(regexp_replace(t, '[!！?？。．.]+$', '')) AS o, trim(regexp_replace(t, '^[：:]+', '')) AS r, array_to_string(l, chr(30)) AS j FROM d) SELECT doc_id, "
    + ", ".join(
        [
            _parts("source", "lang", "o") + " AS sentiment", _parts("source", "lang", "o", "source", "lang", "lang", "'sentiment-v1'") + " AS sentiment_v2", _parts("source", "lang", "r") + " AS product", _parts("source", "lang", "r", "lang", "'product-name-v1'") + " AS product_v2",
            _parts("lang", "source", "t") + " AS excerpt", _parts("lang", "source", "t", "source", "lang", "j", "'excerpt-v2-rewrite'") + " AS excerpt_v2", _parts("source", "lang", "j || chr(29) || j", "lang", "'comment-picks-v3-aspect-coverage'") + " AS picks", _parts("source", "t", "'product-category-v1'") + " AS category", _parts("t", "source", "'grounding-v1'") + " AS grounding",
        ]
    )
    + " FROM e"
)
