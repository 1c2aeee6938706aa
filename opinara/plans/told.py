"""Excerpts and representative comments of parts as products: a part's posts and comments are one of a list of cases, its results one of the list to expect."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import excerpts as X
from .registry import ORACLES, QUERIES
from .standins import table

#: Name, posts (days after the first, text), excerpt.
EXCERPTS = [
    ("", [(0, "我拍的不好看\n但是這個超級好吃\n而且冰淇淋好大一坨\n單價90塊我都會買")], "而且冰淇淋好大一坨。 單價90塊我都會買。"),
    ("", [(0, "看起來很讚\n整體耐吃，應該會再回購！")], "整體耐吃，應該會再回購。"),
    ("這不是菠蘿麵包", [(0, "跟扁可頌一樣的概念吧\n吃起來就是奶油餅乾\n有糖粒感 還蠻涮嘴的")], "吃起來就是奶油餅乾。"),
    ("椒香皮蛋香菜冷麵", [(0, "只有香菜味是有的\n皮蛋我吃完再看才想到\n但是就完全跟預期的落差非常大")], "只有香菜味是有的。"),
    ("", [(0, "免費送但質感做得很不錯")], "免費送但質感做得很不錯。"),
    ("", [(0, "今天路過全家看到新品就買了\n奶香很明顯，甜度不高\n口感滑順但份量有點少\n整體耐吃，應該會再回購！")], "奶香很明顯，甜度不高。 口感滑順但份量有點少。 整體耐吃，應該會再回購。"),
    ("", [(0, "茶味很濃，尾韻帶一點苦味。"), (1, "份量足夠，這個價位算划算。")], "份量足夠，這個價位算划算。 茶味很濃，尾韻帶一點苦味。"),
    ("", [(0, "口感很滑順，奶味也很香。\n--\n推文說價格太貴"), (0, "口感滑順，奶味很香。")], "口感很滑順，奶味也很香。"),
    ("滿滿果乾切片軟歐", [(0, "全家推出了兩款切 片軟歐 優惠券也超級搶手\n滿滿果乾切片軟歐\n果乾的確也是滿滿\n麵包本體吃起來也軟\n帶點彈牙\n但因為麵包本體份量大")], "果乾的確也是滿滿。 麵包本體吃起來也軟帶點彈牙。 但因為麵包本體份量大。"),
    ("嘉義崇文白醋涼麵", [(0, "吃起來很清爽、醋味很解膩，跟一般涼麵比起來就是多了醋味。\n有網路說的超好吃嗎，其實也沒有，但是滿便宜清爽的解決一餐很不錯。\n這不是一支鹹甜口味的雪糕，是單純的鹹而已。\n最後可能是製程關係，末端會有一坨美乃滋。\n有49元想吃冰的話，請去買古娃娃的紅心芭樂雪糕。")], "吃起來很清爽、醋味很解膩，跟一般涼麵比起來就是多了醋味。 有網路說的超好吃嗎，其實也沒有，但是滿便宜清爽的解決一餐很不錯。"),
    ("", [(0, "奶味很香，是整體唯一救贖(。"), (1, ")口感偏硬，我不會再買。")], "口感偏硬，我不會再買。 奶味很香，是整體唯一救贖。"),
    ("", [(0, None)], ""),
]
#: Review, comments (text, whether it speaks of the product, sentiment), comments to show of either side.
REPRESENTATIVES = [
    ("口感滑順但份量有點少", [("超好吃 推薦", True, 0.9), ("超 好吃", True, 0.8), ("難吃", True, -0.8), ("全家: 很香(笑)", True, 0.5), ("口感滑順但份量有點少！", True, 0.5), ("買不到", True, 0.4), ("別家的好", False, 0.4), ("!!!", True, 0.9)], ["超好吃", "很香"], ["難吃"]),
    ("但是這個超級好吃\n而且冰淇淋好大一坨", [("中性", True, 0.0)], ["但是這個超級好吃。"], []),
    ("口感偏硬\n真的難吃", [("不錯", True, 0.6), ("原來這麼雷", True, -0.9), ("我吃過真的難吃", True, -0.9), ("https://a.b/c", True, 0.9), ("看 www.a.b", True, 0.0)], ["不錯"], ["我吃過真的難吃"]),
    (None, [], [], []),
]


def _case(cases: list, k, kind: str):
    """The case of row k, modulo their number."""
    return F.element_at(F.array(*cases).cast(f"array<{kind}>"), (k % len(cases) + 1).cast("int"))


def _posts(spark, sf_dir, names: list[str], posts: list[list[tuple]]):
    texts = [F.array(*[F.struct(F.lit(d).alias("day"), F.lit(t).cast("string").alias("text")) for d, t in p]) for p in posts]
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, _case(list(map(F.lit, names)), k, "string").alias("product_name"), F.posexplode(_case(texts, k, "array<struct<day:int,text:string>>")).alias("n", "p"))
    return rows.select(
        F.struct(F.lit("全家").alias("brand"), k.cast("string").alias("name")).alias("product"), F.concat_ws("_", k, "n").alias("id"), F.lit("全家").alias("brand"), "product_name", F.col("p.text").alias("review_text"),
        F.date_add(F.lit("2026-06-01").cast("date"), F.col("p.day")).cast("timestamp").alias("posted_at"), F.lit(None).cast("double").alias("author_score"), F.array().cast("array<string>").alias("sibling_products"),
    )


def review_excerpts(spark, sf_dir):
    """An excerpt of the posts of each part."""
    posts = _posts(spark, sf_dir, [n for n, _, _ in EXCERPTS], [p for _, p, _ in EXCERPTS])
    return X.excerpts(posts).select(F.col("product.name").cast("long").alias("p_partkey"), "review_excerpt", "review_provisional")


def representative_comments(spark, sf_dir):
    """What commenters, else reviews, say for and against each part, beside its excerpt."""
    posts = _posts(spark, sf_dir, ["" for _ in REPRESENTATIVES], [[(0, r)] for r, *_ in REPRESENTATIVES])
    found = X.pinned(X.candidates(posts))
    said = [F.array(*[F.struct(F.lit(t).alias("text"), F.lit(i).alias("include"), F.lit(s).alias("sentiment")) for t, i, s in c]) for _, c, _, _ in REPRESENTATIVES]
    key = F.col("product.name").cast("long")
    comments = posts.select("product", "brand", "id", F.posexplode(_case(said, key, "array<struct<text:string,include:boolean,sentiment:double>>")).alias("idx", "c")).select("product", "brand", "id", "idx", "c.*")
    out = X.representatives(comments, found, X.excerpts(posts, found=found))
    return out.select(key.alias("p_partkey"), F.array_join("rep_positive", "|").alias("positive"), F.array_join("rep_negative", "|").alias("negative"))


def _oracle(columns: str, rows: list[str]) -> str:
    return f"SELECT p_partkey, {columns} FROM part JOIN (VALUES {', '.join(f'({i}, {r})' for i, r in enumerate(rows))}) v(i, {columns}) ON p_partkey % {len(rows)} = i"


QUERIES["review_excerpts"], QUERIES["representative_comments"] = review_excerpts, representative_comments
ORACLES["review_excerpts"] = _oracle("review_excerpt, review_provisional", [f"'{e}', true" for _, _, e in EXCERPTS])
ORACLES["representative_comments"] = _oracle("positive, negative", [f"'{'|'.join(p)}', '{'|'.join(n)}'" for *_, p, n in REPRESENTATIVES])
