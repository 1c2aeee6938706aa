"""Label layers, categories and the payload, through reports of the demo's posts; rows for human labels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opinara.operators import excerpts as X, fingerprints as FP, labelling_rows as LR, layers as LY, publish as P
from opinara.operators.store import pinned
from opinara.plans import pipeline
from opinara.sources import board

AS_OF = dt.datetime(2024, 5, 10)


def test_layers_reach_the_scores(spark):
    posts = board.open_posts(spark)
    spark_rows = lambda rows, schema: spark.createDataFrame(rows, schema)
    text = LY.text_labels(spark_rows([("好吃推薦!!", "-1", 1), ("甜度剛好", "0.2", 1), ("珍珠好吃", "0.9", 1)], "t string, s string, line int"), "t", "s")
    key = lambda tag, said, post, product, title, brand: (F.lit(f"https://board.example/{post}.html"), F.lit(tag), F.lit(said), F.lit(brand), F.lit(product), F.lit(title))
    one = spark.range(1)
    pearl = one.select(FP.sentiment_key_v2(*key("推", "珍珠好吃", "demo-3", "黑糖珍珠雪糕", "[商品] 7-11 黑糖珍珠雪糕", "7-11")).alias("fingerprint"), F.lit("0.5").alias("llm_score"), F.lit("true").alias("is_relevant"), F.lit(1).alias("line"))
    sweet = one.select(FP.sentiment_key(*key("→", "甜度剛好", "demo-1", "", "", "")[:3]).alias("fingerprint"), F.lit("").alias("llm_score"), F.lit("no").alias("is_relevant"), F.lit(1).alias("line"))
    prints = LY.fingerprint_labels(pearl.unionByName(sweet))
    fixed = LY.text_labels(spark_rows([("驚豔", "-0.5", 1)], "t string, s string, line int"), "t", "s")
    layers = {LY.TEXT: text, LY.FINGERPRINT: prints, LY.CORRECTION: fixed}
    rows = pipeline.products(posts)
    got = {r["text"]: (r["s"], r["backend"], r["eligible"]) for r in pipeline.comments(rows, layers).collect()}
    assert got["好吃推薦"] == (-1.0, LY.TEXT, True) and got["珍珠好吃"] == (0.5, LY.FINGERPRINT, True)
    assert got["甜度剛好"] == (None, LY.FINGERPRINT, False) and got["驚豔"] == (-0.5, LY.CORRECTION, True) and got["失望"][1] == "lexicon"
    category = one.select(FP.category_key(F.lit("全家"), F.lit("海鹽焦糖布丁")).alias("key"), F.lit("零食").alias("category"), F.lit(1).alias("line"))
    # A labeller's picks count only while what was shown is what is shown now.
    product = F.struct("brand", F.col("product_key").alias("name")).alias("product")
    split = pinned(rows.withColumn("product", product))
    names = split.select("product", F.col("name").alias("product_name")).distinct()
    shown = pinned(X.shown_for_picks(split, pipeline.spoken(pipeline.judged(split, layers)), X.candidates(split), names))
    pudding_row = next(r for r in shown.collect() if "布丁" in r["product_name"])
    assert pudding_row["comments"][:1] == ["好吃推薦"] and pudding_row["body_candidates"]
    stale = [("0" * 64, '[{"source_index": 0, "text": "舊的"}]', "")]
    cache = spark_rows([(pudding_row["fingerprint"], '[{"source_index": 0, "text": "大家都推"}]', "")] + stale, "fingerprint string, positive_rewrites string, negative_rewrites string").withColumns({c: F.lit("") for c in ("positive_body_rewrites", "negative_body_rewrites")})
    found = pinned(pipeline.reports(posts, AS_OF, sentiments=layers, categories=category, picks=cache))
    after = {r["product_name"]: r for r in found.collect()}
    assert len(after) == 4 and sum("大家都推" in r["rep_positive"] for r in after.values()) == 1 and not any("舊的" in r["rep_positive"] for r in after.values())
    pudding = next(n for n in after if "布丁" in n)
    assert after[pudding]["n_eligible_comments"] == 4  # one each of kai, zoe, lulu and noa
    assert after[pudding]["category"] == "零食" and next(r for n, r in after.items() if "雪糕" in n)["category"] == "冰品"
    # And on to what is published.
    chicken = next(n for n in after if "雞排" in n)
    overrides = spark_rows([(f"萊爾富::{chicken}", 1, "EXCLUDE", None, None, None, None), (f"全家::{pudding}", 1, None, None, None, "49", None)], "id string, line int, exclude string, product_name string, category string, price string, excerpt string")
    excerpts = found.where(F.col("product_name") == pudding).select(F.col("product.name").alias("product_key"), F.lit("人工摘錄").alias("excerpt"))
    shown = pipeline.payload(found, overrides, excerpts)
    assert not P.contract_faults(shown)
    public = {r["product_name"]: r for r in shown.collect()}
    assert set(public) == set(after) - {chicken} and public[pudding]["price"] == 49 and public[pudding]["excerpt"] == "人工摘錄"
    assert all(r["fair_score"] is not None for n, r in public.items() if r["confidence"] != "低") and public[pudding]["category"] == "零食"
    assert pipeline.payload(found.limit(0)).count() == 0


def test_labelling_rows(spark):
    posts = board.open_posts(spark)
    rows = LR.labelling_rows(posts)
    assert rows.columns == [*LR.COLUMNS, "around"] and rows.count() == 25 and all(k == "string" for _, k in rows.dtypes)
    (r,) = rows.where("comment_id = 'demo-1#001'").collect()
    assert r["context"] == "貼文品牌=全家; 商品=海鹽焦糖布丁; tag=商品; 價格=45; 標題=[商品] 全家 海鹽焦糖布丁" and r["comment_posted_at"] == "2024-05-01T12:10:00" and r["sentiment"] == ""
    assert r["around"] == "推 kai: 好吃推薦\n>推 mimi: 我自己先推\n→ kai: 甜度剛好\n噓 zoe: 太甜了不好吃"
    assert [x["comment_posted_at"] for x in rows.where("comment_id = 'demo-1#002'").collect()] == [""]
    first = [x["comment_id"] for x in LR.labelling_sample(rows, 7, seed=3).collect()]
    assert first == [x["comment_id"] for x in LR.labelling_sample(rows.repartition(9), 7, seed=3).collect()] and len(set(first)) == 7
    assert first != [x["comment_id"] for x in LR.labelling_sample(rows, 7, seed=4).collect()]
    with pytest.raises(ValueError):
        LR.labelling_sample(rows, -1)


def test_overrides_become_canonical(spark):
    rows = spark.createDataFrame([("好吃!", "0.5", 1), ("好吃", "0.9", 2), ("好吃。", "0.5", 3), ("普通", "0.1", 4), ("普通!!", "0.2", 5), ("  ", "1", 6), ("壞", "x", 7)], "t string, s string, line int")
    got = [tuple(r) for r in LY.canonical_overrides(rows, "t", "s").orderBy("line").collect()]
    assert got == [("好吃", 0.5, 3, True, 1), ("普通", 0.1, 2, True, 4)]


def test_selection_and_brands(spark):
    posts = board.open_posts(spark)
    posts = posts.withColumn("comments", F.transform("comments", lambda c: c.withField("at", c["posted_at"].cast("timestamp_ntz")))).withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz"))
    chosen = pipeline.select_posts(posts, start=dt.date(2024, 5, 2), end=dt.date(2024, 5, 3))
    assert sorted(r["id"] for r in chosen.collect()) == ["demo-2", "demo-3"]
    assert [tuple(r) for r in pipeline.brands_of(posts).collect()] == [("7-11", 2, 2, 12), ("全家", 1, 1, 7), ("萊爾富", 1, 1, 6)]
    found = pipeline.answer(posts.withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz")), AS_OF, end=dt.date(2024, 5, 1), brand="全家", min_posts=1)
    assert found.filters == {"brand": "全家", "start": None, "end": "2024-05-01T23:59:59.999999", "recent_days": None, "min_posts": 1}
    assert [r["brand"] for r in found.brands.collect()] == ["全家"]
