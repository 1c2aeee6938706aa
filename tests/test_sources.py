"""Pages, stores and snapshots, on small files of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opinara.operators import importing as I, labels as L
from opinara.sources import posts as P, results as R, threads as TH

PAGE = """<html><body><div id="main-content" class="bbs-screen"><div class="article-metaline"><span class="article-meta-tag">作者</span><span class="article-meta-value">amy (Amy &amp; co)</span></div>
<div class="article-metaline-right"><span class="article-meta-tag">看板</span><span class="article-meta-value">CVS</span></div><div class="article-metaline"><span class="article-meta-tag">標題</span><span class="article-meta-value">[商品] 全家 草莓大福</span></div>
<div class="article-metaline"><span class="article-meta-tag">時間</span><span class="article-meta-value">Tue Dec 31 20:15:30 2024</span></div>
【商品名稱】草莓大福
【便利商店/廠商名稱】全家
【商品價格】49元
【評分】8/10
【心得】很好吃
第二行
<span class="f2">※ 發信站</span>
<div class="push"><span class="hl push-tag">→ </span><span class="f3 hl push-userid">bob</span><span class="f3 push-content">: 第一段</span><span class="push-ipdatetime"> 12/31 21:00
</span></div><div class="push"><span class="hl push-tag">推 </span><span class="f3 hl push-userid">bob</span><span class="f3 push-content">: 第二段</span><span class="push-ipdatetime"> 12/31 21:01</span></div>
<div class="push"><span class="f1 hl push-tag">噓 </span><span class="f3 hl push-userid">cat</span><span class="f3 push-content">: 難吃 &lt;3</span><span class="push-ipdatetime"> 01/01 00:05</span></div></div></body></html>"""
LIST = """<div class="r-ent"><div class="nrec"><span class="hl">爆</span></div><div class="title"><a href="/bbs/CVS/M.1.html">[商品] A</a></div><div class="meta"><div class="author">amy</div><div class="date">12/31</div></div></div>
<div class="r-ent"><div class="nrec"></div><div class="title"><a href="/bbs/CVS/M.2.html">[情報] B</a></div><div class="meta"><div class="author">bob</div><div class="date">12/31</div></div></div>
<div class="r-ent"><div class="nrec"></div><div class="title">(本文已被刪除)</div></div><a class="btn wide" href="/bbs/CVS/index9.html">&lsaquo; 上頁</a>"""


def test_thread_pages(spark):
    pages = spark.createDataFrame([("https://x.cc/bbs/CVS/M.1.A.html", PAGE), ("u", PAGE.replace("[商品]", "[情報]")), ("v", None), ("w", "")], "url string, html string")
    (r,) = TH.parse_threads(pages).collect()
    assert (r["id"], r["brand"], r["product_name"], r["price"], r["author"], r["author_score"], r["is_reply"]) == ("M.1.A", "全家", "草莓大福", "49元", "amy", 80.0, False)
    assert r["review_text"].split() == ["很好吃", "第二行"] and r["posted_at"] == dt.datetime(2024, 12, 31, 20, 15, 30)
    assert [(c["tag"], c["user"], c["text"], c["posted_at"]) for c in r["comments"]] == [("推", "bob", "第一段第二段", dt.datetime(2024, 12, 31, 21, 0)), ("噓", "cat", "難吃 <3", dt.datetime(2025, 1, 1, 0, 5))]


def test_list_pages(spark):
    pages = spark.createDataFrame([(1, LIST), (2, "")], "n long, html string")
    rows = TH.parse_lists(pages, "https://x.cc").collect()
    assert [(r["title"], r["url"], r["author"], r["date"], r["push_count"]) for r in rows] == [("[商品] A", "https://x.cc/bbs/CVS/M.1.html", "amy", "12/31", "爆")]
    assert [r[0] for r in pages.orderBy("n").select(TH.previous_page(F.col("html"), "https://x.cc")).collect()] == ["https://x.cc/bbs/CVS/index9.html", None]


def test_post_store(spark, tmp_path):
    path = str(tmp_path / "posts")
    posts = TH.parse_threads(spark.createDataFrame([("https://x.cc/M.1.html", PAGE), ("https://x.cc/M.2.html", PAGE)], "url string, html string"))
    assert P.save_new_posts(spark, posts, path) == 2 and P.save_new_posts(spark, posts, path) == 0
    back = P.read_posts(spark, path).orderBy("id").collect()
    assert [(r["id"], r["brand"], len(r["comments"]), r["raw"]["fields"]["商品價格"]) for r in back] == [("M.1", "全家", 2, "49元"), ("M.2", "全家", 2, "49元")]
    lines = tmp_path / "lines.jsonl"
    lines.write_text('{"id":"a","title":"x","price":"1"}\n\n{"id":"b","price":"2"}\n{"id":"a","title":"x","price":"3"}\n', encoding="utf-8")
    assert {r["id"]: r["price"] for r in P.read_posts(spark, str(lines)).collect()} == {"a": "3", "b": "2"}  # the last line wins
    lines.write_text('{"id":"a"}\n{"id":"b","pri', encoding="utf-8")
    with pytest.raises(ValueError, match="cut off"):
        P.read_posts(spark, str(lines))
    with pytest.raises(ValueError, match="bad lines"):
        P.save_new_posts(spark, posts, str(lines))
    assert [r["id"] for r in P.read_posts(spark, str(lines), strict=False).collect()] == ["a"]


def test_results_snapshot(spark, tmp_path):
    path = str(tmp_path / "results")
    assert R.read_results(spark, path) is None and R.results_or_none(spark, None) is None
    reports = spark.createDataFrame([("b", "n", 7, [("amy",)])], "brand string, product_name string, n_comments long, contributors array<struct<user:string>>")
    R.write_results(reports, path, dt.datetime(2024, 1, 2))
    (r,) = R.read_results(spark, path).collect()
    assert (r["n_unique_commenters"], r["review_provisional"], r["consensus"], r["post_urls"], r["generated_at"]) == (7, True, "資料不足", [], dt.datetime(2024, 1, 2))
    assert "amy" not in "".join(x["value"] for x in spark.read.text(path).collect())
    with pytest.raises(ValueError, match="accounts"):
        R.write_results(reports.withColumn("rows", F.array(F.struct(F.lit(1.0).alias("suspicion_score")))), path, dt.datetime(2024, 1, 2))


def test_label_files(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('﻿fingerprint,score\nk1,"a\nb"\nk2,2\nk1,3\n', encoding="utf-8")
    rows = P.read_labels(spark, str(f), ["fingerprint", "score"], exact=True)
    assert {r["fingerprint"]: r["score"] for r in L.last_per_key(rows, "fingerprint", "line").collect()} == {"k1": "3", "k2": "2"}
    with pytest.raises(ValueError, match="order"):
        P.read_labels(spark, str(f), ["score", "fingerprint"], exact=True)
    with pytest.raises(ValueError, match="lacks"):
        P.read_labels(spark, str(f), ["fingerprint", "model"])
    P.write_labels(rows.drop("line"), str(tmp_path / "out"), "fingerprint")
    assert spark.read.option("header", True).option("multiLine", True).csv(P.label_files(spark, str(tmp_path / "out"))).count() == 3


def test_whole_file_faults(spark):
    source = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "k string, brand string")
    labelled = spark.createDataFrame([("a", "1", 0), ("a", "1", 2), ("b", "2", 0), ("x", "1", 0), ("d", "1", 0), ("d", "1", 0)], "k string, brand string, i int")
    got = sorted(tuple(r) for r in I.file_faults(labelled, source, "k", ["brand"], "i").collect())
    assert got == [("a", "gap"), ("b", "changed"), ("c", "dropped"), ("d", "gap"), ("d", "repeated"), ("x", "unknown")]
    with pytest.raises(ValueError, match="refused"):
        I.refuse_if(I.file_faults(labelled, source, "k", ["brand"], "i"))
    I.refuse_if(I.file_faults(source.withColumn("i", F.lit(0)), source, "k", ["brand"], "i"))


def test_excerpt_import_routes_and_merges(spark):
    from opinara.operators.fingerprints import grounding_key

    columns = "fingerprint string, product_name string, candidate_sentences string, source_indices string, rewrite string, other_products string, model string"
    texts = "0. 草莓很甜很好吃\n1. 有點貴"
    rows = spark.createDataFrame(
        [("a", "p", texts, "0", "草莓很甜", "", "m"), ("b", "p", texts, "1", "價格偏高", "", "m"), ("c", "p", texts, "1", "售價略高", "", "m"), ("d", "p", texts, "0", "布丁糟糕", "", "m"), ("e", "p", texts, "5", "草莓", "", "m"),
         ("f", "p", texts, "", "", "", ""), ("g", "p", texts, "0", "大福 草莓很甜", "泡芙 | 大福", "m"), ("h", "p", "0. x\n2. y", "0", "x", "", "m"), ("i", "p", texts, "0|1", "草莓很甜http://x", "", "m"), ("j", "p", texts, "", "多餘", "", "m")], columns)
    verdicts = spark.createDataFrame([("售價略高", "有點貴", "grounded"), ("布丁糟糕", "草莓很甜很好吃", "ungrounded")], "r string, s string, verdict string").select(grounding_key(F.col("r"), F.col("s")).alias("fingerprint"), "verdict")
    routed = I.excerpt_rows(rows, verdicts)
    got = {r["fingerprint"]: (r["status"], r["reason"]) for r in routed.collect()}
    assert got["a"] == ("accepted", None) == got["c"] and got["b"] == ("held", None) and got["f"] == ("skipped", None)
    assert {k: got[k][1] for k in "deghij"} == {"d": "ungrounded", "e": "index beyond the candidates", "g": "other product", "h": "indices", "i": "link", "j": "rewrite without source"}
    assert [r["rewrite"] for r in I.pending(routed, "rewrite").collect()] == ["價格偏高"]
    cache = spark.createDataFrame([("a", "old"), ("z", "kept")], "fingerprint string, rewrite string")
    with pytest.raises(ValueError, match="refused"):
        I.import_rows(routed, cache, ["fingerprint"])
    done = I.import_rows(routed, cache, ["fingerprint"], ceiling=0.9)
    assert dict(map(tuple, done.merged.collect())) == {"a": "old", "z": "kept", "c": "售價略高"} and tuple(done.counts.first()) == (1, 0, 1, 6, 1)
    done = I.import_rows(routed, cache, ["fingerprint"], replace=True, ceiling=0.9)
    assert dict(map(tuple, done.merged.collect())) == {"a": "草莓很甜", "z": "kept", "c": "售價略高"} and tuple(done.counts.first()) == (1, 1, 1, 6, 1)


def test_other_layers(spark):
    key = "a" * 64
    s = spark.createDataFrame([(key, "0.5", "正向", "是"), (key, "2", "pos", "1"), ("x", "0", "neu", "0"), (key, "", "", ""), (key, "0", "好", "1"), (key, "0", "中", "maybe")], "fingerprint string, llm_score string, llm_label string, is_relevant string")
    assert [(r["status"], r["reason"]) for r in I.sentiment_rows(s).collect()] == [("accepted", None), ("rejected", "score"), ("rejected", "key"), ("skipped", None), ("rejected", "label"), ("rejected", "relevance")]
    p = spark.createDataFrame([("", "", "m"), ("", "", ""), ("n", "x", "m"), ("n", "35", "")], "product_name string, price string, model string")
    assert [r["status"] for r in I.product_rows(p).collect()] == ["accepted", "skipped", "rejected", "accepted"]
    c = spark.createDataFrame([("冰品",), ("車",), ("",)], "category string")
    assert [r["status"] for r in I.category_rows(c, ["冰品"]).collect()] == ["accepted", "rejected", "skipped"]
    v = spark.createDataFrame([("Grounded",), ("?",), (None,)], "verdict string")
    assert [r["status"] for r in I.verdict_rows(v).collect()] == ["accepted", "rejected", "skipped"]
    one, two = '[{"source_index": 0, "text": "a"}]', '[{"source_index": 1, "text": "b"}]'
    k = spark.createDataFrame([(one, two, "m"), (one, one, "m"), ("", "", ""), ("{}", "", "m"), ('[{"source_index": "0", "text": "a"}]', "", "m"), ('[{"source_index": 0, "text": "a", "x": 1}]', "", "m")], "positive_rewrites string, negative_rewrites string, model string")
    assert [(r["status"], r["reason"]) for r in I.pick_rows(k).collect()] == [("accepted", None), ("rejected", "both polarities"), ("skipped", None), ("rejected", "positive"), ("rejected", "positive"), ("rejected", "positive")]


def test_relabels_and_rebuilt_excerpts(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "k string, s double")
    new = spark.createDataFrame([("b", 0.5), ("b", 0.5), ("c", -1.0)], "k string, s double")
    assert dict(map(tuple, I.merge_relabels(old, new, "k", "s").collect())) == {"a": 1.0, "b": 0.5, "c": -1.0}
    with pytest.raises(ValueError, match="conflicting"):
        I.merge_relabels(old, new.unionByName(old), "k", "s")
    reports = spark.createDataFrame([("a", "old", True, 3), ("b", "old", True, 4)], "k string, review_excerpt string, review_provisional boolean, n int")
    rebuilt = spark.createDataFrame([("a", "new", False), ("b", "x", True)], "k string, review_excerpt string, review_provisional boolean")
    assert sorted(map(tuple, I.replace_excerpts(reports, rebuilt, "k").collect())) == [("a", "new", False, 3), ("b", "x", True, 4)]
    with pytest.raises(ValueError, match="differ"):
        I.replace_excerpts(reports, rebuilt.where("k = 'a'"), "k")
