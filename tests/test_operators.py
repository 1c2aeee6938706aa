"""Literal cases of the reference behaviour, and the parts that SQL can't express."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from opinara.functions import attribution as AT, sentiment as SE, text as TX
from opinara.operators import accounts as A, excerpts as X, fingerprints as FP, identity as ID, labels as L, opinions as O, publish as P, shelf as SH, store as S
from opinara.plans import pipeline
from opinara.sources import posts as SP
from opinara.streaming import ingest


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normal_forms(spark):
    assert column(spark, ["ＡＢ①", None, "ﬁ"], TX.nfkc) == ["AB1", None, "fi"]
    assert column(spark, ["  STRASSE ß "], TX.token) == ["strasse ss"]
    assert column(spark, ["好吃 ！！", "a  b\n c。"], TX.override_text) == ["好吃", "a b c"]
    assert column(spark, ["abca", "a", "", "🍔飯🍔"], TX.bigrams) == [["ab", "bc", "ca"], ["a"], [], ["🍔飯", "飯🍔"]]


def test_sentiment(spark):
    rows = spark.createDataFrame([("推", "超好吃"), ("→", "不好吃"), ("→", "奶油餅乾"), ("噓", "踩雷"), ("推 ", None), ("→", "沒有很難吃")], "tag string, text string")
    got = [r[0] for r in rows.select(SE.comment_score(F.col("tag"), F.col("text"))).collect()]
    assert got == [1.0, -0.4, 0.0, round(-0.6 + 0.4 * (-0.9 - 1.0) / 2, 4), 0.6, 0.4]


def test_attribution(spark):
    texts = ["全家這款好吃", "比小7好吃", "小7的比較好吃", "小7也有賣", "cookie 很好吃", "OK", "小7輸全家", "輸小7", "沒有小7好吃"]
    got = column(spark, texts, lambda t: AT.attribution(F.lit("全家"), t, F.lit(-0.5), F.lit("lexicon")))
    assert [g["include"] for g in got] == [True, True, False, False, True, False, True, False, False]
    assert got[1]["sentiment"] == 0.4 and got[1]["own_preferred"] and got[2]["other_preferred"] and not got[3]["other_preferred"]
    kept = column(spark, ["比小7好吃"], lambda t: AT.attribution(F.lit("全家"), t, F.lit(-0.5), F.lit("codex")))
    assert kept[0]["sentiment"] == -0.5
    assert column(spark, ["cookie", "OK的", "全家OK便利", "小七 x", "?"], lambda t: AT.infer_brand(t)) == ["其他", "OK", "全家", "7-11", "其他"]


def test_clusters_do_not_depend_on_order(spark):
    import itertools

    names = ["abcdefghij", "abcdefghijklmno", "abcdefghijkl"]
    for order in itertools.permutations(names):
        frame = spark.createDataFrame([("b", n) for n in order], "brand string, name string")
        got = {r["name"]: r["cluster"] for r in ID.cluster_names(frame).collect()}
        assert got == {"abcdefghij": "abcdefghij", "abcdefghijkl": "abcdefghij", "abcdefghijklmno": "abcdefghijklmno"}


def test_routing(spark):
    names = F.array(F.lit("草莓大福"), F.lit("巧克力泡芙"))
    rows = spark.createDataFrame([("草莓好吃",), ("泡芙不錯",), ("好吃推薦",), ("草莓跟泡芙",)], "text string")
    assert [r["routed"] for r in ID.route(rows.withColumn("n", names), "text", "n").collect()] == ["草莓大福", "巧克力泡芙", None, None]


def test_run_merge(spark):
    rows = spark.createDataFrame([(1, 0, "alice", "推", "第一段"), (1, 1, "alice", "→", "第二段"), (1, 2, "alice", "→", "第三段"), (1, 3, "bob", "→", "x"), (1, 4, "alice", "噓", "y")], "p int, i int, who string, tag string, text string")
    got = sorted((r["first"]["i"], r["who"], r["tag"], r["text"]) for r in A.merge_runs(rows, ("p",), ("i",), "who", "tag", "text").collect())
    assert got == [(0, "alice", "推", "第一段第二段第三段"), (3, "bob", "→", "x"), (4, "alice", "噓", "y")]


def test_votes_and_scores(spark):
    rows = [("p", "fan", "author", 1.0, 1.0, i) for i in range(10)] + [("p", "other", "author", 0.0, 1.0, 99), ("q", "one", "author", 1.0, 1.0, 0)]
    votes = O.one_vote(spark.createDataFrame(rows, "product string, user string, role string, score double, weight double, ord int"))
    got = {r["product"]: r for r in O.fair_scores(O.product_moments(votes)).collect()}
    assert got["p"]["n_eff"] == 2.0 and got["p"]["fair_score"] == 50.0 and got["q"]["fair_score"] == 75.0 and got["q"]["consensus"] == "資料不足"


def test_percentages_and_calibration(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (2.0, 0.0, 6.0)], "a double, b double, c double")
    assert [tuple(r) for r in rows.select(*O.percent_split(F.col("a"), F.col("b"), F.col("c"))).collect()] == [(34, 33, 33), (None, None, None), (25, 0, 75)]
    assert column(spark, [20.0, 50.0, 75.0, 80.0, 0.0, 100.0], lambda x: O.recommendation(x, F.lit(True)), "double") == [0, 50, 92, 100, 0, 100]


def test_bursts(spark):
    day = dt.datetime(2025, 1, 1)
    rows = [("a", "b", i, day + dt.timedelta(minutes=20 * i)) for i in range(5)] + [("c", "b", i, day + dt.timedelta(days=2 * i)) for i in range(5)]
    got = A.burst_flags(spark.createDataFrame(rows, "user_id string, brand string, event_id int, ts timestamp")).groupBy("user_id").agg(F.sum(F.col("burst").cast("int"))).collect()
    assert dict(map(tuple, got)) == {"a": 5, "c": 0}


def test_shill(spark):
    assert column(spark, ["業配吧", "葉配", "專業推文", "營業到幾點", "茶葉蛋好吃", ""], TX.shill) == [True, True, False, False, False, False]
    rows = spark.createDataFrame([("p", True, True)] * 3 + [("p", False, True), ("q", True, True)], "product string, shill boolean, counted boolean")
    assert {r["product"]: (r["shill_ratio"], r["shill_flag"]) for r in P.shill_stats(rows).collect()} == {"p": (0.75, True), "q": (0.0, False)}


def test_windows_and_errors(spark):
    with pytest.raises(ValueError):
        S.TimeWindow(start=dt.date(2025, 2, 1), end=dt.date(2025, 1, 1))
    with pytest.raises(ValueError):
        S.TimeWindow(recent_days=-1, now=dt.datetime(2025, 1, 1))
    with pytest.raises(ValueError):
        O.filter_reports(spark.range(1), min_score=-1)


def test_overrides_and_privacy(spark):
    rows = spark.createDataFrame([("a", "x", 10), ("b", "y", 20), ("c", "z", 30)], "id string, name string, price int")
    overrides = spark.createDataFrame([("a", 1, "n", None, None), ("a", 2, "m", "15", None), ("b", 3, None, "__CLEAR__", None), ("c", 4, None, None, "EXCLUDE")], "id string, line int, name string, price string, exclude string")
    assert sorted(map(tuple, P.apply_overrides(rows, overrides, {"name": "string", "price": "int"}).collect())) == [("a", "m", 15), ("b", "y", None)]
    bad = spark.createDataFrame([("a", 1, None, "cheap", None)], "id string, line int, name string, price string, exclude string")
    with pytest.raises(Exception, match="bad price"):
        P.apply_overrides(rows, bad, {"name": "string", "price": "int"}).collect()
    assert P.public_rows(rows.withColumn("key", F.lit(1))).columns == ["id", "name", "price"]
    with pytest.raises(ValueError):
        P.public_rows(rows.withColumn("x", F.array(F.struct(F.lit("me").alias("user")))))


def test_routing_of_rewrites(spark):
    rows = spark.createDataFrame([("好吃又便宜", "真的好吃便宜"), ("完全無關話題", "abc"), ("", "x"), ("see https://a", "see"), ("另外一句話", "abc")], "text string, source string")
    verdicts = rows.limit(2).select(L.fingerprint(F.col("text"), F.col("source")).alias("key"), F.lit("grounded").alias("verdict"))
    assert [r["status"] for r in L.route(rows, "text", "source", verdicts).orderBy("source", "text").collect()].count("accepted") == 2
    assert sorted(r["status"] for r in L.route(rows, "text", "source").collect()) == ["accepted", "held", "held", "rejected", "rejected"]


def test_shelf_order(spark):
    rows = spark.createDataFrame([("a", 93, 3, 29 * 24.0), ("b", 72, 8, 10 * 24.0), ("c", 84, 5, 20 * 24.0)], "id string, score int, n int, age double")
    recent = [r["id"] for r in rows.orderBy(SH.recent_recommendation(F.col("score"), F.col("n"), F.col("age")).desc()).collect()]
    hot = [r["id"] for r in rows.orderBy(SH.heat(F.col("n"), F.col("age")).desc()).collect()]
    assert recent == hot == ["b", "c", "a"]


PRODUCT = "product struct<brand:string,name:string>"


def test_excerpts(spark):
    rows = [("p", "a", "茶味濃而且不會太甜。\n口感滑順，喝起來很清爽。", 1), ("q", "b", "奶油很輕盈。", 1), ("q", "c", "蛋糕偏甜。", 2), ("r", "d", None, 1)]
    posts = spark.createDataFrame([({"brand": "b", "name": p}, i, "b", "", t, f"2026-06-0{d}", None, []) for p, i, t, d in rows], PRODUCT + ", id string, brand string, product_name string, review_text string, posted_at string, author_score double, sibling_products array<string>").withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    found = X.pinned(X.candidates(posts))
    short = {r["product"]["name"]: r["excerpt"] for r in X.rule_excerpts(found, length=18).collect()}
    assert 0 < len(short["p"]) <= 18 and short["p"].endswith("。") and "r" not in short
    pools = X.body_pools(posts, found)
    key = FP.excerpt_key_v2(F.col("id"), F.col("product_name"), F.col("review_text"), F.col("brand"), F.array_join("sibling_products", " | "), F.col("pool"))
    labels = pools.select("id", key.alias("fingerprint"), F.array(F.lit(0)).alias("source_indices"), F.when(F.col("id") == "b", "奶油輕盈").otherwise("蛋糕太甜了").alias("rewrite"))
    take = lambda given, **kw: {r["product"]["name"]: (r["review_excerpt"], r["review_provisional"]) for r in X.excerpts(posts, given, found, **kw).collect()}
    whole = take(labels.where("id <> 'a'"))
    assert whole["q"] == ("蛋糕太甜了；奶油輕盈", False) and whole["r"] == ("", True) and whole["p"][1]
    assert take(labels.where("id <> 'a'"), length=6)["q"] == ("蛋糕太甜了", False)  # what doesn't fit ends the row
    assert take(labels.where("id = 'b'"))["q"][1]  # one post lacks a label
    assert take(labels.withColumn("source_indices", F.array(F.lit(9))))["q"][1]  # past the pool
    assert take(labels.withColumn("rewrite", F.lit("")))["q"] == ("", False)  # nothing worth telling is a label too
    comments = spark.createDataFrame([], PRODUCT + ", brand string, id string, idx int, text string, include boolean, sentiment double")
    picks = spark.createDataFrame([({"brand": "b", "name": "q"}, ["好", "蛋糕太甜了"], [], [], ["奶油少", "好"])], PRODUCT + ", positive array<string>, negative array<string>, positive_body array<string>, negative_body array<string>")
    got = {r["product"]["name"]: r for r in X.representatives(comments, found, X.excerpts(posts, labels, found), picks).collect()}
    assert (got["q"]["rep_positive"], got["q"]["rep_negative"], got["q"]["rep_provisional"]) == (["好"], ["奶油少"], False)
    assert got["r"]["rep_positive"] == [] and got["r"]["rep_provisional"]
    assert X.excerpts(posts.limit(0)).count() == 0


def test_burst_alerts_equal_batch(spark, tmp_path):
    import random

    rng = random.Random(7)
    # One hot account, one that is at its edges: three events in exactly 24 hours, and three in a second more.
    events = [("hot", "b", int(rng.random() * 20 * 86400)) for _ in range(300)] + [(f"u{rng.randrange(4)}", "b", int(rng.random() * 9 * 86400)) for _ in range(40)]
    events += [("edge", "b", 3600), ("edge", "b", 4000), ("edge", "b", 3600 + 86400), ("past", "b", 3600), ("past", "b", 4000), ("past", "b", 3601 + 86400)]
    rows = [(u, b, i, 1_750_000_000 + t) for i, (u, b, t) in enumerate(events)]
    frame = lambda part: spark.createDataFrame(part, "user_id string, brand string, event_id long, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    rng.shuffle(rows)
    for k in range(3):
        frame(rows[k::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.burst_alerts(stream, late="30 days").writeStream.outputMode("append").format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    told = [r["event"] for r in spark.table("told").collect()]
    expected = {str(r["event_id"]) for r in A.burst_flags(frame(rows)).where("burst").collect()}
    assert len(told) == len(set(told)) and set(told) == expected and 0 < len(expected) < len(rows)


POST = {"id": "1", "title": "全家布丁", "brand": "其他", "product_name": "布丁", "author": "me", "author_score": 80.0, "review_text": "x", "posted_at": "2025-01-01T00:00:00Z", "comments": [{"tag": "推", "user": "u", "text": "好吃"}, {"tag": "推", "user": "me", "text": "自推"}, {"tag": "噓", "user": "v", "text": "小7比較好吃"}]}


def test_store_and_reports(spark, tmp_path):
    store = tmp_path / "posts"
    store.mkdir()
    older = POST | {"posted_at": "2024-01-01T00:00:00Z", "title": "old"}
    (store / "a.jsonl").write_text("\n".join(json.dumps(x) for x in (older, POST)) + "\n")
    posts = SP.read_posts(spark, str(store))
    assert [(r["id"], r["title"], r["brand"]) for r in posts.collect()] == [("1", "全家布丁", "全家")]
    got = pipeline.query(posts, dt.datetime(2025, 1, 1)).collect()
    assert len(got) == 1 and got[0]["n_votes"] == 2 and got[0]["product"]["name"] == "布丁"
    assert (got[0]["review_excerpt"], got[0]["rep_positive"], got[0]["rep_negative"], got[0]["review_provisional"]) == ("x。", ["好吃", "自推"], [], True)
    SP.save_new_posts(spark, posts.unionByName(posts.withColumn("id", F.lit("2"))), str(store))
    assert SP.read_posts(spark, str(store)).count() == 2
    assert SP.bad_lines(spark, str(store)).count() == 0
    (store / "b.jsonl").write_text('{"id": "3", "ti\n')
    assert SP.bad_lines(spark, str(store)).count() == 1
    with pytest.raises(ValueError):
        SP.read_posts(spark, str(store))


def test_label_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("﻿fingerprint,label\nab,1\n", encoding="utf-8")
    assert SP.read_labels(spark, str(tmp_path / "l.csv"), ["fingerprint", "label"]).select("fingerprint", "label").collect() == [("ab", "1")]
    with pytest.raises(ValueError):
        SP.read_labels(spark, str(tmp_path / "l.csv"), ["score"])


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(str(i % 3), dt.datetime(2025, 1, 1, i), "u", "b") for i in range(6)]
    spark.createDataFrame(rows, "id string, posted_at timestamp, user_id string, brand string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("id string, posted_at timestamp, user_id string, brand string").parquet(str(source))
    for name, frame, mode in (("once", ingest.new_once(stream), "append"), ("bursts", ingest.burst_alerts(stream, "posted_at", "id"), "append")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("once").count() == 3 and spark.table("bursts").count() == 6
    held = {}
    run = ingest.upsert_batches(lambda: spark.createDataFrame([("1", 1), ("9", 1)], "id string, v int"), lambda df, n: held.update({n: sorted(map(tuple, df.collect()))}), "id", "v")
    run(spark.createDataFrame([("1", 5), ("1", 7), ("2", 2)], "id string, v int"), 0)
    assert held[0] == [("1", 7), ("2", 2), ("9", 1)]
