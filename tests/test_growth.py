"""What keeps the cost of queries in step with their input: plans without a broadcast of all products, work over all partitions, bounded pairs."""

import random

import pandas as pd
from pyspark.sql import functions as F

from opinara.functions import attribution as AT
from opinara.operators import excerpts as X, identity as ID, similar as SM
from opinara.plans import catalogue
from opinara.streaming import runs as R


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def _posts(spark, n=40):
    rows = spark.range(0, n, 1, 1).withColumn("name", F.col("id").cast("string"))
    return rows.select(
        F.struct(F.lit("b").alias("brand"), "name").alias("product"), F.col("name").alias("id"), F.lit("b").alias("brand"), F.lit("").alias("product_name"), F.lit("茶味濃而且不會太甜。\n口感滑順，喝起來很清爽。").alias("review_text"),
        F.lit("2026-06-01").cast("timestamp").alias("posted_at"), F.lit(None).cast("double").alias("author_score"), F.array().cast("array<string>").alias("sibling_products"),
    )


def test_products_are_never_broadcast(spark):
    posts = _posts(spark)
    found = X.candidates(posts)
    assert found.rdd.getNumPartitions() == 4  # of one partition of posts
    found = X.pinned(found)
    told = X.excerpts(posts, found=found)
    assert "Broadcast" not in _plan(told) and "SortMergeJoin" in _plan(told)
    assert [len(r["review_excerpt"]) > 10 for r in told.collect()] == [True] * 40


def test_texts_in_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(SM, "TILE", 8)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 6))) for _ in range(60)] + ["很好吃😀", "奶茶"]
    texts = []
    for k in range(150):
        text = "".join(rng.choice(words) for _ in range(rng.choice([2, 3, 20, 24, 28])))
        texts += [text, text + rng.choice(words)] if k % 3 == 0 else [text]
    rows = [(rng.choice(["one", "one", "one", "two", "three,0"]), i, t) for i, t in enumerate(texts)] + [("few", 9001, "abcdef"), ("few", 9002, "abcdefg"), ("none", 9003, "a")]
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    want = {(a, b): len(x & y) / len(x | y) for u, a, s in rows for v, b, t in rows if u == v and a < b for x, y in [(pairs(s), pairs(t))] if x and y and len(x & y) / len(x | y) >= 0.8}
    frame = spark.createDataFrame(rows, "u string, i long, t string").select("u", "i", SM.packed_pairs(F.col("t")).alias("p"))
    got = SM.similar_texts(frame, "u", "i", "p", 0.8).collect()
    assert len(want) > 30 and {(r["a"], r["b"]): r["similarity"] for r in got} == want and len(got) == len(want)
    members = SM.similar_texts(frame, "u", "i", "p", 0.8, pairs=False).collect()
    assert sorted(r["id"] for r in members) == sorted({i for pair in want for i in pair})


def test_template_queries_write_no_candidates(spark):
    """A join of texts by the pairs of characters they share made rows with the square of an account's texts."""
    for name, most in (("template_pairs", 1), ("template_ratio", 5)):
        plan = _plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert plan.count("Join ") <= most and "MapInPandas" in plan, name


def test_attribution_marks_a_text_once_in_every_partition(spark):
    frame = catalogue.QUERIES["attribution_cases"](spark, "/root/testdata/sf0.001")
    assert frame.rdd.getNumPartitions() == 4  # of a table of one small file
    said = spark.sql("select '比小7好吃' as t").select(AT.attribution(F.lit("全家"), F.col("t"), F.lit(0.1), F.lit("lexicon")).alias("a")).select("a.*")
    assert said._jdf.queryExecution().optimizedPlan().toString().count("FamilyMart") <= 5  # a pattern of its names, once a field at most


def test_fields_are_read_over_all_partitions(spark):
    posts = spark.range(0, 40, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("title"), F.lit("").alias("brand"), F.lit("抹茶千層59").alias("product_name"), F.lit(False).alias("is_reply"))
    found = ID.find_items(posts)
    assert found.rdd.getNumPartitions() == 4
    assert {(r["items"][0]["name"], r["items"][0]["price"]) for r in found.collect()} == {("抹茶千層", 59)}


def test_stream_sends_few_messages_to_its_state(monkeypatch):
    """A message for each row, or three, made the stream's time."""
    calls = []

    class State:
        def __init__(self):
            self.of = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "get":
                    return list(self.of)
                self.of = [] if name == "clear" else [*self.of, *args[0]] if name == "appendList" else [*self.of, args[0]] if name == "appendValue" else list(args[0])
                return None

            return call

    class Head(State):
        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "get":
                    return self.of or None
                self.of = () if name == "clear" else args[0]

            return call

    class Handle:
        getListState, getMapState, getValueState = (lambda *_: State()), (lambda *_: State()), (lambda *_: Head())
        registerTimer = staticmethod(lambda at: calls.append("timer"))

    class Timer:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    runs = R.Runs(["u"], 10_000_000)
    runs.init(Handle)
    rows = pd.DataFrame({"at": [k * 1_000_000 for k in range(500)], "ord": range(500), "who": ["a" if k < 250 else "b" for k in range(500)], "tag": "→", "text": "x"})
    assert list(runs.handleInputRows((7,), iter([rows[250:], rows[:250]]), Timer(0))) == []
    first = pd.concat(list(runs.handleExpiredTimer((7,), Timer(300_000), None)))
    second = pd.concat(list(runs.handleExpiredTimer((7,), Timer(900_000), None)))
    assert [tuple(r) for r in pd.concat([first, second]).itertuples(index=False)] == [(7, "a", 250, 0, 0, "→", "x" * 250), (7, "b", 250, 250_000_000, 250, "→", "x" * 250)]
    assert len(calls) < 30
