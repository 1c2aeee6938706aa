"""Categories of products: the golden names, the automaton against plain search, labels before words."""

import random

import pandas as pd

from opinara.functions import categories as CT
from opinara.operators import categories as CA
from opinara.operators import fingerprints as FP
from pyspark.sql import functions as F

# Names and their categories.
GOLDEN = {"霜淇淋": "冰品", "拿鐵": "飲料", "蛋糕": "甜點", "可頌": "麵包", "捏捏球": "周邊", "吊飾": "周邊", "動物方城市安全帽": "周邊", "雞排": "鹹食", "unknown_product_xyz": "其他", "導磁不沾鍋": "周邊", "暖心麻油雞鍋": "便當", "韓式部隊鍋": "便當"}


def test_golden_names(spark):
    rows = spark.createDataFrame([(n,) for n in [*GOLDEN, "ＱＱ球", "qq球", "", None]], "name string")
    got = {r["name"]: r["category"] for r in rows.select("name", CA.guess(F.col("name")).alias("category")).collect()}
    assert got == GOLDEN | {"ＱＱ球": "甜點", "qq球": "甜點", "": "其他", None: "其他"}


def test_automaton_equals_plain_search():
    rng = random.Random(4)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(40)] + ["a", "aa", "aaa", "abab"]
    texts = ["".join(rng.choices("abcd", k=rng.randrange(0, 30))) for _ in range(300)] + ["", "d", "a" * 5000]
    found = CA.Automaton(words)
    assert found.contained(texts).tolist() == [[w in t for w in found.words] for t in texts]
    assert CA.Automaton([]).contained(["x"]).shape == (1, 0) and CA.Automaton(["x"]).contained([]).shape == (0, 1)


def plain(name, words):
    best = (None, CT.OTHER)
    for i, (c, ws) in enumerate(words.items()):
        hit = [w for w in ws if w.lower() in name.lower()]
        strong, own = [w for w in hit if w in CT.STRONG.get(c, [])], [w for w in hit if w not in CT.GENERIC]
        score = (len(strong), max(map(len, strong), default=0), len(own), max(map(len, own), default=0), len(hit), -i)
        if hit and (best[0] is None or score > best[0]):
            best = (score, c)
    return best[1]


def test_rules_equal_plain_forms():
    rng = random.Random(9)
    vocabulary = [w for ws in CT.WORDS.values() for w in ws] + ["x", "飯"]
    names = pd.Series(["".join(rng.choices(vocabulary, k=rng.randrange(0, 5))).lower() for _ in range(800)])
    assert CA.Rules(CT.WORDS, CT.STRONG, CT.GENERIC, CT.OTHER).best(names).tolist() == [plain(n, CT.WORDS) for n in names]
    former = CT.former_words()
    assert "周邊" not in former and "洋芋" not in former["便當"]
    first = [next((c for c, ws in former.items() if any(w.lower() in n for w in ws)), CT.OTHER) for n in names]
    assert CA.Rules(former, {}, [], CT.OTHER).first(names).tolist() == first


def test_labels_come_before_words(spark):
    rows = spark.createDataFrame([("7-11", "泰式打拋豬肉飯", ""), ("全家", "泰式打拋豬肉飯", ""), ("7-11", "草莓霜淇淋", None), ("7-11", "人參糯米雞湯", ""), ("7-11", "車", "甜點")], "brand string, name string, given string")
    key = FP.category_key(F.col("brand"), F.col("name"))
    labels = rows.limit(1).select(key.alias("key"), F.explode(F.array(F.lit("零食"), F.lit("便當"), F.lit("無"))).alias("category")).withColumn("line", F.when(F.col("category") == "零食", 1).when(F.col("category") == "便當", 2).otherwise(3))
    got = [r["category"] for r in CA.resolve(rows, labels, key, F.col("given"), F.col("name")).orderBy("name", "brand").collect()]
    assert sorted(got) == sorted(["便當", "其他", "冰品", "其他", "甜點"])
    assert sorted(r["category"] for r in CA.resolve(rows, None, key, None, F.col("name")).collect()) == sorted(["其他", "其他", "冰品", "其他", "其他"])
