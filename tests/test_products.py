"""Names and products of posts: extraction, clustering, fan-out, and the way to reports, on literal cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from opinara.functions import extract as E, names as N, text as TX
from opinara.operators import identity as ID
from opinara.plans import cases, pipeline


def test_extraction_cases(spark):
    rows = [(i, raw, brand) for i, (raw, brand, _) in enumerate(cases.EXTRACTIONS)]
    got = {r["i"]: [tuple(x) for x in r["p"]] for r in spark.createDataFrame(rows, "i int, raw string, brand string").withColumn("t", TX.nfkc("raw")).select("i", E.extract_products(F.col("t"), F.col("brand")).alias("p")).collect()}
    for i, (raw, _, want) in enumerate(cases.EXTRACTIONS):
        assert got[i] == want, raw


def test_names(spark):
    rows = spark.createDataFrame([("蕃薯起士（大杯）55", "全家"), ("全家 草莓大福 好吃嗎", "全家"), ("草莓大福草莓大福", ""), ("（買一送一）", ""), ("牧場直送4.0", "")], "n string, b string")
    got = [tuple(r) for r in rows.select(N.canonical_name(TX.nfkc("n"), F.col("b")).alias("c"), N.merge_key(F.col("c"))).collect()]
    assert got == [("地瓜起司", "地瓜起司"), ("草莓大福", "草莓大福"), ("草莓大福", "草莓大福"), ("unknown", "unknown"), ("牧場直送4.", "牧場直送4")]
    junk = spark.createDataFrame([("冰品",), ("特價55元",), ("今日價",), ("買六件20元以上冰品飲料免費送",), ("草莓大福",), ("",)], "n string")
    assert [r[0] for r in junk.select(N.is_junk(F.col("n"))).collect()] == [True, True, True, True, False, True]


def brute_clusters(rows):
    out = {}
    for brand in {b for b, _ in rows}:
        clusters = []
        for key in sorted({n for b, n in rows if b == brand}):
            home = next((c for c in clusters if all(ID.alike(key, o) for o in c)), None)
            if home is None:
                clusters.append([key])
            else:
                home.append(key)
        out |= {(brand, k): c[0] for c in clusters for k in c}
    return out


def test_clusters_match_brute_force(spark):
    rng = random.Random(5)
    rows = set()
    for brand in ("x", "y"):
        for _ in range(25):
            name = "".join(rng.choice("草莓抹茶大福捲心酥餅布丁蛋糕霜淇淋冰棒拿鐵紅豆鬆軟脆") for _ in range(rng.randint(3, 9)))
            rows.add((brand, name))
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(name))
                rows.add((brand, name[:k] + rng.choice(["", "香", "酥", "aa"]) + name[k + rng.randint(0, 1) :]))
    rows |= {("z", n) for n in ("草莓抹茶霜淇淋", "抹茶草莓口味冰棒", "草莓抹茶雙色甜筒超長名字版本", "unknown", "abcdefghij", "abcdefghijklmno", "abcdefghijkl")}
    rows = sorted(r for r in rows if r[1])
    got = {(r["brand"], r["name"]): r["cluster"] for r in ID.cluster_names(spark.createDataFrame(rows, "brand string, name string")).collect()}
    assert got == brute_clusters(rows) and len(set(got.values())) < len(got) and got["z", "abcdefghijkl"] == "abcdefghij" and got["z", "草莓抹茶雙色甜筒超長名字版本"] == got["z", "草莓抹茶霜淇淋"]
    assert ID.cluster_names(spark.createDataFrame([], "brand string, name string")).count() == 0


POSTS = """id string, source string, board string, url string, title string, brand string, product_name string, price string, author string, author_score double, review_text string, posted_at timestamp, is_reply boolean, push_count int,
raw struct<fields:map<string,string>>, comments array<struct<tag:string,user:string,text:string,posted_at:timestamp,sentiment:double,backend:string>>"""


def post(id, name, title="[商品] x", brand="全家", price=None, comments=(), author="amy", score=None, is_reply=False, day=1):
    at = dt.datetime(2024, 5, day)
    return (id, "PTT", "CVS", f"u/{id}", title, brand, name, price, author, score, "", at, is_reply, 0, None, [("推", u, t, at, s, None) for u, t, s in comments])


def test_posts_become_products(spark):
    talk = [("bob", "草莓大福好吃", None), ("cat", "泡芙普通", None), ("dan", "好吃推薦", None)]
    rows = [
        post("two", "草莓大福55 巧克力泡芙49", comments=talk), post("one", "草莓大福", comments=talk), post("junk", "特價55元", title="[商品] 全家 紅豆麵包"), post("form", "霜淇淋49", title="[商品] 全家草莓霜淇淋"),
        post("gift", "買六件20元以上冰品飲料免費送", title="[商品] 矽膠杯墊"), post("reply", "切達貝果28元\n--\n巧克力99", is_reply=True), post("none", None, title="Re: [商品]"),
    ]
    frame = spark.createDataFrame(rows, POSTS)
    got = {(r["id"], r["product_name"]): (r["price"], [c["user"] for c in r["comments"]], r["sibling_products"]) for r in ID.split_posts(frame).collect()}
    assert got == {
        ("two_草莓大福", "草莓大福"): ("55", ["bob"], ["巧克力泡芙"]), ("two_巧克力泡芙", "巧克力泡芙"): ("49", ["cat"], ["草莓大福"]), ("one", "草莓大福"): (None, ["bob", "cat", "dan"], []), ("junk", "紅豆麵包"): ("55", [], []),
        ("form", "草莓霜淇淋"): ("49", [], []), ("gift", "矽膠杯墊"): (None, [], []), ("reply", "切達貝果"): ("28", [], []),
    }
    one = ID.find_items(frame.where("id = 'one'"))
    key = one.select(ID.product_key(F.col("brand"), F.col("_title"), F.col("product_name"))).first()[0]
    labels = spark.createDataFrame([(key, 1, "抹茶捲", "60"), (key, 0, "草莓捲", "")], "fingerprint string, item_index int, product_name string, price string")
    got = sorted((r["product_name"], r["price"]) for r in ID.split_posts(frame.where("id = 'one'"), labels).collect())
    assert got == [("抹茶捲", "60"), ("草莓捲", None)]
    empty = spark.createDataFrame([(key, 0, "", "")], "fingerprint string, item_index int, product_name string, price string")
    assert [r["product_name"] for r in ID.split_posts(frame.where("id = 'one'"), empty).collect()] == ["x"] or ID.split_posts(frame.where("id = 'one'"), empty).count() == 0


def test_spellings_share_a_report(spark):
    rows = [
        post("a", "草莓鮮奶油大福 55元", comments=[("bob", "好吃", 1.0), ("cat", "難吃", -1.0)], score=90.0, day=1), post("b", "草莓鮮奶油大福(新品)/59", comments=[("dan", "好吃", 0.8)], day=3), post("c", "原味御飯糰", brand="7-11", comments=[("eve", "比全家的好吃", 0.5)], day=2),
    ]
    got = {r["product_name"]: r for r in pipeline.query(spark.createDataFrame(rows, POSTS), dt.datetime(2024, 5, 4)).collect()}
    r = got["草莓鮮奶油大福"]
    assert len(got) == 2 and (r["n_posts"], r["n_comments"], r["price"], r["n_eligible_comments"], r["n_unique_commenters"], r["post_urls"]) == (2, 3, 59, 3, 3, ["u/a", "u/b"])
    assert r["n_votes"] == 4 and 50 < r["fair_score"] < 90 and got["原味御飯糰"]["own_preferred"] == 1
    assert pipeline.query(spark.createDataFrame(rows, POSTS), dt.datetime(2024, 5, 4), brand="FAMILYMART", recent_days=2).count() == 1
