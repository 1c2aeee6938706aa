"""One call for demo, stored and page posts; exact lines over split files; a store followed as it grows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from opinara.plans import pipeline
from opinara.sources import board as B, posts as P


def test_exact_lines_over_splits(spark, tmp_path):
    rng = random.Random(8)
    texts = {f"f{k}.jsonl": [rng.choice(["", "x", "é" * rng.randrange(40), "long " * rng.randrange(100)]) for _ in range(60)] for k in range(3)}
    for name, lines in texts.items():
        (tmp_path / name).write_bytes(("\n".join(lines) + ("\n" if name != "f2.jsonl" else "")).encode())
    (tmp_path / "_SUCCESS").write_text("no data\n")
    (tmp_path / "empty").write_text("")
    for split in (333, 1 << 20):
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in B.numbered_lines(spark, str(tmp_path), split).collect()}
        want = {(n, i): t for n, ls in texts.items() for i, t in enumerate(ls, 1) if not (n == "f2.jsonl" and i == len(ls) and not t)}
        assert got == want, split
    assert [r["ended"] for r in B.numbered_lines(spark, str(tmp_path / "f0.jsonl"), 50).where("line = 60").collect()] == [True]


def test_faults_are_told_by_line(spark, tmp_path):
    f = tmp_path / "posts.jsonl"
    f.write_text('{"id": "a", "title": "x", "brand": "OK"}\n\nno json\n{"id": "a", "title": "全家 y", "brand": "OK"}\n{"id": "b", "ti')
    faults = [(r["line"], r["fault"]) for r in B.line_faults(spark, str(f), P.POST_SCHEMA, 10).orderBy("line").collect()]
    assert faults == [(3, "bad"), (5, "cut_off")]
    with pytest.raises(ValueError, match="posts.jsonl:3 bad .*posts.jsonl:5 cut_off"):
        B.open_posts(spark, "stored", str(f))
    f.write_text('{"id": "a", "title": "x", "brand": "OK"}\n\n{"id": "a", "title": "全家 y", "brand": "OK"}\n')
    assert [(r["id"], r["title"], r["brand"]) for r in B.open_posts(spark, "stored", str(f), split=10).collect()] == [("a", "全家 y", "全家")]


def test_kinds_behind_one_call(spark, tmp_path):
    demo = B.open_posts(spark)
    (n,) = demo.agg(F.count("*").alias("p"), F.sum(F.size("comments")).alias("c")).collect()
    assert (n["p"], n["c"]) == (4, 25) and demo.where("author_score is null").count() == 1
    store = str(tmp_path / "store")
    assert P.save_new_posts(spark, demo, store) == 4
    stored = B.open_posts(spark, "stored", store)
    assert sorted(r["id"] for r in stored.collect()) == sorted(r["id"] for r in demo.collect()) and stored.columns == demo.columns
    judged = {(r["id"], r["idx"]): r["eligible"] for r in pipeline.comments(stored.withColumn("product_key", F.col("product_name"))).collect()}
    assert not judged["demo-1", 1] and not judged["demo-4", 5] and not judged["demo-1", 6] and not judged["demo-4", 1] and judged["demo-1", 0]
    pages = tmp_path / "pages"
    pages.mkdir()
    line = '<div class="article-metaline"><span class="article-meta-tag">{}</span><span class="article-meta-value">{}</span></div>'
    for i in range(3):
        title = f"[商品] 全家 布丁{i}" if i else "[公告] x"
        (pages / f"M.{i}.html").write_text(f'<html><div id="main-content">{line.format("作者", "amy (A)")}{line.format("標題", title)}{line.format("時間", "Mon May 13 20:15:30 2024")}\n【商品名稱】布丁{i}\n</div></html>')
    assert sorted((r["id"], r["product_name"], r["brand"], r["author"]) for r in B.open_posts(spark, "pages", str(pages), split=1).collect()) == [("M.1", "布丁1", "全家", "amy"), ("M.2", "布丁2", "全家", "amy")]
    for kind, path in (("crawl", None), ("stored", None)):
        with pytest.raises(ValueError):
            B.open_posts(spark, kind, path)


def test_store_is_followed(spark, tmp_path):
    f = tmp_path / "in" / "posts.jsonl"
    f.parent.mkdir()
    say = lambda *ids: "".join(json.dumps({"id": i}) + "\n" for i in ids)

    def run():
        q = B.follow_posts(spark, str(f.parent)).select("id").writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        q.awaitTermination()
        return sorted(r["id"] for r in spark.read.schema("id string").json(str(tmp_path / "out")).collect())

    f.write_text(say("a", "b") + '{"id": "c')
    assert run() == ["a", "b"]
    with f.open("a") as out:
        out.write('c"}\n' + say("d"))
    (f.parent / "more.jsonl").write_text("broken\n" + say("e"))
    assert run() == ["a", "b", "cc", "d", "e"]
    assert run() == ["a", "b", "cc", "d", "e"]
