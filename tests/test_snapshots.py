"""Atomic snapshots: killed writes, conflicts, old versions, profiles; backfill of reviews."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from opinara.operators import store as S
from opinara.sources import posts as P, results as R
from opinara.sources.snapshots import Conflict, Snapshots


def test_versions_and_conflicts(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    assert table.read() is None and table.versions() == [] and table.manifest() is None and table.expire() == []
    rows = spark.range(10).withColumn("k", F.col("id") % 2)
    assert table.write(rows, partition_by=("k",), told={"source": "a"}) == 1 and table.manifest()["source"] == "a"
    old = table.read()
    assert table.write(spark.range(3).withColumn("k", F.lit(0).cast("long"))) == 2
    assert table.read().count() == 3 and table.read(version=1).count() == 10 == old.count()
    with pytest.raises(Conflict):
        table.write(rows, expected=1)
    late = Snapshots(spark, str(tmp_path / "t"))
    with pytest.raises(Conflict):
        late._move_in(2, {"folder": "x"})
    with pytest.raises(ValueError):
        table.manifest(7)
    assert len(table.expire(keep=1)) == 1 and table.versions() == [2] and table.read().count() == 3


def test_killed_write_leaves_the_version_before(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    table.write(spark.range(5))
    files = table.read().inputFiles()
    fails = F.udf(lambda i: 1 / (i - 7), "double")
    with pytest.raises(Exception):
        table.write(spark.range(20).select("id", fails("id").alias("x")))
    slow = F.udf(lambda i: time.sleep(0.5) or i, "long")
    problem = []

    def write():
        try:
            spark.sparkContext.setJobGroup("slow", "a write to be killed")
            table.write(spark.range(400).select(slow("id").alias("id")))
        except Exception as e:
            problem.append(e)

    job = threading.Thread(target=write)
    job.start()
    while not spark.sparkContext.statusTracker().getJobIdsForGroup("slow"):
        time.sleep(0.1)
    assert table.versions() == [1] and table.read().inputFiles() == files  # while the other is being written
    spark.sparkContext.cancelJobGroup("slow")
    job.join()
    assert problem and table.versions() == [1] and [r["id"] for r in table.read().orderBy("id").collect()] == list(range(5))
    table.expire(orphans_after=0)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1 and table.read().count() == 5


def test_label_cache_versions(spark, tmp_path):
    path = str(tmp_path / "labels")
    rows = spark.createDataFrame([("b", 'x "y"\nz'), ("a", "1")], "fingerprint string, label string")
    assert P.write_labels(rows, path, "fingerprint") == 1
    assert P.write_labels(P.read_labels(spark, path, ["fingerprint", "label"]).drop("line").where("fingerprint = 'b'"), path, "fingerprint") == 2  # from itself
    assert [tuple(r) for r in P.read_labels(spark, path, ["fingerprint", "label"], exact=True).drop("line").collect()] == [("b", 'x "y"\nz')]


def test_profiles(spark, tmp_path):
    path = str(tmp_path / "p")
    assert R.read_profiles(spark, path) is None
    R.write_profiles(spark.createDataFrame([("u", 3)], "user_id string, total long"), path)
    (r,) = R.read_profiles(spark, path).collect()
    assert (r["user_id"], r["total"], r["credibility"], r["brand_stats"], r["source"], r["lean_brand"]) == ("u", 3, 1.0, {}, "PTT", None)
    with pytest.raises(ValueError):
        R.write_results(spark.createDataFrame([("u", 0.5)], "brand string, suspicion_score double"), str(tmp_path / "r"), None)
    assert R.brand_choices(None) == ["全部"]
    reports = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("b", 1, 1)], "brand string, n_posts long, n_comments long")
    assert R.brand_choices(reports) == ["全部", "b", "a"]


def test_backfill(spark):
    rows = [(1, "u1", "[商品] a", " ", False), (2, "u2", "[商品] b", "", False), (3, "u3", "[商品] c", None, False), (4, "u4", "[商品] d", "there", False), (5, "u5", "Re: x", "", None), (6, "u6", "x", "", True), (7, "off", "x", "", False), (8, "u8", "x", "", False), (9, "u9", "x", "", None)]
    posts = spark.createDataFrame([(*r, "c") for r in rows], "id long, url string, title string, review_text string, is_reply boolean, keep string")
    wanted = S.lacks_review(posts, F.col("url").startswith("u"))
    assert sorted(r["id"] for r in wanted.collect()) == [1, 2, 3, 8, 9]
    tried = S.attempts(wanted, "id", 4)
    fetched = spark.createDataFrame([("u1", "good", None), ("u2", "  ", None), ("u3", None, None), ("u8", None, "timeout"), ("u9", "never tried", None)], "url string, review_text string, problem string")
    got = {r["id"]: (r["review_text"], r["outcome"]) for r in S.backfill(posts, tried, fetched).collect()}
    assert got == {1: ("good", "updated"), 2: ("", "no_review_text"), 3: (None, "non_product"), 4: ("there", "not_tried"), 5: ("", "not_tried"), 6: ("", "not_tried"), 7: ("", "not_tried"), 8: ("", "failed"), 9: ("", "not_tried")}
    assert S.attempts(wanted, "id", None).count() == 5
