"""Gold rows, backends compared, intervals of slices, reports and first guesses; the status of an extraction."""

import pytest
from pyspark.sql import functions as F

from opinara.functions import cleaners as CL
from opinara.operators import evaluation as EV, importing as IM, labels as L

GOLD = "post_brand string, comment_tag string, comment_text string, sentiment string, target_brand string, is_comparative string, favored_brand string"


def gold(spark):
    rows = [("全家", "推", "好吃推薦", "正", "本牌", "否", ""), ("全家", "噓", "難吃", "負", "本牌", "0", "無"), ("全家", "→", "小7的比較好吃", "正向", "小7", "是", "他牌"), ("全家", "→", "比小7好吃", "中", "own", "y", "own"), ("全家", "推", "x", "", "", "", "")]
    return EV.gold_rows(spark.createDataFrame(rows, GOLD), ["comment_text", "sentiment"])


def test_backends_and_signals(spark):
    rows = gold(spark)
    assert rows.count() == 4
    with pytest.raises(ValueError, match="no .'missing'"):
        EV.gold_rows(rows, ["missing"])
    with pytest.raises(ValueError, match="unknown backend"):
        EV.backend("snow")
    got = {r["backend"]: (r["n_rows"], r["accuracy"], r["meets_target"], r["small_sample"]) for r in EV.compare_backends(rows, ["lexicon", "tag"]).collect()}
    assert got["tag"] == (4, 0.75, False, True) and got["lexicon"][0] == 4
    told = {(r["comment_text"], r["task"]): (r["gold"], r["pred"]) for r in EV.predictions(rows, ["lexicon"]).collect()}
    assert told["小7的比較好吃", "favoured"] == ("other", "other") and told["小7的比較好吃", "target"] == ("other", "other") and told["比小7好吃", "comparative"] == ("true", "true") and told["好吃推薦", "favoured"] == ("unknown", "unknown")
    per_class = L.class_metrics(EV.predictions(rows, ["tag"]).where("task = 'sentiment'"), "gold", "pred")
    assert EV.confusion_report(per_class).splitlines()[0] == "negative: P 1.0000 R 1.0000 F1 1.0000 n 1"


def test_intervals_hold_the_share_and_stay_the_same(spark):
    rows = spark.range(400).select("id", (F.col("id") % 4).cast("string").alias("pred"), F.lit("0").alias("gold"), (F.col("id") % 100 == 7).alias("rare"))
    got = {(r["slice"], r["rare"]): r for r in EV.sliced_accuracy(rows, [[], ["rare"]], "id").collect()}
    again = {(r["slice"], r["rare"]): r for r in EV.sliced_accuracy(rows.repartition(7), [[], ["rare"]], "id").collect()}
    assert got == again and got["all", None]["accuracy"] == 0.25 and got["all", None]["n_rows"] == 400
    assert 0.19 < got["all", None]["low"] < 0.25 < got["all", None]["high"] < 0.31
    assert got["rare", True]["n_rows"] == 4 and got["rare", True]["small_sample"] and got["rare", True]["accuracy"] == got["rare", True]["low"] == got["rare", True]["high"] == 0.0
    mean = spark.range(20_000).select(F.avg(EV.poisson(EV.unit(F.col("id"), F.lit(1)))).alias("m"), F.variance(EV.poisson(EV.unit(F.col("id"), F.lit(1)))).alias("v")).first()
    assert abs(mean["m"] - 1) < 0.03 and abs(mean["v"] - 1) < 0.06


def test_first_guesses_and_status(spark):
    rows = spark.createDataFrame([(0.5,), (-0.3,), (0.2,), (None,)], "s double")
    assert [r["sentiment"] for r in IM.prelabel(rows, F.col("s")).collect()] == ["positive", "negative", "neutral", "neutral"]
    names = spark.createDataFrame([([],), (["布丁", "35元"],), (["布丁"],)], "n array<string>")
    assert [r[0] for r in names.select(CL.extraction_status(F.col("n"))).collect()] == ["empty", "garbage", "ok"]
