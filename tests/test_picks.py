"""Comment picks imported: counters, sinks, the ceiling, verdicts that come later, faults of a whole file."""

import json

import pytest
from pyspark.sql import functions as F

from opinara.functions import labelling as LB
from opinara.operators import fingerprints as FP, picks as PK
from opinara.sources.snapshots import Snapshots


def cell(*items):
    return json.dumps([{"source_index": i, "text": t} for i, t in items], ensure_ascii=False) if items else ""


def labelled(spark, rows):
    """(product, positive, negative, positive body, model)"""
    df = spark.createDataFrame([(p, *[x or "" for x in r]) for p, *r in rows], "product_name string, positive_rewrites string, negative_rewrites string, positive_body_rewrites string, model string")
    comments, body = F.array(F.lit("太貴了不會買"), F.lit("布丁很滑順")), F.array(F.lit("焦糖香氣足"))
    version = F.lit(FP.VERSIONS["picks"])
    return df.select(
        FP.picks_key(F.lit("全家"), F.col("product_name"), comments, body, F.lit("雞排")).alias("fingerprint"), F.lit("全家").alias("brand"), "product_name", F.lit("雞排").alias("other_products"), LB.numbered(comments).alias("comments"), LB.numbered(body).alias("body_candidates"),
        "positive_rewrites", "negative_rewrites", "positive_body_rewrites", F.lit("").alias("negative_body_rewrites"), "model", version.alias("prompt_version"),
    )


def test_import_in_one_pass(spark, tmp_path):
    rows = [("好", cell((1, "布丁滑順")), cell((0, "價格偏高")), cell((0, "焦糖香")), "m"), ("空", "", "", "", ""), ("壞", cell((1, "雞排布丁")), "", "", "m")]
    rows += [(f"多{i}", cell((1, "很滑")), "", "", "m") for i in range(3)]
    sent = labelled(spark, [(p, "", "", "", "") for p, *_ in rows])
    back = labelled(spark, rows)
    sinks = [Snapshots(spark, str(tmp_path / n)) for n in ("cache", "rejects", "queue")]
    none = spark.createDataFrame([], "fingerprint string, verdict string")
    with pytest.raises(ValueError, match="1 of 5 rows are rejected.*other product"):
        PK.import_picks(back, sent, none, *sinks)
    assert all(s.versions() == [] for s in sinks)
    counts = PK.import_picks(back, sent, none, *sinks, ceiling=0.5)
    assert counts == {"added": 3, "replaced": 0, "known": 0, "skipped": 1, "rejected": 1, "held": 1}
    assert sinks[0].read().count() == 3
    (bad,) = sinks[1].read(header=True, multiLine=True, escape='"').collect()
    assert bad["product_name"] == "壞" and bad["reject_reason"] == "other product" and bad["comments"] == "0. 太貴了不會買\n1. 布丁很滑順"
    (wait,) = sinks[2].read(header=True, multiLine=True, escape='"').collect()
    assert (wait["rewrite"], wait["source_text"], wait["field"]) == ("價格偏高", "太貴了不會買", "negative_rewrites")
    # A verdict clears what was held; what is stored already is replaced only if asked for.
    verdicts = spark.createDataFrame([(wait["fingerprint"], "grounded")], "fingerprint string, verdict string")
    counts = PK.import_picks(back, sent, verdicts, *sinks, ceiling=0.5, replace=True, model_tag="tag")
    assert counts == {"added": 1, "replaced": 3, "known": 0, "skipped": 1, "rejected": 1, "held": 0}
    assert {r["model"] for r in sinks[0].read().collect()} == {"tag"} and sinks[2].read(header=True).count() == 0 and sinks[2].read(version=1, header=True, multiLine=True, escape='"').count() == 1
    with pytest.raises(ValueError, match="refused.*changed"):
        PK.import_picks(back.withColumn("brand", F.when(F.col("product_name") == "好", "OK").otherwise(F.col("brand"))), sent, none, *sinks, ceiling=0.5)
    faults = {r["fault"] for r in PK.pick_faults(back.withColumn("prompt_version", F.lit("v1")).where("product_name <> '空'"), sent).collect()}
    assert faults == {"changed", "dropped", "version"}
