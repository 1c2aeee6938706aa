"""A query on the layers of sentiment labels: documents as comments whose short texts repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fingerprints as FP, layers as LY
from .registry import query
from .standins import table


@query("""
WITH d AS (SELECT doc_id, doc_id % 300 AS t FROM documents)
SELECT doc_id, CASE WHEN t % 11 = 0 THEN -0.75 WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 0.5 END WHEN doc_id % 5 = 0 THEN 1.0 WHEN t % 3 = 0 THEN (t % 7 - 3) / 4.0 END AS score,
       CASE WHEN t % 11 = 0 THEN 'codex' WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'llm-backfill' WHEN t % 3 = 0 THEN 'codex-legacy' END AS backend,
       t % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 OR t % 3 = 0 AS labelled FROM d
""")
def label_layers(spark, sf_dir):
    k, t = F.col("doc_id"), F.col("doc_id") % 300
    rows = table(spark, sf_dir, "documents").select("doc_id", k.cast("string").alias("src"), F.concat(F.lit("text  "), t.cast("string"), F.lit("！")).alias("text"), "lang", F.lit("全家").alias("brand"), F.lit("布丁").alias("product"), F.lit("[商品] x").alias("title"))
    args = [F.col(c) for c in ("src", "brand", "product", "title", "lang", "text")]
    old, new = FP.sentiment_key(F.col("src"), F.col("lang"), F.col("text")), FP.sentiment_key_v2(F.col("src"), F.col("lang"), F.col("text"), F.col("brand"), F.col("product"), F.col("title"))
    plain = F.concat(F.lit("text "), t.cast("string"))  # a label file's form of the text: other white space, no end mark
    said = lambda where, score, line=1: rows.where(where).select(plain.alias("text"), score.cast("string").alias("score"), F.lit(line).alias("line"))
    stale = said(t % 3 == 0, F.lit(9), 0)
    legacy = LY.text_labels(said(t % 3 == 0, (t % 7 - 3) / 4.0).unionByName(stale), "text", "score")
    fixed = LY.text_labels(said(t % 11 == 0, F.lit(-0.75)).unionByName(said(t % 11 == 1, F.lit("no number"))), "text", "score")
    prints = rows.where(k % 5 == 0).select(old.alias("fingerprint"), F.lit("3.5").alias("llm_score"), F.lit(None).cast("string").alias("is_relevant"), F.lit(1).alias("line"))
    prints = prints.unionByName(rows.where(k % 7 == 0).select(F.upper(new).alias("fingerprint"), F.when(k % 2 == 1, "0.5").alias("llm_score"), F.when(k % 2 == 0, "False").otherwise("Y").alias("is_relevant"), F.lit(1).alias("line")))
    found = LY.resolve(rows, ["doc_id"], LY.comment_keys(*args), {LY.TEXT: legacy, LY.FINGERPRINT: LY.fingerprint_labels(prints), LY.CORRECTION: fixed})
    return found.select("doc_id", F.col("label.score").alias("score"), F.col("label.backend").alias("backend"), F.col("label").isNotNull().alias("labelled"))
