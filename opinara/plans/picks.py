"""A query on the import of comment picks: a labelled row per document, with every kind of fault by its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fingerprints as FP, picks as PK
from ..functions import labelling as LB
from .registry import query
from .standins import table

#: doc_id modulo 16: positive rewrites, negative rewrites, body rewrites (positive), model. The candidates are the document's language, source and number.
CASES = {
    0: ("", "", "", ""), 1: ('[{"source_index": 0, "text": "lang de"}]', "", "", "m"), 2: ("{}", "", "", "m"), 3: ('[{"source_index": 9, "text": "lang"}]', "", "", "m"), 4: ('[{"source_index": 0, "text": "lang"}]', '[{"source_index": 0, "text": "lang"}]', "", "m"),
    5: ('[{"source_index": 0, "text": "qqq"}]', "", "", "m"), 6: ('[{"source_index": 0, "text": "xyz"}]', "", "", "m"), 7: ('[{"source_index": 0, "text": "see www.lang"}]', "", "", "m"), 8: ('[{"source_index": 0, "text": "lang"}]', "", "", ""),
    9: ("", '[{"source_index": 1, "text": "source src"}]', '[{"source_index": 0, "text": "number"}]', "m"), 10: ('[{"source_index": 0, "text": "lang lang lang lang lang lang lang"}]', "", "", "m"), 11: ('[{"source_index": 0, "text": ""}]', "", "", "m"), 12: ('[{"source_index": 0, "text": "the other one lang"}]', "", "", "m"),
    13: ('[{"source_index": 0, "text": "zzz"}]', "", "", "m"), 14: ("", "", "", "m"), 15: ('[{"source_index": 0, "text": "。。"}]', "", "", "m"),
}
EXPECTED = {
    0: ("skipped", None), 1: ("accepted", None), 2: ("rejected", "malformed positive_rewrites"), 3: ("rejected", "index beyond the candidates"), 4: ("rejected", "comment in both polarities"), 5: ("held", None), 6: ("rejected", "ungrounded"), 7: ("rejected", "link"), 8: ("rejected", "no model"), 9: ("accepted", None),
    10: ("rejected", "too long"), 11: ("rejected", "source without rewrite"), 12: ("rejected", "other product"), 13: ("accepted", None), 14: ("accepted", None), 15: ("rejected", "no letters"),
}


def labelled(spark, sf_dir):
    k = (F.col("doc_id") % 16).cast("int")
    cell = lambda i: F.element_at(F.array(*[F.lit(CASES[n][i]) for n in range(16)]), k + 1)
    comments = F.array(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("source "), "source"))
    body = F.array(F.concat(F.lit("number "), F.col("doc_id").cast("string")))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("brand"), F.col("doc_id").cast("string").alias("product_name"), F.lit("the other one|").alias("other_products"), LB.numbered(comments).alias("comments"), LB.numbered(body).alias("body_candidates"), F.lit(FP.VERSIONS["picks"]).alias("prompt_version"),
        FP.picks_key(F.col("source"), F.col("doc_id").cast("string"), comments, body, F.lit("the other one|")).alias("fingerprint"), cell(0).alias("positive_rewrites"), cell(1).alias("negative_rewrites"), cell(2).alias("positive_body_rewrites"), F.lit("").alias("negative_body_rewrites"), cell(3).alias("model"),
    )
    verdict = lambda word, said: rows.select(FP.grounding_key(F.lit(word), F.concat(F.lit("lang "), F.expr("split(comments, '\n')[0]").substr(9, 9))).alias("fingerprint"), F.lit(said).alias("verdict")).distinct()
    return rows, verdict("xyz", "ungrounded").unionByName(verdict("zzz", "grounded"))


@query("SELECT doc_id, CASE doc_id % 16 " + " ".join(f"WHEN {n} THEN '{s}'" for n, (s, _) in EXPECTED.items()) + " END AS status, CASE doc_id % 16 " + " ".join(f"WHEN {n} THEN '{r}'" for n, (_, r) in EXPECTED.items() if r) + """ END AS reason, CASE WHEN doc_id % 16 = 5 THEN 'qqq < lang ' || lang ELSE '' END AS waiting FROM documents""")
def pick_import(spark, sf_dir):
    rows, verdicts = labelled(spark, sf_dir)
    return PK.judged(rows, verdicts).select("doc_id", "status", "reason", F.array_join(F.transform("waiting", lambda w: F.concat(w["rewrite"], F.lit(" < "), w["source_text"])), ";").alias("waiting"))
