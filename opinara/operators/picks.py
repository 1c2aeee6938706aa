"""Importing comment picks: every rewrite checked by all rules, rows routed to sinks of their own in one pass that also counts them.

A labelled file is refused as a whole if it isn't the file that was sent out. A row with a bad rewrite is rejected; one whose only fault is that too few characters of a
rewrite stand in what it cites waits for a verdict; one that nobody filled in is skipped. All rows are judged once: they are written by status,
with counts observed in the same job, and what comes after (the ceiling, the cache, the rejects, the queue) reads only its own status.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .. import config as C
from ..functions import labelling as LB, text as TX
from ..sources.snapshots import Snapshots
from . import fingerprints as FP, importing as IM
from .store import shared_folder

#: The file's rewrites and the candidates that each of them cites.
FIELDS = {"positive_rewrites": "comments", "negative_rewrites": "comments", "positive_body_rewrites": "body_candidates", "negative_body_rewrites": "body_candidates"}
IMMUTABLE = ["brand", "product_name", "other_products", "comments", "body_candidates", "prompt_version"]
CACHE = ["fingerprint", "brand", "product_name", *FIELDS, "model", "prompt_version"]
FLOOR = 0.25
KINDS = ("accepted", "rejected", "held", "skipped")


def _candidates(cell: str) -> Column:
    return LB.parse_numbered(F.col(cell))


def pick_faults(labelled: DataFrame, source: DataFrame) -> DataFrame:
    """fingerprint, fault of a whole file: what ``importing.file_faults`` finds, another prompt's version, and a key that its own inputs don't give."""
    found = IM.file_faults(labelled, source, "fingerprint", IMMUTABLE)
    key = FP.picks_key(F.col("brand"), F.col("product_name"), _candidates("comments"), _candidates("body_candidates"), F.col("other_products"), F.col("prompt_version"))
    own = labelled.select("fingerprint", F.when(F.coalesce(F.col("prompt_version"), F.lit("")) != FP.VERSIONS["picks"], "version").when(_candidates("comments").isNull() | _candidates("body_candidates").isNull(), "candidates").when(~F.col("fingerprint").eqNullSafe(key), "key").alias("fault"))
    return found.unionByName(own.where("fault is not null")).distinct()


def _items(field: str, cell: str, others: Column) -> Column:
    """The rewrites of a field: place, rewrite, what it cites, its first fault, and whether its characters need a verdict."""

    def item(r, i):
        sources = F.col(f"_{cell}")
        index = F.array(r["source_index"])
        # A cited index always needs a text here, so the general rules hold with an index given.
        faults = IM.rewrite_faults(r["text"], sources, index, others)
        first = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in faults.items()])
        cited = F.coalesce(F.get(sources, r["source_index"]), F.lit(""))
        return F.struct(F.lit(field).alias("field"), i.alias("place"), r["text"].alias("rewrite"), cited.alias("source_text"), first.alias("fault"), (IM.overlap(r["text"], cited) < FLOOR).alias("low"))

    return F.transform(F.col(f"_{field}"), item)


def judged(labelled: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows with status, reason and ``waiting`` (the rewrites that need a verdict). Fingerprints must be distinct. verdicts: fingerprint, verdict."""
    rows = labelled.withColumns({f"_{f}": LB.parse_rewrites(F.col(f)) for f in FIELDS} | {f"_{c}": _candidates(c) for c in ("comments", "body_candidates")})
    others = TX.nfkc(F.coalesce("other_products", F.lit("")))
    empty = F.array().cast("array<struct<field:string,place:int,rewrite:string,source_text:string,fault:string,low:boolean>>")
    rows = rows.withColumn("_others", others)
    rows = rows.withColumn("_items", F.concat(*[F.coalesce(_items(f, cell, F.col("_others")), empty) for f, cell in FIELDS.items()]))
    # Few rewrites need a verdict: these alone are looked up, by their key.
    asked = rows.select("fingerprint", F.explode(F.filter("_items", lambda x: x["fault"].isNull() & x["low"])).alias("x"))
    asked = asked.withColumn("_g", FP.grounding_key(F.col("x.rewrite"), F.col("x.source_text")))
    known = verdicts.groupBy(F.col("fingerprint").alias("_v")).agg(F.last("verdict").alias("_verdict"))
    told = asked.join(known, F.col("_g") == F.col("_v"), "left").where(~F.col("_verdict").eqNullSafe("grounded"))
    waits = F.struct(F.col("x.field").alias("field"), F.col("x.place").alias("place"), F.col("x.rewrite").alias("rewrite"), F.col("x.source_text").alias("source_text"))
    told = told.groupBy(F.col("fingerprint").alias("_f")).agg(F.array_sort(F.collect_list(F.when(F.col("_verdict").isNull(), waits))).alias("_waits"), F.count_if(F.col("_verdict") == "ungrounded").alias("_bad"))
    rows = rows.join(told, F.col("fingerprint") == F.col("_f"), "left")
    index = lambda f: F.transform(F.col(f"_{f}"), lambda r: r["source_index"])
    both = lambda a, b: F.coalesce(F.arrays_overlap(index(a), index(b)), F.lit(False))
    first_fault = F.get(F.filter(F.transform("_items", lambda x: x["fault"]), lambda f: f.isNotNull()), F.lit(0))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    unfilled = reduce(lambda a, b: a & b, [blank(f) for f in FIELDS])
    reason = F.coalesce(
        *[F.when(F.col(f"_{f}").isNull(), F.lit(f"malformed {f}")) for f in FIELDS], first_fault, F.when(F.coalesce("_bad", F.lit(0)) > 0, "ungrounded"),
        F.when(both("positive_rewrites", "negative_rewrites"), "comment in both polarities"), F.when(both("positive_body_rewrites", "negative_body_rewrites"), "body in both polarities"), F.when(~unfilled & blank("model"), "no model"),
    )
    waiting = F.coalesce("_waits", F.array().cast("array<struct<field:string,place:int,rewrite:string,source_text:string>>"))
    rows = rows.withColumns({"reason": reason, "waiting": waiting})
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.size("waiting") > 0, "held").when(unfilled & blank("model"), "skipped").otherwise("accepted")
    return rows.select(*labelled.columns, status.alias("status"), "reason", F.when(status == "held", F.col("waiting")).otherwise(F.slice("waiting", 1, 0)).alias("waiting"))


def import_picks(labelled: DataFrame, source: DataFrame, verdicts: DataFrame, cache: Snapshots, rejects: Snapshots, queue: Snapshots, replace: bool = False, ceiling: float = C.REJECT_CEILING, model_tag: str = "") -> dict[str, int]:
    """added, replaced, known, skipped, rejected, held. New versions of the cache, of the rejects (rows as they came, with reason) and of the queue of rewrites without a verdict; nothing is written if the file is refused."""
    spark = labelled.sparkSession
    IM.refuse_if(pick_faults(labelled, source))
    seen, at = Observation(), shared_folder(spark, "picks")
    unfilled = reduce(lambda a, b: a & b, [F.trim(F.coalesce(F.col(f), F.lit(""))) == "" for f in FIELDS])
    rows = judged(labelled, verdicts)
    counted = rows.observe(seen, *[F.count_if(F.col("status") == k).alias(k) for k in KINDS], F.count_if((F.col("status") == "rejected") | ~unfilled).alias("considered"))
    counted.write.partitionBy("status").parquet(at)
    n = seen.get
    routed = lambda k: spark.read.schema(rows.schema).parquet(at).where(F.col("status") == k)
    if n["rejected"] > ceiling * n["considered"]:
        some = [(r["fingerprint"][:12], r["reason"]) for r in routed("rejected").orderBy("fingerprint").limit(5).collect()]
        raise ValueError(f"{n['rejected']} of {n['considered']} rows are rejected: the file is refused; {some}")
    model = F.lit(model_tag) if model_tag else F.coalesce(F.nullif(F.trim("model"), F.lit("")), F.lit("subscription-llm"))
    new = routed("accepted").select(*[(model if c == "model" else F.coalesce(F.col(c), F.lit(""))).alias(c) for c in CACHE])
    old = cache.read()
    old = spark.createDataFrame([], new.schema) if old is None else old.select(*CACHE)
    both = old.select("fingerprint", F.struct(*CACHE).alias("o")).join(new.select(F.col("fingerprint").alias("_k"), F.struct(*CACHE).alias("n")), F.col("fingerprint") == F.col("_k"), "full")
    kept = F.coalesce("n", "o") if replace else F.coalesce("o", "n")
    merging = Observation()
    fate = F.when(F.col("o").isNull(), "added").when(F.col("n").isNotNull(), "replaced" if replace else "known")
    merged = both.withColumns({"fate": fate, "r": kept}).observe(merging, *[F.count_if(F.col("fate") == k).alias(k) for k in ("added", "replaced", "known")]).select("r.*")
    cache.write(merged)
    rejects.write(routed("rejected").select(*labelled.columns, F.col("reason").alias("reject_reason")), "csv", header=True, escape='"')
    wait = routed("held").select("product_name", F.explode("waiting").alias("w")).select("product_name", "w.field", "w.rewrite", "w.source_text").dropDuplicates(["rewrite", "source_text"])
    queue.write(wait.select(FP.grounding_key(F.col("rewrite"), F.col("source_text")).alias("fingerprint"), "product_name", "field", "rewrite", "source_text", F.lit("").alias("verdict"), F.lit("").alias("model"), F.lit(FP.VERSIONS["grounding"]).alias("prompt_version")), "csv", header=True, escape='"')
    return {**merging.get, "skipped": n["skipped"], "rejected": n["rejected"], "held": n["held"]}
