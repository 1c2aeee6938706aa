"""Importing label files: faults of a whole file, routing of its rows, merging into a cache.

A labelled file must hold the keys of the file that was sent out, with their fixed columns as they were; otherwise it is
refused. A single bad row is rejected and the rest imported, unless more than a ceiling of rows are bad; a row that needs a
verdict first is held; a row that nobody filled in is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import labelling as LB
from .labels import audit, gaps, reject_rate
from .store import upsert


def file_faults(labelled: DataFrame, source: DataFrame, key: str, fixed: list[str], index: str | None = None) -> DataFrame:
    """key, fault: unknown and dropped keys, changed fixed columns, repeated rows, and (with an index) gaps."""
    one = labelled.groupBy(key).agg(*[F.min(c).alias(c) for c in fixed], *[(F.min(c).eqNullSafe(F.max(c))).alias(f"_same_{c}") for c in fixed])
    same = F.forall(F.array(*[F.col(f"_same_{c}") for c in fixed]), lambda x: x) if fixed else F.lit(True)
    uneven = one.where(~same).select(key, F.lit("changed").alias("fault"))
    compared = audit(one.select(key, *fixed), source.select(key, *fixed), key, fixed).where("status <> 'ok'").select(key, F.col("status").alias("fault"))
    parts = [key] if index is None else [key, index]
    repeated = labelled.groupBy(*parts).count().where("count > 1").select(key, F.lit("repeated").alias("fault"))
    found = compared.unionByName(uneven).unionByName(repeated)
    if index is not None:
        found = found.unionByName(gaps(labelled.withColumn(index, F.col(index).cast("int")), key, index).select(key, F.lit("gap").alias("fault")))
    return found.distinct()


def refuse_if(faults: DataFrame) -> None:
    """A file with a fault is an error that tells how many of each there are."""
    if found := {r["fault"]: r["n"] for r in faults.groupBy("fault").agg(F.count("*").alias("n")).collect()}:
        raise ValueError(f"the file is refused: {found}")


def routed(rows: DataFrame, empty: Column, bad: dict[str, Column], held: Column | None = None) -> DataFrame:
    """With status (skipped, rejected, held or accepted) and the first reason that rejects."""
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in bad.items()], F.lit(None).cast("string")) if bad else F.lit(None).cast("string")
    out = rows.withColumns({"_empty": F.coalesce(empty, F.lit(False)), "_held": F.coalesce(held, F.lit(False)) if held is not None else F.lit(False), "reason": reason})
    status = F.when(F.col("_empty"), "skipped").when(F.col("reason").isNotNull(), "rejected").when(F.col("_held"), "held").otherwise("accepted")
    return out.withColumn("status", status).withColumn("reason", F.when(F.col("status") == "rejected", F.col("reason"))).drop("_empty", "_held")


@dataclass
class Imported:
    rows: DataFrame
    merged: DataFrame
    counts: DataFrame


def import_rows(rows: DataFrame, cache: DataFrame, keys: list[str], replace: bool = False, ceiling: float = C.REJECT_CEILING) -> Imported:
    """Merge the accepted rows of a routed file into a cache with the same columns; too many rejected ones are an error.

    Counts: added, replaced, skipped, rejected, held.
    """
    rate = reject_rate(rows.where("status <> 'skipped'"), ceiling).first()
    if not rate["accepted"]:
        raise ValueError(f"{rate['rejected']} of {rate['considered']} rows are rejected: the file is refused")
    taken = rows.where("status = 'accepted'").select(*cache.columns)
    known = cache.select(*keys).distinct()
    old, new = taken.join(known, keys, "left_semi"), taken.join(known, keys, "left_anti")
    kept = cache.join(taken.select(*keys), keys, "left_anti") if replace else cache
    merged = kept.unionByName(taken if replace else new)
    counts = (
        new.select(F.lit("added").alias("k")).unionByName(old.select(F.lit("replaced" if replace else "known").alias("k")))
        .unionByName(rows.where("status <> 'accepted'").select(F.col("status").alias("k")))
        .agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("added", "replaced", "skipped", "rejected", "held")])
    )
    return Imported(rows, merged, counts)


def sentiment_rows(rows: DataFrame) -> DataFrame:
    """The sentiment layer: a score from -1 to 1, a known label, relevant or not."""
    score, text = F.col("llm_score").try_cast("double"), F.trim(F.coalesce("llm_score", F.lit("")))
    return routed(rows, (text == "") & (F.trim(F.coalesce("llm_label", F.lit(""))) == ""), {
        "key": ~F.col("fingerprint").rlike("^[0-9a-f]{64}$"), "score": score.isNull() | (score < -1) | (score > 1),
        "label": LB.sentiment_label(F.col("llm_label"), strict=False).isNull(), "relevance": LB.boolean_label(F.col("is_relevant"), strict=False).isNull(),
    })


def product_rows(rows: DataFrame) -> DataFrame:
    """The product-name layer: a blank name is a verdict of its own, a row without name, price and model is not filled in."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    price = F.col("price").try_cast("int")
    return routed(rows, blank("product_name") & blank("price") & blank("model"), {"price": ~blank("price") & (price.isNull() | (price < 0)), "name": F.col("product_name").rlike(r"[\x00-\x1f\x{FFFD}]")})


def category_rows(rows: DataFrame, categories: list[str]) -> DataFrame:
    given = F.trim(F.coalesce("category", F.lit("")))
    return routed(rows, given == "", {"category": ~given.isin(categories)})


def verdict_rows(rows: DataFrame) -> DataFrame:
    given = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    return routed(rows, given == "", {"verdict": ~given.isin("grounded", "ungrounded")})


def rewrite_faults(rewrite: Column, sources: Column, indices: Column, others: Column, longest: int = 30) -> dict[str, Column]:
    """What makes a rewrite bad, by name. ``sources``: the candidates; ``indices``: those it cites (null: a malformed cell); ``others``: names of other products, set apart by |."""
    filled = F.coalesce(rewrite, F.lit("")) != ""
    cited = F.size(indices) > 0
    compact = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    names = F.filter(F.transform(F.split(F.coalesce(others, F.lit("")), r"\|"), compact), lambda n: n != "")
    return {
        "indices": indices.isNull() | sources.isNull(),
        "rewrite without source": filled & ~cited,
        "source without rewrite": cited & ~filled,
        "too long": F.length(rewrite) > longest,
        "no single line": (rewrite != F.trim(rewrite)) | rewrite.rlike("[\r\n\t]"),
        "control characters": rewrite.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{FFFD}]"),
        "width": LB.width_garbage(rewrite),
        "link": rewrite.rlike(r"(?i)(?:https?://|www\.)"),
        "other product": F.exists(names, lambda n: F.contains(compact(rewrite), n)),
        "index beyond the candidates": F.exists(indices, lambda i: i >= F.size(sources)),
        "no letters": filled & ~rewrite.rlike(r"[\x{3400}-\x{9fff}A-Za-z0-9]"),
    }


def cited_text(sources: Column, indices: Column) -> Column:
    """The cited candidates, in cited order, a line each."""
    return F.array_join(F.transform(indices, lambda i: F.get(sources, i)), "\n")


def overlap(rewrite: Column, source: Column) -> Column:
    """The share of a rewrite's distinct letters that its source has."""
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x.rlike(r"[\x{3400}-\x{9fff}A-Za-z0-9]")))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(letters(rewrite), letters(source))), F.size(letters(rewrite))), F.lit(0.0))


def excerpt_rows(rows: DataFrame, verdicts: DataFrame, floor: float = 0.25) -> DataFrame:
    """The excerpt layer: rewrites of cited candidates. Too little overlap waits for a verdict; an ungrounded one is rejected.

    Rows: candidate_sentences (numbered lines), source_indices, rewrite, other_products; verdicts: fingerprint (see grounding_key), verdict.
    """
    from .fingerprints import grounding_key

    rows = rows.withColumns({"_s": LB.parse_numbered(F.col("candidate_sentences")), "_i": LB.parse_indices(F.col("source_indices")), "_r": F.coalesce("rewrite", F.lit(""))})
    rows = rows.withColumn("source_text", cited_text(F.col("_s"), F.col("_i")))
    known = verdicts.select(F.col("fingerprint").alias("_v"), F.col("verdict").alias("_verdict"))
    rows = rows.withColumn("_g", grounding_key(F.col("_r"), F.col("source_text"))).join(known, F.col("_g") == F.col("_v"), "left")
    bad = {k: F.coalesce(c, F.lit(False)) for k, c in rewrite_faults(F.col("_r"), F.col("_s"), F.col("_i"), F.col("other_products")).items()}
    low = (F.col("_r") != "") & (overlap(F.col("_r"), F.col("source_text")) < floor)
    bad["ungrounded"] = F.coalesce(low & (F.col("_verdict") == "ungrounded"), F.lit(False))
    blank = (F.trim(F.coalesce("source_indices", F.lit(""))) == "") & (F.col("_r") == "") & (F.trim(F.coalesce("model", F.lit(""))) == "")
    return routed(rows, blank, bad, low & ~F.col("_verdict").eqNullSafe("grounded")).drop("_s", "_i", "_r", "_g", "_v", "_verdict")


def pick_rows(rows: DataFrame) -> DataFrame:
    """The shape of comment picks alone: two JSON lists of rewrites, with no source both positive and negative. ``picks.judged`` has all rules."""
    rows = rows.withColumns({"_p": LB.parse_rewrites(F.col("positive_rewrites")), "_n": LB.parse_rewrites(F.col("negative_rewrites"))})
    index = lambda c: F.transform(c, lambda r: r["source_index"])
    blank = (F.coalesce(F.size("_p"), F.lit(0)) == 0) & (F.coalesce(F.size("_n"), F.lit(0)) == 0) & F.col("_p").isNotNull() & F.col("_n").isNotNull() & (F.trim(F.coalesce("model", F.lit(""))) == "")
    bad = {"positive": F.col("_p").isNull(), "negative": F.col("_n").isNull(), "both polarities": F.arrays_overlap(index(F.col("_p")), index(F.col("_n")))}
    return routed(rows, blank, {k: F.coalesce(c, F.lit(False)) for k, c in bad.items()}).drop("_p", "_n")


def pending(rows: DataFrame, field: str) -> DataFrame:
    """The queue of held rewrites, each rewrite of a source once; rows: product_name, rewrite, source_text, status."""
    from .fingerprints import VERSIONS, grounding_key

    held = rows.where("status = 'held'").dropDuplicates(["rewrite", "source_text"])
    return held.select(grounding_key(F.col("rewrite"), F.col("source_text")).alias("fingerprint"), "product_name", F.lit(field).alias("field"), "rewrite", "source_text", F.lit("").alias("verdict"), F.lit("").alias("model"), F.lit(VERSIONS["grounding"]).alias("prompt_version"))


def merge_relabels(old: DataFrame, new: DataFrame, key: str, score: str) -> DataFrame:
    """Legacy scores with later ones in their place; two scores for one key in the new file are an error."""
    clash = new.groupBy(key).agg(F.countDistinct(score).alias("n")).where("n > 1")
    if found := clash.limit(5).collect():
        raise ValueError(f"conflicting scores: {[r[key] for r in found]}")
    return upsert(old, new.dropDuplicates([key]).select(*old.columns), key, replace=True)


def replace_excerpts(reports: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """Only excerpt and provisional flag anew; both frames must have the same keys."""
    odd = reports.select(key).exceptAll(rebuilt.select(key)).unionByName(rebuilt.select(key).exceptAll(reports.select(key)))
    if found := odd.limit(5).collect():
        raise ValueError(f"keys differ: {[r[key] for r in found]}")
    new = rebuilt.select(F.col(key).alias("_k"), F.col("review_excerpt").alias("_e"), F.col("review_provisional").alias("_p"))
    return reports.join(new, F.col(key) == F.col("_k")).withColumns({"review_excerpt": F.col("_e"), "review_provisional": F.col("_p")}).select(*reports.columns)


def prelabel(rows: DataFrame, score: Column) -> DataFrame:
    """Rows for human labels with the rules' guess filled in."""
    return rows.withColumn("sentiment", F.when(score > C.POSITIVE, "positive").when(score < C.NEGATIVE, "negative").otherwise("neutral"))
