"""Label caches: fingerprints, precedence, audits, quarantine, merging, votes, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts with a unit separator between them; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def export_delta(candidates: DataFrame, caches: list[tuple[DataFrame, str]], key: str, order: str) -> DataFrame:
    """Candidates that no cache holds under its key (a cache is a frame with that column), the first row of each key."""
    for cached, column in caches:
        candidates = candidates.join(cached.select(column), column, "left_anti")
    return candidates.groupBy(key).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != key]), order).alias("r")).select(key, "r.*")


def last_per_key(labels: DataFrame, key: str, order: str) -> DataFrame:
    """Of repeated keys the last row counts."""
    return labels.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_k = 1").drop("_k")


def resolve(comments: DataFrame, layers: list[tuple[DataFrame, str]], rule: str = "rule_score") -> DataFrame:
    """The score of the last layer that knows the comment, else the rule's. A layer is (frame of key, score, relevant; the comments' key column).

    A label of something irrelevant makes the score null; it isn't a missing label.
    """
    value, backend = F.col(rule), F.lit("rule")
    for i, (labels, key) in enumerate(layers):
        found = labels.select(F.col("key").alias(f"_k{i}"), F.struct("score", "relevant").alias(f"_l{i}"))
        comments = comments.join(found, F.col(key) == F.col(f"_k{i}"), "left")
        known = F.col(f"_l{i}").isNotNull()
        value = F.when(known, F.when(F.col(f"_l{i}.relevant"), F.col(f"_l{i}.score"))).otherwise(value)
        backend = F.when(known, F.lit(f"layer{i}")).otherwise(backend)
    return comments.withColumns({"sentiment": value, "backend": backend}).drop(*[f"_{c}{i}" for c in "kl" for i in range(len(layers))])


def audit(labelled: DataFrame, source: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """Full outer comparison: unknown keys, dropped keys, and rows whose fixed columns were changed."""
    a = labelled.select(F.col(key).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in fixed])
    b = source.select(F.col(key).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in fixed])
    changed = F.lit(False)
    for c in fixed:
        changed = changed | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    status = F.when(F.col("_b").isNull(), "unknown").when(F.col("_a").isNull(), "dropped").when(changed, "changed").otherwise("ok")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def gaps(items: DataFrame, key: str, index: str) -> DataFrame:
    """Keys whose indices aren't 0 .. n-1, each once."""
    g = items.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("low"), F.max(index).alias("high"))
    return g.where((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("d") != F.col("n"))).select(key, "n")


def reject_rate(routed: DataFrame, ceiling: float = C.REJECT_CEILING) -> DataFrame:
    """One row: considered, rejected, their rate and whether it passes the ceiling. ``status``: accepted, rejected or held."""
    n, k = F.count("*"), F.count_if(F.col("status") == "rejected")
    return routed.agg(n.alias("considered"), k.alias("rejected"), F.round(F.coalesce(F.try_divide(k, n), F.lit(0.0)), 6).alias("rate"), (F.coalesce(F.try_divide(k, n), F.lit(0.0)) <= ceiling).alias("accepted"))


def route(rows: DataFrame, text: str, source: str, verdicts: DataFrame | None = None, floor: float = 0.25, longest: int = 30) -> DataFrame:
    """Rewrites to accepted, rejected (shape) or held (too little of the source's characters, and no verdict)."""
    chars = F.array_distinct(F.filter(F.split(F.col(text), ""), lambda c: c.rlike(r"[\p{L}\p{N}]")))
    own = F.array_distinct(F.split(F.col(source), ""))
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(chars, own)), F.size(chars)), F.lit(0.0))
    bad = F.col(text).isNull() | (F.trim(text) == "") | (F.length(text) > longest) | F.col(text).rlike(r"[\p{Cc}\n]|https?://")
    rows = rows.withColumn("overlap", F.round(overlap, 4))
    status = F.when(bad, "rejected").when(overlap >= floor, "accepted")
    if verdicts is not None:
        known = verdicts.select(F.col("key").alias("_v"), F.col("verdict").alias("_verdict"))
        rows = rows.withColumn("_key", fingerprint(F.col(text), F.col(source))).join(known, F.col("_key") == F.col("_v"), "left")
        status = status.when(F.col("_verdict") == "grounded", "accepted").when(F.col("_verdict").isNotNull(), "rejected")
    return rows.withColumn("status", status.otherwise("held")).drop("_v", "_verdict", "_key")


def majority(votes: DataFrame, key: str, value: str, order: str, prefer: Column) -> DataFrame:
    """The commonest value of each key; of equal ones that of a preferred row, then the earliest."""
    v = votes.groupBy(key, value).agg(F.count("*").alias("n"), F.max(prefer.cast("int")).alias("p"), F.min(order).alias("first"))
    best = F.struct(-F.col("n"), -F.col("p"), F.col("first"))
    return v.groupBy(key).agg(F.min_by(value, best).alias(value), F.sum("n").alias("n_votes"), (F.count("*") > 1).alias("conflict"))


def binary_metrics(rows: DataFrame, gold: Column, pred: Column) -> DataFrame:
    """Counts, accuracy, precision, recall and F1; 0 where nothing divides."""
    c = rows.agg(F.count_if(gold & pred).alias("tp"), F.count_if(~gold & ~pred).alias("tn"), F.count_if(~gold & pred).alias("fp"), F.count_if(gold & ~pred).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return c.select("tp", "tn", "fp", "fn", F.round(ratio(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"), F.round(ratio(tp, tp + fp), 4).alias("precision"), F.round(ratio(tp, tp + fn), 4).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"))


def class_metrics(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Per class of either column: support, precision, recall and F1."""
    hits = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"), (F.col(gold) == F.col(pred)).alias("hit"))
    c = hits.groupBy("x.label").agg(F.sum("x.g").alias("support"), F.sum("x.p").alias("predicted"), F.sum((F.col("hit") & (F.col("x.g") == 1)).cast("long")).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return c.select("label", "support", F.round(ratio(F.col("tp"), F.col("predicted")), 4).alias("precision"), F.round(ratio(F.col("tp"), F.col("support")), 4).alias("recall"), F.round(ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")), 4).alias("f1"))


def label_of(score: Column) -> Column:
    return F.when(score > C.POSITIVE, "positive").when(score < C.NEGATIVE, "negative").when(score.isNotNull(), "neutral")
