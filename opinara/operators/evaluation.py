"""Evaluation against human labels: macro metrics, comparing backends, samples to label, predictors by name."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import attribution as AT, labelling as LB, sentiment as SE, text as TX
from .labels import class_metrics, label_of

TARGET, SMALL = 0.8, 30

#: Scores of comments by backend: tag and text to -1..1. Others may be registered.
BACKENDS: dict[str, Callable[[Column, Column], Column]] = {"lexicon": SE.comment_score, "text": lambda tag, text: SE.text_score(text), "tag": lambda tag, text: SE.tag_prior(tag)}


def backend(name: str) -> Callable[[Column, Column], Column]:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name}: {sorted(BACKENDS)}")
    return BACKENDS[name]


def macro_metrics(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1 over the classes of either column, and the number of rows."""
    per_class = class_metrics(rows, gold, pred)
    macro = per_class.agg(*[F.round(F.avg(c), 4).alias(f"{c}_macro") for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    accuracy = rows.agg(F.round(F.avg(F.coalesce(F.col(gold) == F.col(pred), F.lit(False)).cast("int")), 4).alias("accuracy"))
    return accuracy.join(F.broadcast(macro))  # a row each


def compare_backends(gold: DataFrame, names: list[str]) -> DataFrame:
    """backend, n_rows, accuracy, meets_target, small_sample: polarity against labels. Gold: comment_tag, comment_text, sentiment (a label)."""
    want = LB.sentiment_label(F.col("sentiment"))
    tries = F.explode(F.array(*[F.struct(F.lit(n).alias("backend"), label_of(backend(n)(F.col("comment_tag"), F.col("comment_text"))).alias("pred")) for n in names]))
    rows = gold.select(want.alias("gold"), tries.alias("t")).select("gold", "t.*")
    n, hit = F.count("*"), F.avg((F.col("gold") == F.col("pred")).cast("int"))
    return rows.groupBy("backend").agg(n.alias("n_rows"), F.round(hit, 4).alias("accuracy"), (hit >= TARGET).alias("meets_target"), (n < SMALL).alias("small_sample"))


def sample(rows: DataFrame, key: Column, seed: str, n: int) -> DataFrame:
    """The same n rows for the same seed, in an order that has nothing to do with the key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), key).limit(n)


#: Words that alone signal a comparison in a comment that isn't attributed.
SIGNALS = ["比", "比較", "較", "輸", "贏", "勝過", "不如", "屌打", "還是", "沒有", "沒"]


def attribution_signals(own: Column, text: Column, sentiment: Column, backend_name: Column) -> Column:
    """is_comparative, target (own, other or none) and favoured (own, other or unknown) as the rules see a comment. Give it NFKC text."""
    said = AT.attribution(own, text, sentiment, backend_name)
    named, include, other = F.size(said["brands"]) > 0, said["include"], said["other_preferred"]
    comparative = named & (include | other | text.rlike("|".join(SIGNALS)))
    target = F.when(F.trim(text) == "", "none").when(named & ~include, "other").otherwise("own")
    favoured = F.when(~comparative, "unknown").when(other, "other").when(include, "own").otherwise("unknown")
    return F.struct(comparative.alias("is_comparative"), target.alias("target"), favoured.alias("favoured"))


#: The tasks of an evaluation: the gold column's label, as a normal form.
TASKS = {
    "sentiment": lambda: LB.sentiment_label(F.col("sentiment")), "target": lambda: LB.target_label(F.col("target_brand")), "favoured": lambda: LB.favoured_label(F.col("favored_brand")),
    "comparative": lambda: F.when(LB.boolean_label(F.col("is_comparative")), "true").otherwise("false"),
}


def predictions(gold: DataFrame, backends: list[str]) -> DataFrame:
    """A row per gold comment, backend and task: task, backend, gold, pred, with the comment's own columns.

    Gold: post_brand, comment_tag, comment_text and the labels' columns. A comment is judged by each backend; whom it speaks of, with that backend's score.
    """
    text = TX.nfkc(F.coalesce("comment_text", F.lit("")))
    rows = gold.withColumn("_text", text)
    tries = F.explode(F.array(*[F.struct(F.lit(n).alias("backend"), backend(n)(F.coalesce("comment_tag", F.lit("")), F.col("_text")).alias("score")) for n in backends]))
    rows = rows.select("*", tries.alias("_t")).withColumn("_said", attribution_signals(F.col("post_brand"), F.col("_text"), F.col("_t.score"), F.col("_t.backend")))
    pred = {"sentiment": label_of(F.col("_t.score")), "target": F.col("_said.target"), "favoured": F.col("_said.favoured"), "comparative": F.when(F.col("_said.is_comparative"), "true").otherwise("false")}
    tasks = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), TASKS[t]().alias("gold"), p.alias("pred")) for t, p in pred.items()]))
    return rows.select("*", tasks.alias("_p")).select(*gold.columns, F.col("_t.backend").alias("backend"), "_p.*")


def poisson(u: Column) -> Column:
    """How many times a row is drawn in a resample, from a number in [0, 1): Poisson of mean 1."""
    out, total, p = F.lit(7), 0.0, math.exp(-1)
    cuts = []
    for k in range(7):
        total += p
        cuts.append((k, total))
        p /= k + 1
    for k, c in reversed(cuts):
        out = F.when(u < c, k).otherwise(out)
    return out


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from a digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


def sliced_accuracy(rows: DataFrame, slices: list[list[str]], key: str, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """n_rows, accuracy and an interval for each value of each set of columns in ``slices`` (columns that a set lacks are null; ``slice`` names the set).

    The interval is that of a Poisson bootstrap: each row counts in each resample as often as its key's digest says, so a resample is a sum, all of
    them are summed in one pass and merge whatever the partitions, and a run again gives the same. Ends are the resamples' nearest ranks; a resample
    without rows doesn't count.
    """
    columns = list(dict.fromkeys(c for s in slices for c in s))
    hit = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).cast("long")
    # Resample 0 is the rows themselves.
    drawn = rows.select(*columns, hit.alias("hit"), F.col(key).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("b"))
    drawn = drawn.withColumn("w", F.when(F.col("b") == 0, 1).otherwise(poisson(unit(F.col("_key"), F.col("b"))))).where("w > 0")
    sets = F.explode(F.array(*[F.struct(F.lit("+".join(s) or "all").alias("slice"), *[(F.col(c) if c in s else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in columns]) for s in slices]))
    per = drawn.groupBy(*columns, "b").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("hit")).alias("k"))  # before the sets, so that these multiply sums only
    sums = per.select(sets.alias("s"), "b", "n", "k").groupBy("s", "b").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    shares = F.array_sort(F.collect_list(F.when((F.col("b") > 0) & (F.col("n") > 0), F.col("k") / F.col("n"))))
    found = sums.groupBy("s").agg(F.max(F.when(F.col("b") == 0, F.col("n"))).alias("n_rows"), F.max(F.when(F.col("b") == 0, F.col("k") / F.col("n"))).alias("accuracy"), shares.alias("_x"))
    at = lambda q: F.get("_x", F.greatest(F.lit(0), F.ceil(F.size("_x") * q).cast("int") - 1))
    return found.select("s.*", "n_rows", F.round("accuracy", 4).alias("accuracy"), F.round(at((1 - level) / 2), 4).alias("low"), F.round(at((1 + level) / 2), 4).alias("high"), (F.col("accuracy") >= TARGET).alias("meets_target"), (F.col("n_rows") < SMALL).alias("small_sample"))


def gold_rows(rows: DataFrame, required: list[str]) -> DataFrame:
    """Labelled rows: every required column must be there; rows without a label go."""
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"no {missing}")
    return rows.where(F.trim(F.coalesce("sentiment", F.lit(""))) != "")


def confusion_report(metrics: DataFrame) -> str:
    """Metrics of a few classes as text."""
    return "\n".join(f"{r['label']}: P {r['precision']:.4f} R {r['recall']:.4f} F1 {r['f1']:.4f} n {r['support']}" for r in metrics.orderBy("label").collect())
