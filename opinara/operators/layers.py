"""Sentiment of comments by layers of labels: rule < legacy text < fingerprint (the legacy key, then the current one) < correction.

All layers are one table of (kind, key), and a comment asks for its keys of every kind at once: one join of small rows, whatever the number of layers and however
many labels there are. Only comments that some layer knows come back. Labels are written once, deduplicated, so that the join can split a text that is said very
often. A label that judges a comment irrelevant makes its sentiment null, which isn't a missing label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as TX
from . import fingerprints as FP
from .store import pinned

#: The backends' names that say where a sentiment comes from, weakest first.
TEXT, FINGERPRINT, CORRECTION = "codex-legacy", "llm-backfill", "codex"
_UNIT = (-1.0, 1.0)


def _clamped(score: Column) -> Column:
    return F.when(score.isNotNull() & ~F.isnan(score), F.greatest(F.lit(_UNIT[0]), F.least(F.lit(_UNIT[1]), score)))


def text_labels(rows: DataFrame, text: str, score: str, line: str = "line") -> DataFrame:
    """key, score, relevant, line of a file of texts with scores; rows without a text or a number go."""
    number = F.col(score).try_cast("double")
    key = TX.override_text(TX.nfkc(F.coalesce(text, F.lit(""))))
    return rows.select(key.alias("key"), _clamped(number).alias("score"), F.lit(True).alias("relevant"), F.col(line).alias("line")).where((F.col("key") != "") & F.col("score").isNotNull())


def fingerprint_labels(rows: DataFrame, line: str = "line") -> DataFrame:
    """key, score, relevant, line of a fingerprint file: fingerprint, llm_score, is_relevant (blank: relevant); an irrelevant row needs no score."""
    key, said = F.lower(F.trim("fingerprint")), F.lower(F.trim(F.coalesce("is_relevant", F.lit(""))))
    relevant, score = (said == "") | said.isin("1", "true", "yes", "y"), F.col("llm_score").try_cast("double")
    out = rows.select(key.alias("key"), F.when(relevant, _clamped(score)).alias("score"), relevant.alias("relevant"), F.col(line).alias("line"))
    return out.where(F.col("key").rlike("^[0-9a-f]{64}$") & (~F.col("relevant") | F.col("score").isNotNull()))


def _table(layers: dict[str, DataFrame]) -> DataFrame | None:
    """kind, key and the last label of each."""
    out = None
    for kind, labels in layers.items():
        part = labels.select(F.lit(kind).alias("kind"), "key", "score", "relevant", "line")
        out = part if out is None else out.unionByName(part)
    return None if out is None else pinned(out.groupBy("kind", "key").agg(F.max_by(F.struct("score", "relevant"), "line").alias("label")))


def resolve(comments: DataFrame, ids: list[str], asked: Column, layers: dict[str, DataFrame]) -> DataFrame:
    """With ``label`` (score, relevant, backend), null where no layer knows the comment.

    ``asked``: an array of (kind, key, rank), the highest rank that is known counts; ``ids`` name a comment alone.
    """
    known = _table(layers)
    if known is None:
        return comments.withColumn("label", F.lit(None).cast("struct<score:double,relevant:boolean,backend:string>"))
    keys = comments.select(*ids, F.explode(asked).alias("_a")).select(*ids, "_a.*").where("key <> ''")
    met = keys.join(known, ["kind", "key"])
    best = met.groupBy(*ids).agg(F.max_by(F.struct("label.score", "label.relevant", F.col("kind").alias("backend")), "rank").alias("label"))
    return comments.join(best, ids, "left")


def comment_keys(source: Column, brand: Column, product: Column, title: Column, tag: Column, text: Column) -> Column:
    """What a comment asks the layers: the text's key of legacy labels and corrections, both fingerprints. Give it NFKC text; source: the post's URL, else its id."""
    plain = TX.override_text(F.coalesce(text, F.lit("")))
    ask = lambda kind, key, rank: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(rank).alias("rank"))
    return F.array(
        ask(TEXT, plain, 1), ask(FINGERPRINT, FP.sentiment_key(source, tag, text), 2), ask(FINGERPRINT, FP.sentiment_key_v2(source, tag, text, brand, product, title), 3), ask(CORRECTION, plain, 4),
    )


def canonical_overrides(rows: DataFrame, text: str, score: str, line: str = "line") -> DataFrame:
    """text, score, n_votes, conflict, line of a legacy file: one row per normal form of the text, in the file's order by ``line``.

    Variants of a text vote with their scores; of equal numbers the score that the normal form itself has, then the earliest.
    """
    from .labels import majority

    key = TX.override_text(TX.nfkc(F.coalesce(text, F.lit(""))))
    votes = rows.select(key.alias("text"), F.col(score).try_cast("double").alias("score"), F.col(line).alias("line"), F.col(text).alias("_own")).where((F.col("text") != "") & F.col("score").isNotNull())
    first = votes.groupBy("text").agg(F.min("line").alias("line"))
    return majority(votes, "text", "score", "line", F.col("_own") == F.col("text")).join(first, "text").select("text", "score", "n_votes", "conflict", "line")
