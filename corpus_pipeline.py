"""The corpus pipeline: quality, near-duplicates, repeated passages, test items, tokens.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of ``documents``. Each stage works on all rows that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.llm import decontam, lsh_forest, pieces, quality, suffix_dedup
from opinara.llm.common import checkpoint, table
from opinara.llm.queries import piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go. Training takes the labelled ones among ``docs``."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.grade(docs.withColumn("_read", F.col("text")), model, keep=COLUMNS, text_col="_read").where("kept").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id, null ids last. Rows of one id are documents of their own."""
    docs = _keyed(docs.select(*COLUMNS))
    links = lsh_forest.link_documents(docs, id_col="_row")
    dropped = links.where(~F.col("kept")).select(F.col("_row").alias("_gone"))
    return docs.join(dropped, F.col("_row") == F.col("_gone"), "left_anti").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key per row, _row, in the order of ids: the id itself, unless ids repeat or are null."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1):
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), *[c for c in COLUMNS if c != "doc_id"])
    return checkpoint(ordered.withColumn("_row", F.monotonically_increasing_id()))


def repeated_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occur earlier go; a character cut in two goes whole. Null texts stay null. Every row stays, whatever its id."""
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), keep=("lang", "source", "n_chars"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a test item is verified go."""
    docs = docs.select(*COLUMNS)
    found = decontam.find_leaks(docs.withColumn("_read", F.col("text")), table(spark, sf_dir, "benchmark"), keep=COLUMNS, text_col="_read")
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text's pieces and their number."""
    encoded = pieces.encode(docs, pieces.Vocabulary.load(piece_model()), keep=("doc_id", "lang", "source"))
    return encoded.withColumn("n_tokens", F.size("tokens").cast("long"))


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_duplicates_stage),
    ("suffix-array dedup", repeated_passages_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece", tokens_stage),
]
#: SQL can't express the trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
