"""Token counts (operator 6) with a digest cache.

Each text is keyed by the SHA-256 of its content and of the tokenizer's file. Texts whose
key is stored already take the stored count; of the others, each distinct one is encoded
once and appended to the cache. The content is normalised only in that null becomes the
empty text: this tokenizer keeps every byte, so no other change of the text keeps its count.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings inside a
text are ordinary text; repeated rows each get a row, whatever their ids; empty tables give empty results;
other columns are ignored. A cache holds whole rows only, as Spark commits files when they are complete: after a
broken append, what is missing is encoded again; a digest stored twice counts once, and
rows of another tokenizer are passed over. Very long texts are encoded in pieces
of about a megabyte, cut in front of a space that follows another character; no token of a
vocabulary checked by ``splits_at_spaces`` crosses such a place, so counts stay exact.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import checkpoint, slices

CHUNK = 1 << 20


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def splits_at_spaces(processor) -> bool:
    """True if no piece has the space marker after another character."""
    return not any(re.search("[^▁]▁", processor.id_to_piece(i)) for i in range(processor.get_piece_size()))


def parts(text: str, size: int) -> list[str]:
    """The text in pieces of about ``size`` characters, without the space each cut takes."""
    out, start = [], 0
    while len(text) - start > size:
        m = re.compile("(?<=[^ ▁]) (?=[^ ])").search(text, start + size)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.end()
    return [*out, text[start:]]


_LOADED: dict = {}


def _processor(path: str):
    if path not in _LOADED:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        _LOADED[path] = p, splits_at_spaces(p)
    return _LOADED[path]


def count_texts(texts: list[str], path: str) -> list[int]:
    processor, cut = _processor(path)
    counts = [0] * len(texts)
    for a, b in slices([len(t) for t in texts], CHUNK):
        pieces = [(i, p) for i in range(a, b) for p in (parts(texts[i], CHUNK) if cut else [texts[i]])]
        for (i, _), ids in zip(pieces, processor.encode([p for _, p in pieces], num_threads=1), strict=True):
            counts[i] += len(ids)
    return counts


def _encode(path: str):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(count_texts(batch.column("content").to_pylist(), path), pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(spark: SparkSession, docs: DataFrame, model: str, cache: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit. ``cache``: a folder of Parquet files, made where there is none; without one nothing is stored."""
    version = tokenizer_version(model)
    content = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))
    keyed = checkpoint(rows.select("id", "digest", F.octet_length("content").cast("long").alias("n_bytes")))
    stored = lambda: spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(cache).where(F.col("tokenizer") == version)
    # Digests first; then the text of one row for each that is missing. The id in the join's key parts the rows of a frequent text.
    missing = keyed.groupBy("digest").agg(F.min("id").alias("rep"))
    if cache and _exists(spark, cache):
        missing = missing.join(stored().select("digest"), "digest", "left_anti")
    missing = checkpoint(missing)
    full = bool(cache) and missing.isEmpty()  # then no text has to move
    m = missing.withColumnRenamed("digest", "_digest").hint("shuffle_hash")
    texts = rows.join(m, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("rep"))).select("digest", "content")
    encoded = texts.mapInArrow(_encode(model), "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    if cache:
        if not full or not _exists(spark, cache):
            encoded.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache)
        encoded = stored().join(keyed.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # Read back from storage, counts have no aggregate in front of the join, so that it can split the rows of a frequent text.
    return keyed.join(checkpoint(encoded), "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
