"""Language ID (operator 9) by compression.

A language's model is a raw-content zstandard dictionary: blocks drawn from the whole texts of a
bounded sample of its labelled documents. A text is cut into blocks, each block is compressed with every dictionary,
and the language whose sizes add up to the least wins. The score is the winner's margin over
the runner-up, relative to the runner-up; a margin below ``narrow`` sets ``rejected``.

Training reads only text and non-null ``lang`` of documents outside the held-out fold. At most
``docs_per_lang`` documents of a language are taken, those with the smallest hashed ids, and of all blocks of
``BLOCK`` characters of their whole texts those with the smallest hashes, up to ``dict_bytes`` in all, so that
what is collected and broadcast is bounded by the number of languages.

Defined results: null texts and texts without a letter get ``und`` with score 0; if no language
can be learned, so does every text. Equal sizes go to the first language by name. Repeated rows each get a row; empty tables give
empty results; very long texts are compressed whole, block by block; other columns are carried only if named in ``keep``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

BLOCK = 2000
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased words with one space between them; digits, marks and signs are left out, as are numeric signs, which patterns take for letters."""
    words = NOT_LETTERS.sub(" ", text).strip()
    if not words.replace(" ", "").isalpha():
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return words.lower()


def learn(docs: DataFrame, docs_per_lang: int = 200, dict_bytes: int = 98_304) -> dict[str, bytes]:
    """The dictionaries by language, from labelled rows (doc_id, text, lang)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4 * docs_per_lang / n)))])
    rank = F.xxhash64(F.col("doc_id").cast("string"), F.lit(9))
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / BLOCK).cast("int"))
    sample = (
        rows.withColumn("rank", rank)
        .where((F.col("text") != "") & (F.pmod("rank", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)))
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text")))
        .where(F.col("n") <= docs_per_lang)
        .select("lang", "rank", "text", F.explode(starts).alias("k"))
        .select("lang", "k", F.xxhash64("rank", "k").alias("rank"), F.expr(f"substring(text, k * {BLOCK} + 1, {BLOCK})").alias("text"))
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text")))
        .where(F.col("n") <= 2 * dict_bytes // BLOCK)
        .select("lang", "n", "text")
    )
    got: dict[str, list] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["n"])):
        got.setdefault(r["lang"], []).append(letters(r["text"]))
    return {k: " ".join(v).encode("utf-8", "replace")[:dict_bytes] for k, v in sorted(got.items()) if any(v)}


def sizes(text: str, compressors) -> list[int]:
    """Compressed bytes of the whole text, block by block, for each compressor."""
    data = text.encode("utf-8", "replace")
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return [sum(len(c(b)) for b in blocks) for c in compressors]


def _predict(model, narrow: float, names: list[str]):
    def run(batches):
        import zstandard

        compressors = []
        for raw in model.value.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=3)
            compressors.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        langs = list(model.value)
        for batch in batches:
            pred, score, rejected = [], [], []
            for value in batch.column(names[-1]):
                text = letters(value.as_py() or "")
                if not text or not langs:
                    got = "und", 0.0
                else:
                    n = sizes(text, compressors)
                    order = sorted(range(len(n)), key=n.__getitem__)
                    best, second = n[order[0]], n[order[1]] if len(n) > 1 else 2 * n[order[0]]
                    got = langs[order[0]], (second - best) / second
                pred.append(got[0])
                score.append(got[1])
                rejected.append(got[1] < narrow)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names[:-1]], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names[:-1], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", narrow: float = 0.02, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns named in ``keep``, lang_pred, score, rejected; languages stand in the model's order."""
    rows = docs.select(id_col, *keep, F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["lang_pred string", "score double", "rejected boolean"])
    return rows.mapInArrow(_predict(shared, narrow, rows.columns), out)
