"""Cross-tokenizer alignment (operator 13) by byte-owner arrays.

Two tokenizers' tokens cover the same bytes: space + text. Each byte has an owner of either; where
the pair of owners changes, a new overlap begins, and where both change at once is a cut. Cuts part the tokens
into groups, and all pairs of an A and a B token of one group are links. How good a pair of ids is, is learnt from
the corpus: its count is the number of documents that hold it linked.

Documents are encoded once, in shards of about a megabyte, which are aligned as one array. A shard is
written as a row per document (counts, digest) and, per bucket of A ids, one packed row with its documents' distinct id pairs.
Pairs are summed before they are shuffled; the counts of a bucket hold at most its A ids times B's ids and meet the shards' packed rows
of this bucket, which go there once, dealt over as many salts as wanted. A frequent pair weighs as little as another,
since every shard has one row per bucket. Only sums per document return.

A is encoded by the file's vocabulary through tiktoken where it is a byte-level BPE whose ids are its merges'
order, with the ordinary pattern; the ids are then those of ``tokenizers`` (a test compares them). Texts with a run of white space that
overflows its pattern's stack, and other vocabularies, go through ``tokenizers`` itself.

Defined results: null and empty texts, and those whose joined bytes differ from space + text on either side,
have no tokens: zeros, and an empty string for the digest. Special strings are ordinary text. Repeated rows, and rows with null or
repeated ids, are documents of their own and each count. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_path, slices

SHARD = 1 << 20
BUCKETS = 32
PAIRS = 1 << 21  # pairs expanded at a time
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_SPACE = re.compile(r"\s{5000}")


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level BPE of a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        byte = byte_of_character()
        vocab = {bytes(byte[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in [*vocab.items(), *((t.encode(), i) for t, i in special.items())]:
            self.bytes[i] = token
        self.fast = self._fast(data, vocab)

    @staticmethod
    def _fast(data: dict, vocab: dict[bytes, int]):
        """tiktoken's encoder, if it gives the same ids."""
        model, before = data["model"], data.get("pre_tokenizer") or {}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        ordered = model["type"] == "BPE" and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)) and len(vocab) == 256 + len(pairs)
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not data.get("normalizer")
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not (ordered and usual) or odd:
            return None
        import tiktoken

        return tiktoken.Encoding("side-a", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return [self.library.encode(t, add_special_tokens=False).ids if LONG_SPACE.search(t) else self.fast.encode_ordinary(t) for t in texts]


class Pieces:
    """Side B: a sentencepiece model, which puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if m := re.fullmatch("<0x([0-9A-F]{2})>", piece):
            return bytes([int(m[1], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_LOADED: dict = {}


def _side(kind, path: str):
    if (kind, path) not in _LOADED:
        side = kind(path)
        side.sizes = np.array([len(b) for b in side.bytes], np.int32)
        side.names = [np.array([f"{i}{end}" for i in range(len(side.bytes))], "S") for end in ((",", "|") if kind is ByteLevel else (",", ";"))]
        _LOADED[kind, path] = side
    return _LOADED[kind, path]


def groups_of(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each A token, of each B token, and of each overlap of two tokens' bytes. The sizes add up to the same."""
    a, b = np.repeat(np.arange(len(sizes_a)), sizes_a), np.repeat(np.arange(len(sizes_b)), sizes_b)
    new_a, new_b = np.diff(a, prepend=-1) != 0, np.diff(b, prepend=-1) != 0
    group = np.cumsum(new_a & new_b) - 1
    return group[new_a], group[new_b], group[new_a | new_b]


def id_pairs(doc: np.ndarray, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, A id, B id) as one sorted number each, and how many links each has. doc: of each A token."""
    n = int(max(ga[-1], gb[-1])) + 1 if len(ga) else 0
    n_b = np.bincount(gb, minlength=n)
    first_b = np.cumsum(n_b) - n_b
    left = doc.astype(np.int64) << 32 | a.astype(np.int64) << 16
    each = n_b[ga]
    keys, counts = [], []
    for lo, hi in slices(each.tolist(), PAIRS):
        for at in range(0, int(each[lo:hi].max()), PAIRS):  # one token with very many partners is cut too
            some = np.clip(each[lo:hi] - at, 0, PAIRS)
            which = np.repeat(np.arange(lo, hi), some)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some)
            k, c = np.unique(left[which] | b[first_b[ga[which]] + at + nth], return_counts=True)
            keys.append(k)
            counts.append(c)
            if sum(map(len, keys)) > 4 * PAIRS:
                keys, counts = map(lambda x: [x], _summed(keys, counts))
    return _summed(keys, counts)


def _summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(k), np.int64)
    np.add.at(out, at, np.concatenate(counts))
    return k, out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers in few bytes: those of one place in the numbers stand together."""
    head = np.array([len(x) for x in arrays], "<i8").tobytes()
    planes = b"".join(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=3).compress(bytes([len(arrays)]) + head + planes)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 1 + 8 * data[0], []
    for n in np.frombuffer(data, "<i8", data[0], 1).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).reshape(-1).view("<i8"))
        at += 8 * n
    return out


class Aligned:
    """The alignment of some texts as one array; ``good``: the texts that have tokens."""

    def __init__(self, texts: list[str | None], a: ByteLevel, b: Pieces):
        want = [" " + t if t else "" for t in texts]
        ids_a, ids_b = a.encode(want), b.encode([t or "" for t in texts])
        self.good = [bool(w) and b"".join(map(a.bytes.__getitem__, x)) == (raw := w.encode()) == b"".join(map(b.bytes.__getitem__, y)) for w, x, y in zip(want, ids_a, ids_b)]
        ids_a, ids_b = ([x if g else [] for x, g in zip(ids, self.good)] for ids in (ids_a, ids_b))
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((ids_a, self.n_a), (ids_b, self.n_b)))
        self.ga, self.gb, overlaps = groups_of(a.sizes[self.a], b.sizes[self.b])
        self.doc = np.repeat(np.arange(len(texts)), self.n_a)
        n = int(self.ga[-1]) + 1 if len(self.ga) else 0
        self.in_a, self.in_b = np.bincount(self.ga, minlength=n), np.bincount(self.gb, minlength=n)
        group_doc = np.zeros(n, np.int64)
        group_doc[self.ga] = self.doc
        per_doc = lambda x: np.bincount(group_doc, x, len(texts)).astype(np.int64)
        self.n_groups, self.n_links = per_doc(np.ones(n)), per_doc(self.in_a * self.in_b)
        self.n_overlaps = per_doc(np.bincount(overlaps, minlength=n))
        self.sides = a, b

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, written as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        if not len(self.a):
            return [""] * len(self.good)
        a, b = self.sides
        last_a, last_b = np.append(np.diff(self.ga) > 0, True), np.append(np.diff(self.gb) > 0, True)
        width = max(x.dtype.itemsize for x in [*a.names, *b.names])
        said = np.zeros(len(self.a) + len(self.b), f"S{width}")
        at_a = np.arange(len(self.a)) + (np.cumsum(self.in_b) - self.in_b)[self.ga]
        at_b = np.arange(len(self.b)) + np.cumsum(self.in_a)[self.gb]
        said[at_a] = np.where(last_a, a.names[1][self.a], a.names[0][self.a])
        said[at_b] = np.where(last_b, b.names[1][self.b], b.names[0][self.b])
        ends = np.cumsum(self.n_a + self.n_b)
        return [hashlib.sha256(said[e - n : e].tobytes().replace(b"\0", b"")[:-1]).hexdigest() if n else "" for e, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist())]


STORED = "shard long, bucket int, ordinal int, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, packed binary"
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def _shards(path_a: str, path_b: str):
    def run(batches):
        a, b = _side(ByteLevel, path_a), _side(Pieces, path_b)
        if max(len(a.bytes), len(b.bytes)) > 1 << 16:
            raise ValueError("a vocabulary has more than 65,536 entries")
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            for lo, hi in slices([len(t or "") + 64 for t in texts], SHARD):
                yield from _stored(shard, ids[lo:hi], Aligned(texts[lo:hi], a, b))
                shard += 1

    return run


def _stored(shard: int, ids: list, found: Aligned):
    n, none = len(ids), lambda k, t: pa.nulls(k, t)
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard] * n, pa.int64()), pa.array([-1] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(ids, pa.int64()), *[pa.array(getattr(found, c)) for c in COUNTS], pa.array(found.digests(), pa.string()), none(n, pa.binary())],
        [c.split()[0] for c in STORED.split(", ")],
    )
    keys, counts = id_pairs(found.doc, found.a, found.b, found.ga, found.gb)
    bucket = (keys >> 16 & 0xFFFF) % BUCKETS
    order = np.argsort(bucket, kind="stable")
    keys, counts, ends = keys[order], counts[order], np.cumsum(np.bincount(bucket, minlength=BUCKETS)).tolist()
    rows = []
    for k, (lo, hi) in enumerate(zip([0, *ends], ends)):
        if hi > lo:
            # Per document how many pairs it has here; then the pairs, as steps within a document.
            doc = keys[lo:hi] >> 32
            pair = keys[lo:hi] & 0xFFFFFFFF
            rows.append((k, pack(np.bincount(doc, minlength=n), np.diff(pair, prepend=0), counts[lo:hi])))
    m = len(rows)
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard] * m, pa.int64()), pa.array([k for k, _ in rows], pa.int32()), none(m, pa.int32()), none(m, pa.int64()), *[none(m, pa.int64())] * len(COUNTS), none(m, pa.string()), pa.array([p for _, p in rows], pa.binary())],
        [c.split()[0] for c in STORED.split(", ")],
    )


def _count(batches):
    """Of packed rows: each pair with the number of documents that hold it, summed up over the task as far as memory is to go."""
    keys, counts, held = [], [], 0

    def out():
        k, c = _summed(keys, counts)
        for at in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(k[at : at + (1 << 16)]), pa.array(c[at : at + (1 << 16)].astype(np.int64))], ["pair", "n"])

    for batch in batches:
        for blob in batch.column("packed"):
            k, c = np.unique(np.cumsum(unpack(blob.as_py())[1]), return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > 4 * PAIRS:
                keys, counts = map(lambda x: [x], _summed(keys, counts))
                held = len(keys[0])
                if held > 2 * PAIRS:
                    yield from out()
                    keys, counts, held = [], [], 0
    if keys:
        yield from out()


def _meet(batches):
    """Rows of a (bucket, salt): its pairs with their counts first, in order, then packed rows of shards. Per shard: sums over its documents."""
    at, pairs, n, best, parts = None, None, None, None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "salt", "shard", "packed")]
        done = []
        for bucket, salt, shard, blob in zip(*cols):
            if at != (bucket, salt):
                at, parts, pairs = (bucket, salt), [], None
            if shard is None:
                parts.append(unpack(blob))
                continue
            if pairs is None:
                pairs, n = (np.concatenate(x) for x in zip(*parts))
                a = pairs >> 16
                starts = np.flatnonzero(np.diff(a, prepend=-1))
                best = n == np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(a))))
            each, steps, links = unpack(blob)
            where = np.searchsorted(pairs, np.cumsum(steps))
            doc = np.repeat(np.arange(len(each)), each)
            total = lambda x, d=doc, k=len(each): _whole_sums(d, x, k)
            done.append((shard, pack(total(links * best[where]), total(links * n[where]))))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int64()), pa.array([p for _, p in done], pa.binary())], ["shard", "packed"])


def _whole_sums(doc: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, doc, x)
    return out


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, n_best long, count_sum long"


def _finish(batches):
    """A shard's sums of all buckets come first, then its documents, in order."""
    at, best, total = None, None, None
    for batch in batches:
        sums, docs = [], {"n_best": [], "count_sum": []}
        for shard, ordinal, blob in zip(*[batch.column(c).to_pylist() for c in ("shard", "ordinal", "packed")]):
            if at != shard:
                at, best, total = shard, None, None
            if ordinal is None:
                x, y = unpack(blob)
                best, total = (x, y) if best is None else (best + x, total + y)
            else:
                docs["n_best"].append(0 if best is None else int(best[ordinal]))
                docs["count_sum"].append(0 if total is None else int(total[ordinal]))
        rows = batch.filter(batch.column("ordinal").is_valid())
        names = [c.split()[0] for c in OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([rows.column(c) if c not in docs else pa.array(docs[c], pa.int64()) for c in names], names)


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_overlaps (overlapping token pairs), groups_sha256, n_best, count_sum. The counts cover all of ``docs``."""
    at = shared_path(spark, "aligned")
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_shards(path_a, path_b), STORED)
    found.withColumn("kind", F.when(F.col("bucket") < 0, "documents").otherwise("pairs")).write.partitionBy("kind").option("compression", "zstd").parquet(at)
    stored = spark.read.schema(STORED + ", kind string").parquet(at)
    packed = stored.where("kind = 'pairs'").select("shard", "bucket", "packed")
    counts = packed.select("packed").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    bucket = (F.shiftright("pair", 16) % BUCKETS).cast("int").alias("bucket")
    ways = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_bytes(spark, at) // (64 << 20)))
    salts = -(-ways // BUCKETS)
    # A bucket's counts: at most its A ids times B's ids, packed a slice at a time; a copy for each salt.
    slices_ = counts.select(bucket, "pair", "n").repartition(min(ways, BUCKETS), "bucket").sortWithinPartitions("bucket", "pair").mapInArrow(_packed_counts, "bucket int, ord long, packed binary")
    told = slices_.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("shard"), "ord", "packed")
    asked = packed.select("bucket", F.pmod(F.hash("shard"), F.lit(salts)).alias("salt"), "shard", F.lit(None).cast("long").alias("ord"), "packed")
    met = told.unionByName(asked).repartition(BUCKETS * salts, "bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("ord").asc_nulls_last()).mapInArrow(_meet, "shard long, packed binary")
    rows = stored.where("kind = 'documents'").drop("bucket", "packed", "kind")
    names = [c for c in rows.columns if c != "shard"]
    both = met.select("shard", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names], "packed").unionByName(rows.withColumn("packed", F.lit(None).cast("binary")))
    return both.repartition(ways, "shard").sortWithinPartitions("shard", F.col("ordinal").asc_nulls_first()).mapInArrow(_finish, OUT)


def _packed_counts(batches):
    """Sorted (bucket, pair, n) as packed rows of a bucket each, numbered in order."""
    ord_ = 0
    for batch in batches:
        bucket, pair, n = (batch.column(c).to_numpy() for c in ("bucket", "pair", "n"))
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        rows = [(int(bucket[lo]), ord_ + i, pack(pair[lo:hi], n[lo:hi])) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
        ord_ += len(cuts)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "ord", "packed"])


def _bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
