"""SentencePiece encoding and decoding (operator 4): Unigram Viterbi over a double-array trie.

The vocabulary's pieces and log scores are read from the model file once; a double-array trie
over their UTF-8 bytes is built on the driver and broadcast (its size is that of the
vocabulary, checked against ``MAX_PIECES``). A text gets the space-marker prefix, spaces become
markers, and the segmentation of the highest total score wins; of equal ones, the one whose
last piece is the longest, at each place. A character that no single piece covers
costs ``UNKNOWN_PENALTY`` below the lowest score and is written as its byte pieces. Decoding joins
the pieces, turns byte pieces into bytes and markers into spaces, and drops the prefix.

No piece of a loaded vocabulary may have a marker after another character (checked), and no piece
holds a line feed (checked), so the best path of a text is that of its stretches between such
places. Each distinct stretch of a task is searched once and kept in a bounded cache; the
stretches of up to ``WIDE`` bytes that are not in it are searched together, column by column.

Defined results: null and empty texts have no tokens and decode to the empty text; a text that holds the marker
itself decodes with a space in its place, as the format has it; repeated rows each get a row; empty tables give empty
results. Very long texts are read whole; only an unbroken stretch stands in memory at once with its search, and the cache is
bounded in bytes. Other columns are carried only if named in ``keep``; those of the results replace none of the input's.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Scores at or below this mark pieces that a merge never makes; they stay usable but don't count as the lowest.
NEVER = -1e8
MAX_PIECES = 1_000_000
WIDE = 40
CACHE = 100_000_000
STRETCH = re.compile("▁+[^▁\n]*|[^▁\n]+|\n+")


class DoubleArray:
    """A trie over bytes in two arrays: the child of state s by byte b is base[s] + b if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for key, value in zip(keys, values, strict=True):
            at = 0
            for b in key:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][b]
            ends[at] = value
        size = len(children) + 512
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        check[0], place = 0, {0: 0}
        single, several = 1, 1  # where the search for a free place begins, for one child and for more
        for node, kids in enumerate(children):  # parents come before children
            at = place.pop(node)
            value[at] = ends[node]
            if not kids:
                continue
            codes = sorted(kids)
            free, tries = taken.find(0, single if len(codes) == 1 else several), 0
            while True:
                if free < 0 or free + 257 > len(taken):
                    more = len(taken)
                    taken.extend(bytes(more))
                    base, check, value = (np.concatenate([x, np.full(more, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                    free = more if free < 0 else free
                b = free - codes[0]
                if b > 0 and not any(taken[b + c] for c in codes):
                    break
                free, tries = taken.find(0, free + 1), tries + 1
            if len(codes) == 1:
                single = free if b > 0 and single > 256 else single
            elif tries > 20:
                several = free
            base[at] = b
            for c in codes:
                taken[b + c] = 1
                check[b + c] = at
                place[kids[c]] = b + c
            single = max(single, min(free, single + 1)) if single <= 256 else single
        n = len(taken) - bytes(taken)[::-1].index(1) + 257
        self.base, self.check, self.value = (np.resize(x, n) if len(x) >= n else np.concatenate([x, np.full(n - len(x), fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    trie: DoubleArray
    bytes_at: int  # the id of <0x00>
    unknown: float
    longest: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        if n > MAX_PIECES:
            raise ValueError(f"{n} pieces are more than {MAX_PIECES}")
        plain = [i for i in range(n) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]
        pieces = [p.id_to_piece(i) for i in range(n)]
        return cls.build(pieces, np.array([p.get_score(i) for i in range(n)], float), plain)

    @classmethod
    def build(cls, pieces: list[str], scores: np.ndarray, plain: list[int]) -> Vocabulary:
        """``plain``: ids of pieces that text can match; the 256 byte pieces stand in a row."""
        if bad := [pieces[i] for i in plain if re.search("[^▁]▁|\n", pieces[i])]:
            raise ValueError(f"pieces with a marker inside or a line feed: {bad[:3]}")
        keys = [pieces[i].encode() for i in plain]
        real = [scores[i] for i in plain if scores[i] > NEVER]
        return cls(pieces, scores, DoubleArray(keys, plain), pieces.index("<0x00>"), min(real, default=0.0) - UNKNOWN_PENALTY, max(map(len, keys), default=1))

    # Encoding

    def _best_one(self, data: bytes) -> list[int]:
        """Ids of one stretch, state by state."""
        if not hasattr(self, "_lists"):
            self._lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()
        base, check, value, scores = self._lists
        n = len(data)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if data[i] & 0xC0 == 0x80 or best[i] == -np.inf:
                continue
            here, first = best[i], i + _width(data[i])
            at, j, single = 0, i, False
            while j < n:
                to = base[at] + data[j]
                if check[to] != at or to == 0:
                    break
                at, j = to, j + 1
                if (v := value[at]) >= 0:
                    single |= j == first
                    if here + scores[v] > best[j]:
                        best[j], back[j], piece[j] = here + scores[v], i, v
            if not single and here + self.unknown > best[first]:
                best[first], back[first], piece[first] = here + self.unknown, i, -1
        return self._trace(data, back, piece)

    def _trace(self, data: bytes, back, piece) -> list[int]:
        out: list[int] = []
        j = len(data)
        while j > 0:
            i = back[j]
            if piece[j] < 0:
                out.extend(self.bytes_at + b for b in reversed(data[i:j]))
            else:
                out.append(int(piece[j]))
            j = i
        return out[::-1]

    def _best_many(self, items: list[bytes]) -> list[bytes]:
        """Packed ids of many short stretches at once: each step handles one byte of all of them."""
        n, wide = len(items), max(map(len, items))
        lens = np.array([len(x) for x in items])
        text = np.zeros((n, wide + 1), np.int32)
        flat = np.frombuffer(b"".join(items), np.uint8)
        text[:, :wide][np.arange(wide)[None, :] < lens[:, None]] = flat
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best = np.full((n, wide + 1), -np.inf)
        back, piece = np.zeros((n, wide + 1), np.int32), np.full((n, wide + 1), -1, np.int32)
        best[:, 0] = 0.0
        for i in range(wide):
            lead = text[:, i]
            rows = np.flatnonzero((i < lens) & (lead & 0xC0 != 0x80) & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            lead = lead[rows]
            first = i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            here, single = best[rows, i], np.zeros(len(rows), bool)
            live, at = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for j in range(i, min(wide, i + self.longest)):
                inside = j < lens[rows[live]]
                live, at = live[inside], at[inside]
                to = base[at] + text[rows[live], j]
                good = (check[to] == at) & (to != 0)
                live, at = live[good], to[good]
                if not len(live):
                    break
                v = value[at]
                ends = v >= 0
                k, v = live[ends], v[ends]
                single[k] |= j + 1 == first[k]
                score = here[k] + scores[v]
                better = score > best[rows[k], j + 1]
                k, v = k[better], v[better]
                best[rows[k], j + 1], back[rows[k], j + 1], piece[rows[k], j + 1] = score[better], i, v
            k = np.flatnonzero(~single)
            if len(k):
                score = here[k] + self.unknown
                to = first[k]
                better = score > best[rows[k], to]
                k, to = k[better], to[better]
                best[rows[k], to], back[rows[k], to], piece[rows[k], to] = score[better], i, -1
        return self._trace_many(items, lens, back, piece)

    def _trace_many(self, items: list[bytes], lens: np.ndarray, back: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """The best paths of all rows at once, from their ends: packed ids. Rows with an unknown character are traced one by one."""
        rows, at, steps, odd = np.arange(len(items)), lens.copy(), [], np.zeros(len(items), bool)
        while len(rows):
            p = piece[rows, at]
            odd[rows[p < 0]] = True
            got = np.full(len(items), -1, np.int32)
            got[rows] = p
            steps.append(got)
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        ids = np.stack(steps[::-1], axis=1)  # the first id of a row stands behind those of no use
        good = ids >= 0
        ends = 4 * np.cumsum(good.sum(axis=1))
        flat = ids[good].astype("<i4").tobytes()
        out, start = [], 0
        for end in ends.tolist():
            out.append(flat[start:end])
            start = end
        for r in np.flatnonzero(odd).tolist():
            out[r] = _packed(self._trace(items[r], back[r].tolist(), piece[r].tolist()))
        return out

    def search(self, stretches: set[str], cache: Stretches) -> None:
        """Put the ids of every stretch into the cache."""
        new = {s: s.encode("utf-8", "surrogatepass") for s in stretches - cache.keys()}
        short = sorted((s for s, d in new.items() if len(d) <= WIDE), key=lambda s: len(new[s]))
        for a in range(0, len(short), 20_000):
            part = short[a : a + 20_000]
            for s, ids in zip(part, self._best_many([new[s] for s in part]), strict=True):
                cache[s] = ids
            cache.size += sum(200 + 4 * len(s) + len(cache[s]) for s in part)
        for s, d in new.items():
            if len(d) > WIDE:
                cache[s] = _packed(self._best_one(d))
                cache.size += 200 + 4 * len(s) + len(cache[s])

    def encode(self, texts: list[str], cache: Stretches | None = None) -> list[bytes]:
        """The ids of each text, packed as little-endian 32-bit numbers."""
        cut = [STRETCH.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        cache = Stretches() if cache is None else cache
        cache.make_room()
        self.search(set().union(*cut), cache)
        return [b"".join(map(cache.__getitem__, c)) for c in cut]

    # Decoding

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "_bytes"):
            self._bytes = [p.encode() for p in self.pieces]
            for b in range(256):
                self._bytes[self.bytes_at + b] = bytes([b])
        text = b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class Stretches(dict):
    """The packed ids of each stretch, within ``CACHE`` bytes: more are held only while one batch needs them."""

    size = 0

    def make_room(self) -> None:
        if self.size > CACHE:
            self.clear()
            self.size = 0


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def _width(lead: int) -> int:
    return 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)


def _encode(shared, names: list[str]):
    def run(batches):
        vocabulary, cache = shared.value, Stretches()
        for batch in batches:
            texts = [t or "" for t in batch.column(names[-1]).to_pylist()]
            for a, b in slices([len(t) for t in texts], 1 << 20):
                part = batch.slice(a, b - a)
                ids = [np.frombuffer(x, "<i4") for x in vocabulary.encode(texts[a:b], cache)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in names[:-1]], pa.array(ids, pa.list_(pa.int32()))], [*names[:-1], "tokens"])

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns named in ``keep`` and tokens, the ids of each whole text."""
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["tokens array<int>"])
    return rows.mapInArrow(_encode(shared, rows.columns), out)


def _decode(shared, names: list[str]):
    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            texts = [None if t.as_py() is None else vocabulary.decode(t.as_py()) for t in batch.column(names[-1])]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names[:-1]], pa.array(texts, pa.string())], [*names[:-1], "text"])

    return run


def decode(rows: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",), tokens_col: str = "tokens") -> DataFrame:
    """The columns named in ``keep`` and text."""
    rows = rows.select(*keep, F.col(tokens_col).alias("_tokens"))
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["text string"])
    return rows.mapInArrow(_decode(shared, rows.columns), out)


def _round_trip(shared, names: list[str]):
    def run(batches):
        vocabulary, cache = shared.value, Stretches()
        low, high = vocabulary.bytes_at, vocabulary.bytes_at + 256
        for batch in batches:
            texts = [t or "" for t in batch.column(names[-1]).to_pylist()]
            for a, b in slices([len(t) for t in texts], 1 << 20):
                part = batch.slice(a, b - a)
                packed = vocabulary.encode(texts[a:b], cache)
                ids = [np.frombuffer(x, "<i4") for x in packed]
                backs = [vocabulary.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(k) for k in names[:-1]],
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([int(((x >= low) & (x < high)).sum()) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in backs], pa.string()),
                        pa.array([x == t for x, t in zip(backs, texts[a:b], strict=True)], pa.bool_()),
                    ],
                    [*names[:-1], "n_tokens", "n_byte_tokens", "tokens_sha256", "decoded_sha256", "round_trip"],
                )

    return run


def round_trips(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns named in ``keep``, and what each text's encoding and decoding give, as counts and digests (of the ids as little-endian 32-bit numbers)."""
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["n_tokens long, n_byte_tokens long, tokens_sha256 string, decoded_sha256 string, round_trip boolean"]
    return rows.mapInArrow(_round_trip(shared, rows.columns), ", ".join(out))
