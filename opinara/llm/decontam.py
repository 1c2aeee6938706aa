"""Benchmark decontamination (operator 8): every training passage queries a BM25 index of test items.

Items are cut into segments of at most ``SEGMENT`` words, each an entry of an inverted index whose postings carry the
BM25 weight of a word in the segment as a share of the segment's score against itself. A document is read in passages
of ``2 * SEGMENT`` words, a new one every ``SEGMENT``, so that every stretch of a segment's length lies whole in one. A block-max WAND
search gives all segments at or above the threshold ``retrieve``. Each item met is then verified on the
passage and its surroundings: the share of the question's word ``SHINGLE``-grams there, and of the answer's.
The last sentence or line of an item with several counts as its answer, the rest as its question.

Exact pruning in front of the search: a segment's lightest words together make less than the share ``LIGHT`` of the threshold,
so only passages whose other words reach the rest for some segment are searched.

The index is broadcast in blocks of at most ``MAX_ITEMS`` items and ``MAX_CHARS`` characters, one at a time; more items mean more passes
over the documents. Weights come from the segments of all items, so that they do not depend on the blocks.

Defined results: null and empty texts have no passages and no leaks; items of null or empty text are never met; items with equal texts
are all reported, and an id with several texts if one of them is met. A null id is reported as null, first. Repeated rows each get a row; ids of documents may repeat or be null. Without items no document leaks.
Very long texts are read whole, passage by passage; other columns are carried only if named in ``keep``, and clash with none of the results.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint

SEGMENT = 64
SHINGLE = 5
MAX_ITEMS, MAX_CHARS = 20_000, 20_000_000
K1, B = 1.2, 0.75
POSTING_BLOCK = 32
LIGHT = 0.3
EDGE = re.compile(r"^\W+|\W+$")
ENDS = re.compile(r"(?<=[.!?])\s+|\n+")


def word_list(text: str | None) -> list[str]:
    """Lower-cased words without marks around them; words of marks only are left out."""
    return [w for w in (EDGE.sub("", x) for x in (text or "").lower().split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for w in (word_list(p) for p in ENDS.split(text)) if w]
    if len(parts) < 2:
        return word_list(text), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def grams(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Word n-grams."""
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def share(part: list[str], here: list[str]) -> float:
    """The share of a part's word SHINGLE-grams that are here; of shorter parts, whether they stand here whole."""
    own = grams(part, min(SHINGLE, len(part)))
    return len(own & grams(here, min(SHINGLE, len(part)))) / len(own)


def in_order(items) -> list[int | None]:
    """Distinct ids in order, null first."""
    return sorted(set(items), key=lambda i: (i is not None, i or 0))


class Terms(dict):
    """Numbers of words as they stand in texts: -1 for those of marks only, -2 outside the index."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers

    def __missing__(self, raw: str) -> int:
        if len(self) > 400_000:
            self.clear()
        w = raw if raw.isalnum() else EDGE.sub("", raw)
        n = self[raw] = self.numbers.get(w, -2) if w else -1
        return n


@dataclass
class Postings:
    """A word's segments in order, its weights there, and the heaviest of every block."""

    segments: list[int]
    weights: list[float]
    blocks: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.blocks = [max(self.weights[i : i + POSTING_BLOCK]) for i in range(0, len(self.weights), POSTING_BLOCK)]
        self.most = max(self.blocks)


def segments_of(text: str | None) -> list[dict[str, int]]:
    """The words of each segment of an item, counted."""
    w = word_list(text)
    out: list[dict[str, int]] = []
    if not w:
        return out
    size = math.ceil(len(w) / math.ceil(len(w) / SEGMENT))
    for a in range(0, len(w), size):
        counts: dict[str, int] = {}
        for x in w[a : a + size]:
            counts[x] = counts.get(x, 0) + 1
        out.append(counts)
    return out


@dataclass
class Statistics:
    """Of the segments of all items: their number, their mean length, and how many hold a word."""

    n: int
    mean: float
    held: dict[str, int]


class Index:
    """The inverted index of test items, with what is needed to verify a meeting. Without ``known`` the items are all there are."""

    def __init__(self, items: list[tuple[int | None, str]], retrieve: float = 0.5, known: Statistics | None = None):
        self.retrieve = retrieve
        self.items = []
        segments: list[dict[str, int]] = []
        self.item_of: list[int] = []
        for i, t in items:
            if not (cut := segments_of(t)):
                continue
            self.item_of += [len(self.items)] * len(cut)
            self.items.append((i, *question_and_answer(t), len(word_list(t))))
            segments += cut
        here: dict[str, int] = {}
        for s in segments:
            for w in s:
                here[w] = here.get(w, 0) + 1
        if known is None:
            known = Statistics(len(segments), sum(sum(s.values()) for s in segments) / max(1, len(segments)), here)
        held, mean = known.held, known.mean
        self.numbers = {w: k for k, w in enumerate(sorted(here))}
        lists: list[tuple[list[int], list[float]]] = [([], []) for _ in self.numbers]
        heavy: list[list[tuple[int, float]]] = [[] for _ in self.numbers]
        for k, s in enumerate(segments):
            size = sum(s.values())
            weight = {w: math.log(1 + (known.n - held[w] + 0.5) / (held[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for w, n in s.items()}
            total, light = sum(weight.values()), 0.0
            for w in sorted(weight, key=lambda w: (weight[w], w)):
                share = weight[w] / total
                lists[self.numbers[w]][0].append(k)
                lists[self.numbers[w]][1].append(share)
                light += share
                if light > LIGHT * retrieve - 1e-9:
                    heavy[self.numbers[w]].append((k, share))
        self.postings = [Postings(*x) for x in lists]
        # The heavy words' postings as flat arrays.
        self.starts = np.cumsum([0, *map(len, heavy)])
        self.heavy_segments = np.array([k for x in heavy for k, _ in x], np.int64)
        self.heavy_weights = np.array([v for x in heavy for _, v in x])
        self.heavy_most = np.array([max((v for _, v in x), default=0.0) for x in heavy])
        self.n_segments = len(segments)

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Passages, by number, in which some segment's heavy words reach what its light words leave."""
        place = np.flatnonzero(ids >= 0)
        if not len(place):
            return place
        n = self.starts[ids[place] + 1] - self.starts[ids[place]]
        place, n = place[n > 0], n[n > 0]
        if not len(place):
            return place
        last = max(0, -(-len(ids) // SEGMENT) - 2)  # the number of the last passage
        at = place // SEGMENT
        number = np.concatenate([np.minimum(at, last), np.minimum(np.maximum(at - 1, 0), last)])
        term = np.concatenate([ids[place], ids[place]])
        # What the heavy words of a passage could add up to at best, repeats and all: often too little.
        able = np.bincount(number, weights=self.heavy_most[term]) >= (1 - LIGHT) * self.retrieve - 1e-9
        number, term = number[able[number]], term[able[number]]
        if not len(number):
            return number
        both = np.sort(number * (len(self.postings) + 1) + term)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        number, term = both // (len(self.postings) + 1), both % (len(self.postings) + 1)
        n = self.starts[term + 1] - self.starts[term]
        row = np.repeat(self.starts[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key = np.repeat(number, n) * self.n_segments + self.heavy_segments[row]
        by = np.argsort(key)
        key, weight = key[by], self.heavy_weights[row[by]]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return np.unique(key[starts][np.add.reduceat(weight, starts) >= (1 - LIGHT) * self.retrieve - 1e-9] // self.n_segments)

    def search(self, terms) -> list[tuple[int, float]]:
        """Block-max WAND: all segments whose weights for these words add up to the threshold."""
        goal = self.retrieve - 1e-9
        cursors = [[p.segments[0], 0, p] for p in (self.postings[t] for t in sorted(set(terms)))]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[2].most
                if total >= goal:
                    pivot = k
                    break
            if pivot < 0:
                break
            segment = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == segment:
                pivot += 1
            bound, nearest = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else self.n_segments
            for c in cursors[: pivot + 1]:
                k = self._seek(c, segment) // POSTING_BLOCK
                if k < len(c[2].blocks):
                    bound += c[2].blocks[k]
                    end = min(len(c[2].segments), (k + 1) * POSTING_BLOCK) - 1
                    nearest = min(nearest, c[2].segments[end] + 1)
            if bound < goal:
                to = max(nearest, segment + 1)  # no segment before this one can reach the threshold
                for c in cursors[: pivot + 1]:
                    self._move(c, to)
            elif cursors[0][0] == segment:
                score = sum(c[2].weights[c[1]] for c in cursors[: pivot + 1])
                if score >= goal:
                    found.append((segment, score))
                for c in cursors[: pivot + 1]:
                    self._move(c, segment + 1)
            else:
                for c in cursors[:pivot]:
                    self._move(c, segment)
            cursors = [c for c in cursors if c[1] < len(c[2].segments)]
        return found

    @staticmethod
    def _seek(cursor, segment: int) -> int:
        """Where the segment stands, or would, in the cursor's postings."""
        import bisect

        return bisect.bisect_left(cursor[2].segments, segment, cursor[1])

    def _move(self, cursor, segment: int) -> None:
        if cursor[0] < segment:
            cursor[1] = self._seek(cursor, segment)
            cursor[0] = cursor[2].segments[cursor[1]] if cursor[1] < len(cursor[2].segments) else self.n_segments

    def leaks(self, text: str | None, terms: Terms, question: float = 0.6, answer: float = 0.6) -> tuple[int, list[int], float]:
        """(number of passages, items verified in the text, highest retrieval score)"""
        raw = (text or "").lower().split()
        ids = np.fromiter(map(terms.__getitem__, raw), np.int64, len(raw))
        if (ids == -1).any():
            good = ids != -1
            raw, ids = [w for w, g in zip(raw, good.tolist(), strict=True) if g], ids[good]
        if not len(ids):
            return 0, [], 0.0
        met: dict[int, tuple[int, int]] = {}
        best = 0.0
        for number in self.windows(ids).tolist():
            a, b = number * SEGMENT, (number + 2) * SEGMENT
            part = ids[a:b]
            for segment, score in self.search(part[part >= 0].tolist()):
                best = max(best, score)
                k = self.item_of[segment]
                low, high = met.get(k, (a, b))
                met[k] = min(low, a), max(high, b)
        found = set()
        for k, (a, b) in met.items():
            item, q, s, size = self.items[k]
            here = [EDGE.sub("", w) for w in raw[max(0, a - size) : b + size]]
            if share(q, here) >= question and (not s or share(s, here) >= answer):
                found.add(item)
        return max(1, -(-len(ids) // SEGMENT) - 1), in_order(found), best


def _find(shared, keep: list[str], question: float, answer: float, last: bool):
    """Over rows of ``keep``, _text and what earlier blocks found, if any: the same with this block's; without _text after the last."""
    names = [*keep, *([] if last else ["_text"])]

    def run(batches):
        index = None
        for batch in batches:
            if index is None:
                index = shared.value[0]
                terms = Terms(index.numbers)
            got = [index.leaks(t.as_py(), terms, question, answer) for t in batch.column("_text")]
            if "_items" in batch.schema.names:
                got = [(max(n, m), in_order([*i, *j]), max(b, c)) for (n, i, b), m, j, c in zip(got, *[batch.column(k).to_pylist() for k in ("_passages", "_items", "_best")], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in names], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([float(g[2]) for g in got], pa.float64())],
                [*names, "_passages", "_items", "_best"],
            )

    return run


def distinct_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item_id", "text"])


def item_blocks(items: DataFrame):
    """Test items in blocks small enough to broadcast, which the driver reads one after the other."""
    now, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if now and (len(now) >= MAX_ITEMS or size + len(r["text"]) > MAX_CHARS):
            yield now
            now, size = [], 0
        now.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield now


def _segments(batches):
    for batch in batches:
        cut = [s for t in batch.column("text") for s in segments_of(t.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([list(s) for s in cut], pa.list_(pa.string())), pa.array([sum(s.values()) for s in cut], pa.int64())], ["words", "size"])


def _statistics(items: DataFrame):
    """A function from a block of items to the statistics of all items' segments, of words only those in the block."""
    spark = items.sparkSession
    segments = items.select("text").mapInArrow(_segments, "words array<string>, size long")
    total = segments.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    held = checkpoint(segments.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("held")))

    def of(block) -> Statistics:
        words = sorted({w for _, t in block for w in word_list(t)})
        mine = spark.createDataFrame(pa.table({"word": pa.array(words, pa.string())}))
        return Statistics(total["n"], (total["size"] or 0) / max(1, total["n"]), {r["word"]: r["held"] for r in held.join(mine, "word").collect()})

    return of


def find_leaks(docs: DataFrame, items: DataFrame, retrieve: float = 0.5, question: float = 0.6, answer: float = 0.6, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns named in ``keep``, n_passages, items (ids verified), best_score, contaminated."""
    spark = docs.sparkSession
    items = distinct_items(items)
    blocks = item_blocks(items)
    block, after = next(blocks), next(blocks, None)
    known = None if after is None else _statistics(items)  # a single block has all segments itself
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    fields = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields}
    found = ["_passages long", "_items array<long>", "_best double"]
    while True:
        shared = spark.sparkContext.broadcast([Index(block, retrieve, known and known(block))])
        out = [fields[k] for k in keep] + [fields["_text"]] * (after is not None) + found
        rows = rows.mapInArrow(_find(shared, list(keep), question, answer, after is None), ", ".join(out))
        if after is None:
            break
        rows = checkpoint(rows)
        shared.destroy()
        block, after = after, next(blocks, None)
    return rows.select(*keep, F.col("_passages").alias("n_passages"), F.col("_items").alias("items"), F.col("_best").alias("best_score")).withColumn("contaminated", F.size("items") > 0)
