"""Quality classifier (operator 2): ordinal cumulative-link regression on hashed text.

Grades are ordered 0 .. K-1. A document's features are its distinct hashed words, word
stems (first four letters), word shapes and its share of words said twice running; weights are shared by all grades and only the thresholds differ:
P(grade <= k) = sigmoid(theta_k - w.x). The expected grade is the sum of the tail
probabilities P(grade > k), and the tail probability of the top grade serves for selection.

Training takes at most ``max_rows`` labelled documents, those with the smallest hashed ids,
and reads their whole texts; only their hashed features reach the driver. Scoring
reads every whole text.

Defined results: null and empty texts have no features, get the thresholds' own
probabilities and are held to ``keep_at`` like others. With no labelled rows or only
one grade nothing is learned: every document gets the same probabilities and is kept. Repeated rows each
get a row; equal texts get equal results; labels that are null are left out, and of repeated labels the lowest
grade counts; empty tables give empty results; other columns are carried only if named in ``keep``. Long words are read whole but not kept in the word cache.
"""

from __future__ import annotations

import operator
import re
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BITS = 20
BUCKETS = 1 << BITS
CACHE, LONGEST = 300_000, 64
_STRIP = re.compile(r"[\W_]+")
_SHAPES = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^Aa0])\1+"), r"\1\1")]


def shape(word: str) -> str:
    for pattern, put in _SHAPES:
        word = pattern.sub(put, word)
    return word[:8]


def word_features(word: str) -> tuple[int, ...]:
    """Hash buckets of a word without its marks, of its first four letters, and of its shape."""
    plain = _STRIP.sub("", word).lower()
    found = [zlib.crc32(b"s" + shape(word).encode("utf-8", "replace")) % BUCKETS]
    if plain:
        found.append(zlib.crc32(b"w" + plain.encode("utf-8", "replace")) % BUCKETS)
    if len(plain) >= 4:
        found.append(zlib.crc32(b"p" + plain[:4].encode("utf-8", "replace")) % BUCKETS)
    return tuple(found)


def features(text: str | None, known: dict) -> np.ndarray:
    """Distinct buckets of a text. ``known``: the caller's word cache."""
    words = (text or "").split()
    twice = sum(map(operator.eq, words, islice(words, 1, None)))
    out = {zlib.crc32(b"r%d" % (10 * twice // len(words))) % BUCKETS} if 20 * twice >= len(words) > 0 else set()
    for w in set(words):
        got = known.get(w)
        if got is None:
            got = word_features(w)
            if len(w) <= LONGEST:
                if len(known) >= CACHE:
                    known.clear()
                known[w] = got
        out.update(got)
    return np.fromiter(out, np.int64, len(out))


@dataclass
class OrdinalModel:
    """weights by bucket, and the ordered thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    trained: bool = True

    def tails(self, buckets: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        z = float(self.weights[buckets].sum()) if len(buckets) else 0.0
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds, -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, min_docs: int = 8, telling: float = 4.0, least_shift: float = 0.5, steps: int = 200, rate: float = 0.2, l2: float = 1e-4) -> OrdinalModel:
    """Buckets of at least ``min_docs`` training documents whose
    share above some threshold is ``telling`` standard errors and ``least_shift`` standard deviations from the overall share get
    a weight, so that neither chance nor a text's length decides. Full-batch Adam on the mean log-loss; thresholds stay ordered as a first value plus positive steps."""
    prior = np.array([((grades > k).sum() + 0.5) / (len(grades) + 1) for k in range(n_grades - 1)])
    theta = -np.log(prior / (1 - prior))
    if len(grades) == 0 or len(set(grades.tolist())) < 2:
        return OrdinalModel(np.zeros(BUCKETS, np.float32), theta, trained=False)
    flat = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = np.bincount(flat, minlength=BUCKETS)
    common = n >= min(min_docs, max(1, len(rows) // 20))
    apart = np.zeros(BUCKETS, bool)
    for k in range(n_grades - 1):
        over = (grades > k).astype(float)
        shift = np.abs(np.bincount(flat, weights=over[doc], minlength=BUCKETS) - n * over.mean()) / max(over.std(), 1e-9)  # in standard deviations, times n
        apart |= (shift >= telling * np.sqrt(n)) & (shift >= least_shift * n)
    common &= apart
    doc, flat = doc[common[flat]], flat[common[flat]]
    used, at = np.unique(flat, return_inverse=True)
    w = np.zeros(len(used))
    params = np.concatenate([[theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v, mp, vp = np.zeros_like(w), np.zeros_like(w), np.zeros_like(params), np.zeros_like(params)
    own = np.eye(n_grades, dtype=bool)[grades]
    for step in range(1, steps + 1):
        theta = np.concatenate([[params[0]], params[0] + np.cumsum(np.exp(params[1:]))])
        z = np.bincount(doc, weights=w[at], minlength=len(rows))
        below = 1 / (1 + np.exp(-np.clip(theta[None, :] - z[:, None], -40, 40)))  # P(grade <= k)
        edges = np.concatenate([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))], axis=1)
        p = np.maximum((edges[:, 1:] - edges[:, :-1])[own], 1e-12)
        slope = np.concatenate([np.zeros((len(rows), 1)), below * (1 - below), np.zeros((len(rows), 1))], axis=1)
        up, low = slope[:, 1:][own] / p, slope[:, :-1][own] / p
        dz = (up - low) / len(rows)  # of the loss: -log p falls as theta - z falls
        gw = np.bincount(at, weights=dz[doc], minlength=len(used)) + l2 * w
        dtheta = np.array([-(up[grades == k].sum() - low[grades == k + 1].sum()) / len(rows) for k in range(n_grades - 1)])
        gp = np.concatenate([[dtheta.sum()], [dtheta[k:].sum() * np.exp(params[k]) for k in range(1, n_grades - 1)]])
        for x, g, a, b in ((w, gw, m, v), (params, gp, mp, vp)):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= rate * (1 - step / (steps + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    theta = np.concatenate([[params[0]], params[0] + np.cumsum(np.exp(params[1:]))])
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return OrdinalModel(weights, theta)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 poor, 1 well written but toxic, 2 well written and not toxic."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min(grade).alias("grade"))


def _buckets(batches):
    known: dict = {}
    for batch in batches:
        rows = [np.sort(features(t.as_py(), known)).astype("<i4").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("grade"), pa.array(rows, pa.binary())], ["rank", "grade", "buckets"])


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, max_rows: int = 8000) -> OrdinalModel:
    """``ratings``: doc_id, grade (int). At most ``max_rows`` ids are drawn and, of their documents, as many rows, those of the smallest hashes, however often an id is repeated."""
    chosen = ratings.select("doc_id", "grade", F.xxhash64(F.col("doc_id").cast("string"), F.lit(2)).alias("rank")).orderBy("rank", "doc_id").limit(max_rows)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("rank", F.col("grade").cast("int").alias("grade"), "text").mapInArrow(_buckets, "rank long, grade int, buckets binary").orderBy("rank", "grade", "buckets").limit(max_rows).collect()
    rows.sort(key=lambda r: (r["grade"], bytes(r["buckets"])))
    return fit([np.frombuffer(r["buckets"], "<i4") for r in rows], np.array([r["grade"] for r in rows], np.int64), n_grades)


def _score(shared, names: list[str]):
    def run(batches):
        model, known = shared.value, {}
        for batch in batches:
            tails = [model.tails(features(t.as_py(), known)) for t in batch.column(names[-1])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in names[:-1]], pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([float(t[-1]) for t in tails], pa.float64())],
                [*names[:-1], "expected_grade", "tail_probability"],
            )

    return run


def grade(docs: DataFrame, model: OrdinalModel, keep_at: float = 0.85, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns named in ``keep``, expected_grade, tail_probability (of the top grade), kept."""
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["expected_grade double", "tail_probability double"])
    return rows.mapInArrow(_score(shared, rows.columns), out).withColumn("kept", F.col("tail_probability") >= keep_at if model.trained else F.lit(True))
