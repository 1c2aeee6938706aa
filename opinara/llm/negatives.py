"""Hard-negative mining (operator 12) by blocked matrix products.

Anchors, a stated query set, are broadcast in blocks of a bounded size and met by all rows, a block of rows at a time: the
block's scores are one matrix product in float64. Components are whole numbers, floor(256 * x), so sums stay exact below 2^53; rows that could pass
this are multiplied as Python's whole numbers instead. A first pass keeps per anchor the best positives (rows of its label), a second
the best negatives in each positive's window. What tasks keep is a few rows per anchor,
ordered by score, id and row, and merges into the same few whatever the order of blocks: a retried task changes nothing.
Each block of anchors is a round of its own, whose result is written before the next begins.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part. Vectors of
another length count as padded with zeros. A null id sorts last and is no anchor. Repeated ids are rows of their own: each such anchor is mined, and may
have its likes as positives. Equal scores go by id, then by the row's place. Anchors without positives, and positives without negatives in
their window, give no rows. Scores beyond 64 bits are held at its ends. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpoint, shared_path

#: Bytes of the anchors' matrix that is broadcast at a time; rows that meet it at a time; scores held at a time.
ANCHOR_BYTES = 8 << 20
ROWS = 4096
SCORES = 1 << 20
EXACT = float(1 << 53)
LIMIT = (1 << 63) - 1
LAST = np.int64(LIMIT)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): as doubles that are whole numbers; as Python's numbers where they may be too large."""
    y = np.floor(256 * np.where(np.abs(x) < 2.0**900, x, 0.0))
    if not len(x) or float(np.abs(x).max(initial=0)) < 2.0**40:
        return y
    out = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        out[at] = math.floor(256 * v) if abs(v) < 2.0**40 else int(v) * 256
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of all rows of a and b, exact."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if a.dtype != object and b.dtype != object and n * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < EXACT:
        return a @ b.T
    a, b = (np.array([[int(v) for v in r] for r in x], object).reshape(len(x), n) for x in (a, b))
    exact = a @ b.T if n else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def vectors(column) -> np.ndarray:
    """A list column without nulls as a matrix, short rows padded with zeros."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0))
    flat = flat[offsets[0] : offsets[-1]]
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Best:
    """The first k per key, by falling score, then id, then row; what is added merges."""

    def __init__(self, k: int, keys: int):
        self.k, self.least = k, np.full(keys, -np.inf)
        self.key, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, key, score, id_, row) -> None:
        self.key, self.score, self.id, self.row = (np.concatenate([x, y.astype(np.int64)]) for x, y in ((self.key, key), (self.score, score), (self.id, id_), (self.row, row)))
        order = np.lexsort((self.row, self.id, -self.score, self.key))
        key = self.key[order]
        first = np.searchsorted(key, key)
        nth = np.arange(len(key)) - first
        keep = order[nth < self.k]
        full = nth == self.k - 1
        self.least[key[full]] = self.score[order][full]
        self.key, self.score, self.id, self.row = (x[keep] for x in (self.key, self.score, self.id, self.row))


class Anchors:
    """A block of anchors, as it is broadcast."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        column = rows.column("vec")
        self.vec = whole(vectors(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column))
        self.row, self.id, self.label = (rows.column(c).to_numpy() for c in ("row", "id", "label"))


def _blocks(batches):
    """(row, id with nulls last, label, vectors), ROWS rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column("row").to_numpy(), part.column("id").fill_null(LIMIT).to_numpy(zero_copy_only=False), part.column("label").to_numpy(), whole(vectors(part.column("vec")))


def _positives(shared, k: int):
    def run(batches):
        anchors = shared.value
        best = Best(k, len(anchors.row))
        for row, id_, label, vec in _blocks(batches):
            for same in np.unique(label[np.isin(label, anchors.label)]):
                here, there = np.flatnonzero(label == same), np.flatnonzero(anchors.label == same)
                step = max(1, SCORES // len(here))
                for at in range(0, len(there), step):
                    own = there[at : at + step]
                    s = scores(anchors.vec[own], vec[here])
                    other = anchors.row[own][:, None] != row[here][None, :]
                    least = best.least[own]
                    if len(here) > k + 1:  # one of them may be the anchor itself
                        least = np.maximum(least, -np.partition(-s, k, axis=1)[:, k])
                    a, c = np.nonzero(other & (s >= least[:, None]))
                    best.add(own[a], s[a, c], id_[here[c]], row[here[c]])
        yield _rows(best)

    return run


def _rows(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(best.key), pa.array(best.score), pa.array(best.id), pa.array(best.row)], ["key", "score", "id", "row"])


def _negatives(shared, k: int, windows, n_positives: int):
    """windows: per anchor and place of a positive the least and the largest score that is wanted; key: anchor * n_positives + place."""

    def run(batches):
        anchors, (low, high) = shared.value, windows.value
        best = Best(k, low.size)
        floor, ceiling = low.min(axis=1), high.max(axis=1)
        for row, id_, label, vec in _blocks(batches):
            step = max(1, SCORES // len(row))
            for at in range(0, len(anchors.row), step):
                own = np.arange(at, min(at + step, len(anchors.row)))
                s = scores(anchors.vec[own], vec)
                a, c = np.nonzero((s >= floor[own][:, None]) & (s <= ceiling[own][:, None]) & (anchors.label[own][:, None] != label[None, :]))
                s, a = s[a, c].astype(np.int64), own[a]
                for j in range(n_positives):
                    ok = np.flatnonzero((s >= low[a, j]) & (s <= high[a, j]) & (s >= best.least[a * n_positives + j]))
                    if len(ok):
                        best.add(a[ok] * n_positives + j, s[ok], id_[c[ok]], row[c[ok]])
        yield _rows(best)

    return run


KEPT = "key long, score long, id long, row long"


def _merged(df: DataFrame, k: int) -> DataFrame:
    """The tasks' rows, at most k of a key each, to the first k of a key."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id", "row")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _rounds(anchors: DataFrame, size: int) -> list[tuple[int, int]]:
    """Ranges of the anchors' numbers that hold at most ``size`` each; numbers are a partition's, counted up within it."""
    counts = sorted((r["p"], r["n"]) for r in anchors.groupBy(F.shiftright("number", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    out, start, held = [], None, 0
    for p, n in counts:
        at = 0
        while at < n:
            take = min(n - at, size - held)
            start = (p << 33) + at if start is None else start
            at, held = at + take, held + take
            if held == size:
                out.append((start, (p << 33) + at))
                start, held = None, 0
    return [*out, (start, (counts[-1][0] + 1) << 33)] if start is not None else out


def mine(vecs: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: which rows are anchors; label: a whole number, the column of that name if not given."""
    spark = vecs.sparkSession
    label = F.col("label") if label is None else label
    rows = vecs.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("vec"), (anchor & F.col(id_col).isNotNull()).alias("anchor"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = checkpoint(rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("row", F.monotonically_increasing_id()))
    asked = checkpoint(rows.where("anchor").drop("anchor").withColumn("number", F.monotonically_increasing_id()))
    width = asked.agg(F.max(F.size("vec"))).first()[0] or 1
    rows, at = rows.select("row", "id", "label", "vec"), shared_path(spark, "negatives")
    for lo, hi in _rounds(asked, max(1, ANCHOR_BYTES // (8 * width))):
        _round(rows, Anchors(asked.where((F.col("number") >= lo) & (F.col("number") < hi)).orderBy("number").toArrow()), positives, negatives).write.mode("append").parquet(at)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(at) if _exists(spark, at) else spark.createDataFrame([], schema)


def _round(rows: DataFrame, anchors: Anchors, positives: int, negatives: int) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(anchors)
    found = _merged(rows.mapInArrow(_positives(shared, positives), KEPT), positives).collect()  # a few rows per anchor of the block
    n = len(anchors.row)
    low, high = np.full((n, positives), LAST), np.full((n, positives), -LAST)
    told = []
    for r in found:
        a, j, p = r["key"], r["place"] - 1, r["score"]
        low[a, j], high[a, j] = -(-4 * p // 5), p  # 80 p <= 100 s <= 100 p
        told.append((a * positives + j, int(anchors.id[a]), None if r["id"] == LIMIT else r["id"], p))
    windows = spark.sparkContext.broadcast((low, high))
    best = _merged(rows.mapInArrow(_negatives(shared, negatives, windows, positives), KEPT), negatives)
    names = spark.createDataFrame(told, "key long, anchor_id long, positive_id long, positive_score long")
    return best.join(F.broadcast(names), "key").select("anchor_id", "positive_id", F.col("place").alias("rank"), F.when(F.col("id") != LIMIT, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
