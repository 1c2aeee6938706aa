"""Embedding near-dedup (operator 3): random-hyperplane signs in several tables, exact cosine, components.

Equal vectors of a label are first folded into one, with the number of its copies. Each
distinct vector gets a bucket per table: the signs of its products with the table's random planes. The
number of planes follows the number of vectors, and that of tables follows from it so that a pair at
the threshold shares a bucket of some table but for the probability ``miss``. Only ids and signs travel: buckets of one
vector are dropped, larger ones are dealt in blocks of about ``BLOCK`` vectors, and in each pair of blocks a vector
is marked if some other there agrees with it in so many signs of all tables that they may be a pair (at the
threshold, ``SIGMAS`` standard deviations allow for chance), and in no earlier table's bucket. Marked vectors alone are then brought
there, and compared as a matrix, in double precision. A link counts in the first table that finds it, and a
block pair sends on per vector its number of links and the smallest vector it is joined to there,
never the pairs.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite
component, and those without a label, link with nothing and form a component of their own. Vectors are scaled by a power of
two first, so that neither huge nor tiny components overflow. Vectors of
different length link with nothing. Repeated ids: rows that share an id stand
for one vector each as to links, and the smallest id names the component; a null id stays null and alone.
Other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint
from .components import components

BLOCK = 512
SIGMAS = 7.0


def plan(n: int, threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """Planes per table and tables: buckets hold few strangers, and a pair at the threshold is missed with ``miss``."""
    planes = int(min(30, max(6, math.ceil(math.log2(max(2, n))) - 4)))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def hyperplanes(width: int, planes: int, tables: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, planes * tables))


def scaled(v: np.ndarray) -> np.ndarray:
    """The vector times the power of two that brings its largest component below 1: no component's digits change."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def near_enough(planes: int, tables: int, threshold: float) -> int:
    """In how many of all signs a pair at the threshold may differ."""
    n, p = planes * tables, math.acos(min(1.0, threshold)) / math.pi
    return math.ceil(n * p + SIGMAS * math.sqrt(n * p * (1 - p)) + 1)


def _pack(planes: int, tables: int):
    """The vectors as packed doubles, and the signs of all tables as bits, each table's from a byte's border on."""

    def run(batches):
        for batch in batches:
            raw = [scaled(np.asarray(v.as_py(), "<f8")) for v in batch.column("v")]
            signs: list = [None] * len(raw)
            for width in {len(v) for v in raw}:
                at = [i for i, v in enumerate(raw) if len(v) == width]
                side = (np.stack([raw[i] for i in at]) @ hyperplanes(width, planes, tables)) >= 0
                for i, bits in zip(at, np.packbits(side.reshape(len(at), tables, planes), axis=2).reshape(len(at), -1), strict=True):
                    signs[i] = bits.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").cast(pa.int64()), batch.column("label"), batch.column("copies"), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(signs, pa.binary())],
                ["rep", "label", "copies", "vector", "signs"],
            )

    return run


def _read_signs(rows: list[bytes], tables: int) -> np.ndarray:
    """(rows, tables, bytes of a table)"""
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), tables, -1)


def _by_key(names: tuple[str, ...], finish, drain):
    """Over rows sorted by key: ``finish`` takes all rows of a key, ``drain`` gives what is ready."""

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for k, *row in zip(*[batch.column(c).to_pylist() for c in ("key", *names)], strict=True):
                if k != key and rows:
                    finish(key, rows)
                    rows = []
                key = k
                rows.append(row)
            yield drain()
        if rows:
            finish(key, rows)
        yield drain()

    return run


def _mark(tables: int, most: int):
    """The rows of a block pair (rep, signs, side, t) that may have a link there which no earlier table has."""

    def run(batches):
        out: dict[str, list] = {"key": [], "rep": [], "side": [], "t": []}

        def finish(key, rows):
            side, t = np.array([r[2] for r in rows]), rows[0][3]
            signs = _read_signs([r[1] for r in rows], tables)
            flat = signs.reshape(len(rows), -1)
            hit = np.zeros(len(rows), bool)
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            some = max(1, 8192 // len(right)) if len(right) else 1
            for a in range(0, len(left), some):
                part = left[a : a + some]
                i, j = np.nonzero(np.bitwise_count(flat[part][:, None] ^ flat[right][None]).sum(axis=2, dtype=np.int32) <= most)
                i, j = part[i], right[j]
                good = (i < j) if side[0] == 2 else (i != j)
                i, j = i[good], j[good]
                if t and len(i):
                    first = ~(signs[i, :t] == signs[j, :t]).all(axis=2).any(axis=1)
                    i, j = i[first], j[first]
                hit[i] = True
                hit[j] = True
            for i in np.flatnonzero(hit).tolist():
                for name, x in zip(out, (key, rows[i][0], int(side[i]), t), strict=True):
                    out[name].append(x)

        def drain():
            got = pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["rep"], pa.int64()), pa.array(out["side"], pa.int32()), pa.array(out["t"], pa.int32())], list(out))
            for x in out.values():
                x.clear()
            return got

        yield from _by_key(("rep", "signs", "side", "t"), finish, drain)(batches)

    return run


def _joined(pairs_i, pairs_j, n):
    """The smallest member joined to each of n local members by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[pairs_i], root[pairs_j])
        new = root.copy()
        np.minimum.at(new, pairs_i, low)
        np.minimum.at(new, pairs_j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float, tables: int):
    """Exact cosines between the marked rows (rep, copies, vector, signs, side, t) of a block pair."""

    def run(batches):
        out_rep, out_low, out_links = [], [], []

        def finish(_, rows):
            rows.sort(key=lambda r: r[0])
            rep, copies, side, t = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[4] for r in rows]), rows[0][5]
            widths = np.array([len(r[2]) for r in rows])
            signs = _read_signs([r[3] for r in rows], tables)
            got_i, got_j = [], []
            for width in set(widths.tolist()):
                at = np.flatnonzero(widths == width)
                left, right = at[side[at] != 1], at[side[at] != 0]
                if not len(left) or not len(right):
                    continue
                x = np.stack([np.frombuffer(rows[i][2], "<f8") for i in at])
                x /= np.sqrt((x * x).sum(1))[:, None]
                place = np.full(len(rows), -1)
                place[at] = np.arange(len(at))
                i, j = np.nonzero(x[place[left]] @ x[place[right]].T >= threshold)
                i, j = left[i], right[j]
                good = (i < j) if side[0] == 2 else (i != j)
                i, j = i[good], j[good]
                if t and len(i):
                    first = np.ones(len(i), bool)
                    for k in range(0, len(i), 16_384):
                        s = slice(k, k + 16_384)
                        first[s] = ~(signs[i[s], :t] == signs[j[s], :t]).all(axis=2).any(axis=1)
                    i, j = i[first], j[first]
                got_i.append(i)
                got_j.append(j)
            i, j = (np.concatenate(got_i), np.concatenate(got_j)) if got_i else (np.zeros(0, int), np.zeros(0, int))
            if len(i):
                links = np.bincount(i, weights=copies[j], minlength=len(rows)) + np.bincount(j, weights=copies[i], minlength=len(rows))
                low = _joined(i, j, len(rows))
                hit = np.flatnonzero(links)
                out_rep.append(rep[hit])
                out_low.append(rep[low[hit]])
                out_links.append(links[hit].astype(np.int64))

        def drain():
            got = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_rep, out_low, out_links)]
            for x in (out_rep, out_low, out_links):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["u", "v", "links"])

        yield from _by_key(("rep", "copies", "vector", "signs", "side", "t"), finish, drain)(batches)

    return run


def link_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", miss: float = 1e-6) -> DataFrame:
    """id, n_links, component_id, kept: one row per input row."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    some = F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(finite & some & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), v).alias("v"))
    folded = checkpoint(
        rows.where(F.col("v").isNotNull())
        .groupBy("label", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), " "), 256).alias("digest"))
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    )
    n = folded.count()
    planes, tables = plan(n, threshold, miss)
    bytes_each = -(-planes // 8)
    packed = folded.select("rep", F.col("label").cast("string").alias("label"), "copies", "v").mapInArrow(_pack(planes, tables), "rep long, label string, copies long, vector binary, signs binary")
    packed = checkpoint(packed)
    # What travels per table is the id and a digest of label, table and bucket.
    bucket = lambda t: F.xxhash64("label", t, F.substring("signs", t * bytes_each + 1, bytes_each))
    placed = packed.select("rep", "signs", "label", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t")).select("rep", "t", bucket(F.col("t")).alias("k"))
    sizes = placed.groupBy("k").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = (
        placed.join(sizes, "k").join(packed.select("rep", "signs"), "rep")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "rep", "signs",
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "t",
        )
    )
    marked = dealt.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_mark(tables, near_enough(planes, tables, threshold)), "key long, rep long, side int, t int")
    brought = checkpoint(marked).join(packed.select("rep", "copies", "vector", "signs"), "rep").select("key", "rep", "copies", "vector", "signs", "side", "t")
    met = brought.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(threshold, tables), "u long, v long, links long")
    met = checkpoint(met)
    joined = components(met.select("u", "v"))
    links = met.groupBy("u").agg(F.sum("links").alias("links"))
    by_rep = folded.select("label", "digest", "rep", "copies").join(links, F.col("rep") == F.col("u"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    by_rep = by_rep.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    keyed = rows.withColumn("digest", F.when(F.col("v").isNotNull(), F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), " "), 256))).select("id", "label", "digest")
    out = keyed.join(by_rep, ["label", "digest"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

