"""MinHash near-dedup (operator 5) with an LSH forest, confirmed on full shingle sets.

A document's set holds its distinct shingles of ``SHINGLE`` words (A-Z lower-cased). Documents of equal sets
are folded into one. Each set gets a signature of ``VALUES`` MinHash values. The forest has ``TREES`` orders: each sorts the
signatures from another of their values on. Documents with the same first ``BASE`` values of an order form a region; its ``DEEP``
next values are the label by which the region is sorted, and neighbours there have the longest common prefixes.

1. Neighbours: every document proposes its best neighbour in the orders and the first document of a region.
2. Leaves: a region with several components is parted along its sorted labels, deeper where it is dense, until a part, a leaf, holds
   ``BLOCK`` documents at most (or has no further value). All pairs of a leaf across components are candidates.
3. The rest: in regions that were parted and still hold several components, pairs across leaves and components.

Candidates are judged by the whole signatures, each pair in the first order that has it in one region; only documents with a
candidate above the floor bring their texts there, and a pair counts if its full sets are alike enough. Links give components.
So no link between components is lost to the choice of neighbours, and step 3 has work only where step 2 parted a region.
At a similarity of 0.75 a pair shares no region with probability (1 - 0.75**BASE)**TREES, about 2e-6; the signatures judge a
true pair below the floor with a probability of about 3e-5.

Defined results: null texts and texts without words have no shingles, link with nothing and are kept. Rows of repeated or null
ids are documents of their own; a component takes its smallest id, nulls last, and a group of null ids only has none. Very long texts are
read whole; leaves are dealt so that about ``WEIGHT`` shingles meet in a task at once, or one document. Ties between neighbours go to the smaller id.
Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint
from .components import components

SHINGLE = 5
TREES, STEP, BASE, DEEP = 24, 5, 3, 8
VALUES = TREES * STEP
ROUNDS = 1
BLOCK, WEIGHT = 256, 2_000_000
#: A candidate's estimated similarity may fall short of the threshold by this: about four standard errors of VALUES values.
SLACK = 0.16
_SEEDS = np.random.default_rng(5)
_A = (_SEEDS.integers(0, 1 << 32, VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _SEEDS.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_P = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(SHINGLE)]


class WordHashes(dict):
    """64-bit hashes of words, kept until there are many; long ones are not kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 400_000:
                self.clear()
            self[word] = h
        return h


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six white-space bytes


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """Distinct 64-bit shingle hashes, sorted."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    n = len(w) - SHINGLE + 1
    s = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        s += h[j : j + n] * _P[j]
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a set."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024]
        np.minimum(least, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=least)
    return least


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sign(batches):
    known = WordHashes()
    for batch in batches:
        n, keys, signs = [], [], []
        for t in batch.column("text"):
            s = shingles(t.as_py(), known)
            n.append(len(s))
            keys.append(digest(s) if len(s) else None)
            signs.append(signature(s).astype("<u4").tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["id", "n_shingles", "digest", "signature"])


def regions(v: np.ndarray) -> np.ndarray:
    """(documents, TREES): a hash of each order's first values."""
    region = np.zeros((len(v), TREES), np.uint64)
    for d in range(BASE):
        region = (region ^ v[:, d::STEP]) * np.uint64(0x9E3779B97F4A7C15)
        region ^= region >> np.uint64(31)
    return region


def labels(v: np.ndarray) -> np.ndarray:
    """(documents, TREES): a byte of each of an order's next values, the first one on top."""
    label = np.zeros((len(v), TREES), np.uint64)
    for d in range(BASE, BASE + DEEP):
        label = (label << np.uint64(8)) | (v[:, (np.arange(TREES) * STEP + d) % VALUES] & np.uint32(255))
    return label


def _values(column) -> np.ndarray:
    return np.array([np.frombuffer(x.as_py(), "<u4") for x in column], np.uint32).reshape(-1, VALUES)


def _plant(batches):
    """Per document and order: the region and the label."""
    for batch in batches:
        v = _values(batch.column("signature"))
        n = len(v)
        if not n:
            continue
        each = np.repeat(np.arange(n), TREES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep").take(pa.array(each)), batch.column("n").take(pa.array(each)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(regions(v).ravel().view(np.int64)), pa.array(labels(v).ravel().view(np.int64))],
            ["rep", "n", "t", "region", "label"],
        )


def _short(batches):
    """The signatures with a byte per value, enough to estimate similarity, then four bytes of each order's region."""
    for batch in batches:
        v = _values(batch.column("signature"))
        v = [a.tobytes() + b.tobytes() for a, b in zip(v.astype(np.uint8), regions(v).astype("<u4"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(v, pa.binary())], ["rep", "short"])


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _neighbours(floor: float):
    """Over rows sorted by tree, region and label: each document with the row before it that is of another component, and with the region's first."""

    def run(batches):
        head = last = other = None  # rows of this region: the first, the one before, the latest of another component than that
        for batch in batches:
            out = {"u": [], "v": [], "alike": [], "first": []}
            rows = zip(*[batch.column(k).to_pylist() for k in ("t", "region", "rep", "component", "short")], strict=True)
            for t, region, rep, component, short in rows:
                row = (t, region, rep, component, np.frombuffer(short, np.uint8, VALUES))
                if head is None or head[:2] != row[:2]:
                    head, last, other = row, row, None
                    continue
                before = last if last[3] != component else other
                for mate, first in ((before, False), (head, True)):
                    if mate is not None and mate[3] != component and (first or mate is not head):
                        alike = float(_alike(row[4], mate[4]))
                        if alike >= floor:
                            out["u"].append(rep)
                            out["v"].append(mate[2])
                            out["alike"].append(alike)
                            out["first"].append(first)
                if last[3] != component:
                    other = last
                last = row
            yield pa.RecordBatch.from_arrays([pa.array(out["u"], pa.int64()), pa.array(out["v"], pa.int64()), pa.array(out["alike"], pa.float64()), pa.array(out["first"], pa.bool_())], list(out))

    return run


def _candidates(component, short, leaf, side, t: int, floor: float):
    """(i, j) by rows of a block pair: of different components, alike above the floor, in one region here first, and (in step 3) of different leaves."""
    values = np.stack([np.frombuffer(x, np.uint8, VALUES) for x in short])
    region = np.stack([np.frombuffer(x, "<u4", TREES, VALUES) for x in short])
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for i in left.tolist():
        j = right[right > i] if side[0] == 2 else right
        j = j[component[j] != component[i]]
        if leaf[0] is not None:
            j = j[leaf[j] != leaf[i]]
        j = j[_alike(values[j], values[i]) >= floor]
        if t and len(j):
            j = j[~(region[j, :t] == region[i, :t]).any(axis=1)]
        if len(j):
            yield i, j


def _by_key(batches, names: tuple[str, ...], finish):
    """Over rows sorted by key: yields what ``finish`` makes of all rows of each key, once per batch."""
    key, rows, found = None, [], []
    for batch in batches:
        for k, *row in zip(*[batch.column(c).to_pylist() for c in ("key", *names)], strict=True):
            if k != key and rows:
                found += finish(key, rows)
                rows = []
            key = k
            rows.append(row)
        yield found
        found = []
    yield finish(key, rows) if rows else []


def _mark(floor: float):
    """The rows of block pairs (rep, component, short, leaf, side, t) that have a candidate there."""

    def finish(key, rows):
        rep, component, short, leaf, side, t = zip(*rows, strict=True)
        hit = set()
        for i, j in _candidates(np.array(component), short, np.array(leaf), np.array(side), t[0], floor):
            hit.add(i)
            hit.update(j.tolist())
        return [(key, *rows[i]) for i in sorted(hit)]

    def run(batches):
        names = ["key", "rep", "component", "short", "leaf", "side", "t"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
        for found in _by_key(batches, tuple(names[1:]), finish):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kind) for c, kind in enumerate(kinds)], names)

    return run


def _across(floor: float, percent: int):
    """Over the marked rows of block pairs with their texts: links between components, until those they join are one."""
    known = WordHashes()

    def finish(_, rows):
        rep, component, short, leaf, side, t, text = zip(*rows, strict=True)
        sets: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def full(i):
            if i not in sets:
                sets[i] = shingles(text[i], known)
            return sets[i]

        def find(c):
            while c in root:
                c = root[c]
            return c

        links = []
        for i, j in _candidates(np.array(component), short, np.array(leaf), np.array(side), t[0], floor):
            for k in j.tolist():
                a, b = find(component[i]), find(component[k])
                if a == b:
                    continue
                x, y = full(i), full(k)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[max(a, b)] = min(a, b)
                    links.append((max(rep[i], rep[k]), min(rep[i], rep[k])))
        return links

    def run(batches):
        for found in _by_key(batches, ("rep", "component", "short", "leaf", "side", "t", "text"), finish):
            yield _pairs(set(found))

    return run


def _pairs(found: set) -> pa.RecordBatch:
    got = sorted(found)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in got], pa.int64()), pa.array([p[1] for p in got], pa.int64())], ["u", "v"])


def _confirm(percent: int):
    def run(batches):
        known = WordHashes()
        last_text, last = None, None
        for batch in batches:
            good = []
            for a, b in zip(*[batch.column(k) for k in ("text_u", "text_v")], strict=True):
                a, b = a.as_py(), b.as_py()
                if b != last_text:
                    last_text, last = b, shingles(b, known)
                x, y = shingles(a, known), last
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(good, pa.bool_())], ["u", "v", "linked"])

    return run


def leaves(rows: DataFrame) -> DataFrame:
    """With a leaf's key, and whether its region was parted. Rows: of regions (t, region) with their size."""
    region = F.xxhash64("t", "region")
    prefix = lambda d: F.expr(f"shiftrightunsigned(label, 8 * ({DEEP} - {d}))")
    flat = rows.where(F.col("size") > BLOCK).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(DEEP)))).select("rep", "t", F.xxhash64("t", "region", "d", prefix("d")).alias("leaf"), "d")
    fits = flat.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") <= BLOCK).select("leaf")
    shallow = flat.join(fits, "leaf").groupBy("rep", "t").agg(F.min_by("leaf", "d").alias("fit"))
    deepest = F.xxhash64("t", "region", F.lit(DEEP), "label")
    parted = F.col("size") > BLOCK
    return rows.join(shallow, ["rep", "t"], "left").withColumn("leaf", F.when(parted, F.coalesce("fit", deepest)).otherwise(region)).withColumn("parted", parted).drop("fit")


def _mixed(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of groups that hold several components, with the groups' sizes and shingles."""
    groups = rows.groupBy(*keys).agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size"), F.sum("n").alias("weight")).where("a < b")
    return rows.drop("size", "weight").join(groups.select(*keys, "size", "weight"), list(keys))


def _links_between(rows: DataFrame, group: Column, leaf: Column, short: DataFrame, bodies: DataFrame, floor: float, percent: int) -> DataFrame:
    """Links across components inside groups, dealt in pairs of blocks. Rows: rep, t, component, size and weight of their group."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    dealt = (
        rows.select("rep", "t", "component", group.alias("g"), leaf.cast("long").alias("leaf"), blocks.alias("blocks"))
        .join(short, "rep")
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "rep", "component", "short", "leaf",
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "t",
        )
    )
    marked = dealt.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_mark(floor), "key long, rep long, component long, short binary, leaf long, side int, t int")
    brought = checkpoint(marked).join(bodies, "rep").repartition("key").sortWithinPartitions("key", "rep")
    return checkpoint(brought.mapInArrow(_across(floor, percent), "u long, v long"))


def _own_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """id, given (the column's own), text: ids are unique and in the order of given ids, nulls last; whether they had to be made."""
    rows = docs.select(F.col(id_col).cast("long").alias("given"), F.col(text_col).alias("text"))
    if not rows.groupBy("given").count().where("count > 1 or given is null").take(1):
        return rows.select(F.col("given").alias("id"), "given", "text"), False
    ordered = rows.orderBy(F.col("given").asc_nulls_last(), "text")
    return checkpoint(ordered.select(F.monotonically_increasing_id().alias("id"), "given", "text")), True


def link_documents(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: one row per input row."""
    floor = percent / 100 - SLACK
    texts, made = _own_rows(docs, id_col, text_col)
    signed = checkpoint(texts.select("id", "text").mapInArrow(_sign, "id long, n_shingles long, digest binary, signature binary"))
    folded = checkpoint(signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")))
    planted = folded.select("rep", "n", "signature").mapInArrow(_plant, "rep long, n long, t int, region long, label long")
    shared = planted.groupBy("t", "region").agg(F.count("*").alias("size")).where("size > 1")
    rows = checkpoint(planted.join(shared.select("t", "region"), ["t", "region"]))
    chosen = folded.join(rows.select("rep").distinct(), "rep")
    short = checkpoint(chosen.select("rep", "signature").mapInArrow(_short, "rep long, short binary"))
    bodies = checkpoint(texts.join(chosen.select("rep"), F.col("id") == F.col("rep")).select("rep", "text"))

    edges = joined = None

    def now() -> DataFrame:
        if joined is None:
            return rows.withColumn("component", F.col("rep"))
        return rows.join(joined, F.col("rep") == F.col("node"), "left").select(*rows.columns, F.coalesce("component", "rep").alias("component"))

    def add(links: DataFrame) -> None:
        nonlocal edges, joined
        if links.take(1):
            edges = links if edges is None else edges.unionByName(links)
            joined = components(edges)

    for _ in range(ROUNDS):
        ordered = now().join(short, "rep").select("t", "region", "label", "rep", "component", "short").repartitionByRange("t", "region", "label", "rep").sortWithinPartitions("t", "region", "label", "rep")
        near = ordered.mapInArrow(_neighbours(floor), "u long, v long, alike double, first boolean")
        best = near.groupBy("u").agg(F.max_by("v", F.struct("alike", -F.col("v"))).alias("x"), F.min(F.when(F.col("first"), F.col("v"))).alias("y"))
        pairs = best.select("u", F.explode(F.array("x", "y")).alias("v")).where("v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        first = bodies.select(F.col("rep").alias("u"), F.col("text").alias("text_u"))
        second = bodies.select(F.col("rep").alias("v"), F.col("text").alias("text_v"))
        judged = checkpoint(pairs.join(first, "u").join(second, "v").mapInArrow(_confirm(percent), "u long, v long, linked boolean"))
        add(judged.where("linked").select("u", "v"))

    grown = checkpoint(leaves(_mixed(now(), "t", "region")).select("rep", "n", "t", "leaf", "parted", "component", F.xxhash64("t", "region").alias("region")))
    add(_links_between(_mixed(grown, "leaf"), F.col("leaf"), F.lit(None), short, bodies, floor, percent))
    rows = grown.where("parted").drop("component")
    add(_links_between(_mixed(now(), "region"), F.col("region"), F.col("leaf"), short, bodies, floor, percent))

    by_set = folded.select("digest", "rep")
    if joined is not None:
        by_set = by_set.join(joined, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    else:
        by_set = by_set.withColumnRenamed("rep", "component_id")
    out = signed.select("id", "n_shingles", "digest").join(by_set, "digest", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    if made:
        names = texts.select(F.col("id").alias("_id"), "given")
        out = out.join(names, F.col("id") == F.col("_id")).drop("id", "_id").withColumnRenamed("given", "id")
        out = out.join(names, F.col("component_id") == F.col("_id")).drop("component_id", "_id").withColumnRenamed("given", "component_id")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
