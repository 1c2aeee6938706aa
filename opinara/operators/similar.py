"""Set-similarity joins within blocks, both exact: by prefix filtering for sets of which few share a member, by tiles for texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Texts a tile and columns of a matrix: bounds of a task's memory.
TILE = 2048
COLUMNS = 4096


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Over all partitions of the session's setting, for work that is heavier than its rows' bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def similar_pairs(rows: DataFrame, block: list[str], key: str, tokens: str, threshold: float) -> DataFrame:
    """Pairs (a < b) of one block whose token sets have a Jaccard similarity of ``threshold`` at least.

    Each set is ordered by how rare its tokens are in the block; similar sets share one of their first
    size - ceil(threshold * size) + 1 tokens, so only those are joined. Sizes must be within the threshold of each other, and what is
    left of both sets from the shared token on must be enough for the overlap that the threshold asks for.
    """
    rows = rows.where(F.size(tokens) > 0).select(*block, F.col(key).alias("_id"), F.col(tokens).alias("_set"))
    flat = rows.select(*block, "_id", F.explode("_set").alias("_t"))
    rarity = flat.groupBy(*block, "_t").agg(F.count("*").alias("_df"))
    ordered = flat.join(rarity, [*block, "_t"]).groupBy(*block, "_id").agg(F.sort_array(F.collect_list(F.struct("_df", "_t"))).alias("_o"))
    n = F.size("_o")
    prefix = F.slice("_o", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1)
    heads = ordered.select(*block, "_id", n.alias("_n"), F.posexplode(prefix).alias("_i", "_p")).select(*block, "_id", "_n", "_i", F.col("_p._t").alias("_t"))
    a, b = heads.alias("a"), heads.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*block, "_t")]
    close = (F.col("a._n") >= F.col("b._n") * threshold - 1e-9) & (F.col("b._n") >= F.col("a._n") * threshold - 1e-9)
    left = F.least(F.col("a._n") - F.col("a._i"), F.col("b._n") - F.col("b._i"))
    able = left * (1 + threshold) >= (F.col("a._n") + F.col("b._n")) * threshold - 1e-9
    pairs = a.join(b, [*same, F.col("a._id") < F.col("b._id"), close, able]).select(F.col("a._id").alias("a"), F.col("b._id").alias("b")).distinct()
    first = rows.select(F.col("_id").alias("a"), F.col("_set").alias("_x"))
    second = rows.select(F.col("_id").alias("b"), F.col("_set").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    likeness = both / (F.size("_x") + F.size("_y") - both)
    return pairs.join(first, "a").join(second, "b").withColumn("similarity", likeness).where(F.col("similarity") >= threshold - 1e-12).select("a", "b", "similarity")


@F.pandas_udf(T.BinaryType())
def packed_pairs(text: pd.Series) -> pd.Series:
    """A text's distinct pairs of neighbouring characters as bytes, for ``similar_texts``: 4 a pair, 8 where a character lies beyond the first 65536."""

    def pack(t):
        c = np.frombuffer((t or "").encode("utf-32-le"), dtype=np.uint32)
        wide = bool(c.size) and int(c.max()) > 0xFFFF
        kind, bits = (np.uint64, 32) if wide else (np.uint32, 16)
        c = c.astype(kind)
        pairs = np.unique((c[:-1] << kind(bits)) | c[1:])
        return (b"8" if wide else b"4") + pairs.astype(kind).tobytes()

    return pd.Series([pack(t) for t in text], dtype=object)


def _unpacked(b: bytes) -> np.ndarray:
    if b[:1] == b"8":
        return np.frombuffer(b, dtype=np.uint64, offset=1)
    v = np.frombuffer(b, dtype=np.uint32, offset=1).astype(np.uint64)
    return ((v >> np.uint64(16)) << np.uint64(32)) | (v & np.uint64(0xFFFF))


def _overlaps(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many members each of the first sets shares with each of the second, by a product of their 0/1 rows, some columns at a time."""
    out = np.zeros((first.size, second.size), dtype=np.float32)
    sizes = [s.size for s in sets]
    members, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # others are in no overlap
    column, row = (np.cumsum(shared) - 1)[column][shared[column]], np.repeat(np.arange(len(sets)), sizes)[shared[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        ones = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - low)), dtype=np.float32)
        ones[row[a:b], column[a:b] - low] = 1
        out += ones @ ones.T if first is second else ones[first] @ ones[second].T
    return out


def _tile(side: np.ndarray, ids: np.ndarray, packed: list[bytes], threshold: float, pairs: bool) -> pd.DataFrame | None:
    """What is similar in one tile: rows of side 2 with each other, or those of side 0 with those of side 1."""
    if len(ids) < 2:
        return None
    sets, n = [_unpacked(b) for b in packed], len(ids)
    whole = side[0] == 2
    first, second = (np.arange(n),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not first.size or not second.size:
        return None
    size = np.array([s.size for s in sets], dtype=np.float64)
    both = _overlaps(sets, first, second).astype(np.float64)
    likeness = both / np.maximum(size[first][:, None] + size[second][None, :] - both, 1)
    hit = (likeness >= threshold - 1e-12) & (both > 0)
    if whole:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    x, y = ids[first[i]], ids[second[j]]
    if pairs:
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "similarity": likeness[i, j]})
    return pd.DataFrame({"id": np.unique(np.concatenate([x, y]))})


def similar_texts(rows: DataFrame, block: str, key: str, packed: str, threshold: float, pairs: bool = True) -> DataFrame:
    """a < b and similarity of pairs of one block whose ``packed_pairs`` have a Jaccard similarity of ``threshold`` at least; or only the ``id`` of each member of such a pair.

    Texts of letters share most of their pairs of characters, so that any one shared pair joins nearly all of a block. Here texts are dealt
    into tiles of about ``TILE``: a small block is one; a larger one goes by sizes first, of which only neighbouring steps can be
    similar, and a step of many texts by parts. Each pair of texts that can be similar meets in one tile, as columns of
    a product of matrices; what is written is the packed texts, once for a block of one tile, and no candidates.
    """
    step = F.floor(F.log(F.col("_n").cast("double")) / float(np.log(1 / threshold) * 1.001)).cast("int")
    rows = rows.select(F.col(block).alias("_block"), F.col(key).cast("long").alias("_id"), F.col(packed).alias("_packed"))
    rows = rows.withColumn("_n", F.floor((F.length("_packed") - 1) / F.when(F.substring("_packed", 1, 1) == F.lit(b"8"), 8).otherwise(4)).cast("int")).where("_n > 0").withColumn("_step", step)
    steps = rows.groupBy("_block", "_step").agg(F.count("*").alias("_k"))
    whole = F.sum("_k") <= TILE
    layout = steps.groupBy("_block").agg(whole.alias("_whole"), F.map_from_entries(F.collect_list(F.struct("_step", F.ceil(F.col("_k") / TILE).cast("int")))).alias("_parts"))
    rows = rows.join(layout, "_block")
    parts = lambda s: F.coalesce(F.try_element_at("_parts", s), F.lit(0))
    mine = F.when(F.col("_whole"), F.lit(0)).otherwise(F.pmod(F.xxhash64("_id"), parts(F.col("_step"))).cast("int"))
    rows = rows.withColumn("_part", mine)
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    s, p = F.col("_step"), F.col("_part")
    tile = lambda a, i, b, j, side: F.struct(F.concat_ws(",", a, i, b, j, "_block").alias("tile"), side.alias("side"))
    own = F.transform(up_to(parts(s)), lambda j: tile(s, F.least(p, j), s, F.greatest(p, j), F.when(p < j, 0).when(p > j, 1).otherwise(2)))
    above = F.transform(up_to(parts(s + 1)), lambda j: tile(s, p, s + 1, j, F.lit(0)))
    below = F.transform(up_to(parts(s - 1)), lambda j: tile(s - 1, j, s, p, F.lit(1)))
    zero = F.lit(0)
    tiles = F.when(F.col("_whole"), F.array(tile(zero, zero, zero, zero, F.lit(2)))).otherwise(F.concat(own, above, below))
    dealt = rows.select(F.explode(tiles).alias("_t"), "_id", "_packed").select("_t.tile", "_t.side", "_id", "_packed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []  # of the last tile, which may go on in the next batch

        def found(pdf):
            return _tile(pdf["side"].to_numpy(), pdf["_id"].to_numpy(), pdf["_packed"].tolist(), threshold, pairs)

        for pdf in batches:
            pdf = pd.concat([*kept, pdf], ignore_index=True) if kept else pdf
            tiles = pdf["tile"].to_numpy()
            edges = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
            for a, b in zip(edges[:-2], edges[1:-1], strict=True):
                if (out := found(pdf.iloc[a:b])) is not None and len(out):
                    yield out
            kept = [pdf.iloc[edges[-2] :]]
        if kept and (out := found(kept[0])) is not None and len(out):
            yield out

    out = spread(dealt, "tile").sortWithinPartitions("tile").mapInPandas(run, "a long, b long, similarity double" if pairs else "id long")
    return out if pairs else out.distinct()
