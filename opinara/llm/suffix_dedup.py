"""Suffix-array dedup (operator 10): every byte inside a string of ``MATCH`` bytes that also starts earlier goes.

Only suffixes that can matter are sorted. Positions are selected by content: where the hash of the next ``GRAM`` bytes is
the least of some ``MATCH``-byte window, so equal windows hold equal selected places and none is without one.

1. Each task asks, by hash, which selected grams occur twice, and how often; grams repeated within the task are known at once.
2. Suffixes at repeated grams, up to ``MATCH`` bytes with what can stand before them in a window, are sorted per task;
   equal ones are folded into the earliest. The sorted runs go out front-coded: each suffix as the length of
   the prefix it shares with the one before, and the rest.
3. Each bucket of grams merges its runs with a loser tree that knows for every contender its common prefix with the
   last winner, so known prefixes are never compared again. The common prefixes of the merged order bound the
   groups of one gram; within a group all windows around it are told apart, and all but the earliest of equal ones are covered.
   Windows are found equal by a hash and their bytes then compared.
4. Covered stretches return to their documents by id.

A task holds one bucket at a time, of about 2 MB of texts, and partitions grow in number with the texts. A gram of ``HOT`` occurrences or
more (a larger number beyond ``HOT << 26`` bytes, so that such grams are 2 million at most) would not fit one: the windows of which it is
the least gram are keyed each by its own digest instead, pre-aggregated to the earliest, and all others of a digest are covered.

Defined results: null texts count as empty; texts of fewer than ``MATCH`` bytes lose nothing, unless rows repeat (see
below); nothing is matched across documents. Where ids repeat or are null, rows stand in the order of (id, text), nulls first, each as a document of
its own. Every input row gives one row. Very long texts are read whole, their suffixes sorted 50,000 at a time. Empty tables give empty results.
Of other columns those named in ``keep`` stay with their row, whatever they are called but for the results' own names.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, wanted_partitions

MATCH, GRAM = 100, 32
WINDOW = MATCH - GRAM + 1  # grams of a window
BEFORE = MATCH - GRAM  # bytes of a window in front of its gram at most
FLUSH = 8 << 20
HOT = 500_000
_RNG = np.random.default_rng(10)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """The pick (minimum or maximum) of every ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def selected(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected places of a text's bytes, the hashes of the grams there, and the least hash of every window."""
    if len(data) < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = _BYTE[data]
    size = 1
    while size < GRAM:
        h = h[:-size] * _power(size) + h[size:]
        size *= 2
    g = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    g |= np.uint64(1)
    least = _slide(g, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), WINDOW, np.maximum) == g)
    return at, g[at], least


# What goes back to documents travels packed, by buckets of ids


def pack_docs(ids, payloads: list[bytes]) -> bytes:
    return struct.pack("<I", len(ids)) + np.asarray(ids, "<i8").tobytes() + np.array([len(p) for p in payloads], "<u4").tobytes() + b"".join(payloads)


def unpack_docs(blob: bytes):
    (n,) = struct.unpack_from("<I", blob)
    at = 4 + 12 * n
    for i, size in zip(np.frombuffer(blob, "<i8", n, 4).tolist(), np.frombuffer(blob, "<u4", n, 4 + 8 * n).tolist(), strict=True):
        yield i, blob[at : at + size]
        at += size


def by_doc_bucket(ids, payloads: list[bytes], buckets: int) -> tuple[list[int], list[bytes]]:
    """(bucket, pack) of payloads per document."""
    held: dict[int, list] = {}
    for i, p in zip(ids, payloads, strict=True):
        held.setdefault(i % buckets, []).append((i, p))
    return list(held), [pack_docs(*zip(*x, strict=True)) for x in held.values()]


def _by_key(batches, finish):
    """Over (key, kind, blob) rows sorted by key: what ``finish`` makes of the blobs of kind 0 of each key, and blobs of kind 1 as they are, as (key, blob) rows."""
    key, blobs = None, []
    for batch in batches:
        keys, out = [], []
        for k, kind, blob in zip(*[batch.column(c).to_pylist() for c in ("key", "kind", "blob")], strict=True):
            if k != key and blobs:
                made = finish(blobs)
                keys += made[0]
                out += made[1]
                blobs = []
            key = k
            if kind:
                keys.append(k)
                out.append(blob)
            else:
                blobs.append(blob)
        yield keys, out
    yield finish(blobs) if blobs else ([], [])


def _blob_rows(keys, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["key", "blob"])


def _deal(batches):
    """One row per document with all that was packed for it; rows are sorted by the documents' bucket."""
    key, held = None, {}

    def drain():
        ids = list(held)
        for a in range(0, len(ids), 1000):
            part = ids[a : a + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([b"".join(held.pop(i)) for i in part], pa.binary())], ["at", "payload"])

    for batch in batches:
        for k, blob in zip(batch.column("key").to_pylist(), batch.column("blob"), strict=True):
            if k != key:
                yield from drain()
            key = k
            for i, p in unpack_docs(blob.as_py()):
                held.setdefault(i, []).append(p)
    yield from drain()


# 1. Which grams occur twice


def _ask(buckets: int, doc_buckets: int):
    def run(batches):
        ids, grams, size = [], [], 0

        def flush():
            counts = np.array([len(g) for g in grams])
            flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(grams), dtype=np.uint32), counts)
            _, first, where, n = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
            twice = n[where] > 1
            keys, blobs = [], []
            if twice.any():  # known at once: the answer goes straight to the documents
                order = np.flatnonzero(twice)  # doc is sorted
                starts = np.concatenate([[0], np.flatnonzero(np.diff(doc[order])) + 1])
                keys, blobs = by_doc_bucket([int(ids[d]) for d in doc[order[starts]]], [np.unique(x).tobytes() for x in np.split(flat[order], starts[1:])], doc_buckets)
            kinds = [1] * len(keys)
            at = np.sort(first)  # one entry for each gram, with its number; of those known here, it only tells the others
            times = n[where]
            part = flat[at] % np.uint64(buckets)
            by = np.argsort(part, kind="stable")
            at, part = at[by], part[by]
            cut = np.flatnonzero(np.diff(part)) + 1 if len(part) else []
            for x in np.split(at, cut) if len(at) else []:
                local, index = np.unique(doc[x], return_inverse=True)
                keys.append(int(flat[x[0]] % np.uint64(buckets)))
                blobs.append(struct.pack("<II", len(local), len(x)) + np.array([ids[d] for d in local], "<i8").tobytes() + flat[x].tobytes() + index.astype("<u4").tobytes() + times[x].astype("<u4").tobytes())
                kinds.append(0)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["key", "kind", "blob"])

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                data = np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8)
                if len(data) < MATCH:
                    continue
                ids.append(i)
                grams.append(selected(data)[1])
                size += len(data)
                if size > FLUSH:
                    yield flush()
                    ids, grams, size = [], [], 0
        if ids:
            yield flush()

    return run


def _answer(doc_buckets: int, hot: int):
    """All askers of a gram meet here; documents learn which of their grams occur elsewhere. Grams of ``hot`` occurrences come with a blob of no bytes."""

    def finish(blobs):
        docs, grams, times = [], [], []
        for blob in blobs:
            n_docs, n = struct.unpack_from("<II", blob)
            at = 8 + 8 * n_docs
            grams.append(np.frombuffer(blob, "<u8", n, at))
            docs.append(np.frombuffer(blob, "<i8", n_docs, 8)[np.frombuffer(blob, "<u4", n, at + 8 * n)])
            times.append(np.frombuffer(blob, "<u4", n, at + 12 * n))
        g, d, k = np.concatenate(grams), np.concatenate(docs), np.concatenate(times)
        known, where, n = np.unique(g, return_inverse=True, return_counts=True)
        often = known[np.bincount(where, weights=k) >= hot].view(np.int64).tolist()
        again = (n[where] > 1) & (k == 1)
        g, d = g[again], d[again]
        if not len(d):
            return often, [b""] * len(often)
        by = np.argsort(d, kind="stable")
        g, d = g[by], d[by]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        keys, packs = by_doc_bucket(d[starts].tolist(), [x.tobytes() for x in np.split(g, starts[1:])], doc_buckets)
        return keys + often, packs + [b""] * len(often)

    def run(batches):
        for found in _by_key(batches, finish):
            yield _blob_rows(*found)

    return run


def _windows(shared):
    """The windows whose least gram is among the shared ones: their bytes, document and start."""

    def run(batches):
        for batch in batches:
            windows, docs, starts = [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                data = (text.as_py() or "").encode("utf-8", "replace")
                at = np.flatnonzero(np.isin(selected(np.frombuffer(data, np.uint8))[2], shared.value)).tolist()
                windows += [data[a : a + MATCH] for a in at]
                docs += [i] * len(at)
                starts += at
            for a in range(0, len(docs), 20_000):
                s = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(windows[s], pa.binary()), pa.array(docs[s], pa.int64()), pa.array(starts[s], pa.int64())], ["window", "doc", "start"])

    return run


def _window_covers(doc_buckets: int):
    def run(batches):
        for batch in batches:
            doc, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "start"))
            yield _blob_rows(*by_doc_bucket(*_cover_rows(doc, start, start + MATCH), doc_buckets))

    return run


def covered_by_window(rows: DataFrame, shared, doc_buckets: int) -> DataFrame:
    """(key, blob) of stretches covered by windows around hot grams: all of equal windows but the earliest."""
    windows = rows.select("id", "text").mapInArrow(_windows(shared), "window binary, doc long, start long")
    windows = windows.select(F.unhex(F.left(F.sha2("window", 256), F.lit(32))).alias("w"), F.struct("doc", "start").alias("place"))
    first = windows.groupBy("w").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("w", "first")
    # Read back, it has no aggregate in front of the join, so that a window of very many documents can be split.
    again = windows.join(checkpoint(first), "w").where(F.col("place") > F.col("first")).select("place.*")
    return again.mapInArrow(_window_covers(doc_buckets), "key long, blob binary")


# 2. Sorted runs


def _contexts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per place the MATCH bytes from it, their number, the BEFORE bytes before it, and their number plus one; padded with zeros."""
    wide = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(MATCH, np.uint8)])
    around = wide[at[:, None] + np.arange(BEFORE + MATCH)[None, :]]
    after, before = np.minimum(MATCH, len(data) - at), np.minimum(BEFORE, at)
    return np.concatenate([around[:, BEFORE:], after[:, None].astype(np.uint8), around[:, :BEFORE], (before[:, None] + 1).astype(np.uint8)], axis=1)


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row has in common with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def pack_run(rows: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """A sorted run, front-coded: shared prefix lengths, the rest of each suffix, then what stands before, and origins."""
    key = rows[:, : MATCH + 1]
    shared = shared_prefixes(key)
    rest = key[np.arange(MATCH + 1)[None, :] >= shared[:, None]]
    body = struct.pack("<I", len(rows)) + shared.astype(np.uint8).tobytes() + rest.tobytes() + rows[:, MATCH + 1 :].tobytes() + doc.astype("<i8").tobytes() + pos.astype("<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack_run(blob: bytes):
    """suffixes (bytes), shared prefix lengths, what stands before (array), doc, pos"""
    body = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", body)
    shared = np.frombuffer(body, np.uint8, n, 4)
    at = 4 + n
    keys, last = [], b""
    for s in shared.tolist():
        last = last[:s] + body[at : at + MATCH + 1 - s]
        at += MATCH + 1 - s
        keys.append(last)
    before = np.frombuffer(body, np.uint8, n * (BEFORE + 1), at).reshape(n, BEFORE + 1)
    at += n * (BEFORE + 1)
    return keys, shared.tolist(), before, np.frombuffer(body, "<i8", n, at), np.frombuffer(body, "<i8", n, at + 8 * n)


def _cover_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list, list]:
    """One blob of (start, end) pairs per document."""
    by = np.lexsort((start, doc))
    doc, both = doc[by], np.stack([start[by], end[by]], axis=1).astype("<i8")
    cut = np.flatnonzero(np.diff(doc)) + 1
    return doc[np.concatenate([[0], cut])].tolist() if len(doc) else [], [x.tobytes() for x in np.split(both, cut)] if len(doc) else []


def _runs(buckets: int, doc_buckets: int, shared):
    def run(batches):
        held, size = [], 0

        def flush():
            rows, doc, pos, gram = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((pos, doc))
            by = by[np.argsort(np.ascontiguousarray(rows[by]).view(f"S{rows.shape[1]}").ravel(), kind="stable")]
            rows, doc, pos, gram = rows[by], doc[by], pos[by], gram[by]
            same = np.zeros(len(rows), bool)
            same[1:] = (rows[1:] == rows[:-1]).all(axis=1)
            after, before = rows[:, MATCH].astype(np.int64), rows[:, -1].astype(np.int64) - 1
            full = same & (after + before >= MATCH)
            keys, blobs = by_doc_bucket(*_cover_rows(doc[full], (pos - before)[full], (pos + after)[full]), doc_buckets)
            kinds = [1] * len(keys)
            rows, doc, pos, gram = rows[~same], doc[~same], pos[~same], gram[~same]
            part = gram % np.uint64(buckets)
            by = np.argsort(part, kind="stable")
            for x in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
                keys.append(int(part[x[0]]))
                blobs.append(pack_run(rows[x], doc[x], pos[x]))
                kinds.append(0)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["key", "kind", "blob"])

        for batch in batches:
            for i, text, grams in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("payload"), strict=True):
                if not grams.is_valid:  # nothing of it occurs twice
                    continue
                data = np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8)
                at, g, _ = selected(data)
                good = np.isin(g, np.frombuffer(grams.as_py(), "<u8"))
                if shared is not None:
                    good &= ~np.isin(g, shared.value)
                at, g = at[good], g[good]
                for a in range(0, len(at), 50_000):
                    part = at[a : a + 50_000]
                    held.append((_contexts(data, part), np.full(len(part), i, np.int64), part, g[a : a + 50_000]))
                    size += len(part) * (MATCH + BEFORE + 2)
                    if size > 2 * FLUSH:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return run


# 3. Merging


def _common(a: bytes, b: bytes, k: int) -> int:
    """The common prefix of two suffixes of which k bytes are known to be common."""
    n = min(len(a), len(b))
    if a[k:n] == b[k:n]:
        return n
    low, high = k, n
    while low < high:  # a[:low] == b[:low], and they differ before high + 1
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def merge_runs(runs: list[tuple[list[bytes], list[int]]]):
    """Yield (run, index, common prefix with the suffix yielded before) in sorted order.

    A loser tree; ``shared[r]`` is the common prefix of run r's head with the last winner. Of two
    heads the one that shares more with it is smaller, and only heads that share
    equally much are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head, at = [x[0][0] if x[0] else None for x in runs] + [None] * (k - len(runs)), [0] * k
    shared = [0] * k
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if head[a] is None or head[b] is None:
            return (b, a) if head[a] is None else (a, b)
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        c = _common(head[a], head[b], x)
        if head[a][c:] <= head[b][c:]:
            shared[b] = c
            return a, b
        shared[a] = c
        return b, a

    players = list(range(k))
    node = k
    while node > 1:
        nxt = []
        for i in range(0, node, 2):
            w, lo = play(players[i], players[i + 1])
            loser[(node + i) // 2] = lo
            nxt.append(w)
        players, node = nxt, node // 2
    w = players[0]
    while head[w] is not None:
        yield w, at[w], shared[w]
        at[w] += 1
        keys, prefixes = runs[w]
        if at[w] < len(keys):
            head[w], shared[w] = keys[at[w]], prefixes[at[w]]
        else:
            head[w] = None
        i = (k + w) // 2
        while i:
            w, loser[i] = play(w, loser[i])
            i //= 2


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, c: int) -> np.ndarray:
    """Whether rows a and b have the same window from column c on."""
    return (text[a, c : c + MATCH] == text[b, c : c + MATCH]).all(axis=1)


def covered(rows: np.ndarray, group: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """(doc, start, end) of covered stretches. ``group``: the number of the gram's group, for rows of suffix, length, before, length."""
    by = np.lexsort((pos, doc))
    rows, group, doc, pos = rows[by], group[by], doc[by], pos[by]
    after, before = rows[:, MATCH].astype(np.int64), rows[:, -1].astype(np.int64) - 1
    text = np.concatenate([rows[:, MATCH + 1 : -1], rows[:, :MATCH]], axis=1)
    sums = np.zeros((len(rows), text.shape[1] + 1), np.uint64)
    base = np.uint64(_BASE)
    for c in range(text.shape[1]):
        sums[:, c + 1] = sums[:, c] * base + _BYTE[text[:, c]]
    first, last = np.full(len(rows), BEFORE + 1), np.full(len(rows), -1)  # offsets of windows in front of the gram
    salt = group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for o in range(BEFORE + 1):
        fits = np.flatnonzero((before >= o) & (after >= MATCH - o))
        if len(fits) < 2:
            continue
        c = BEFORE - o
        window = sums[fits, c + MATCH] - sums[fits, c] * _power(MATCH)
        window ^= window >> np.uint64(31)
        _, at, where = np.unique(window * np.uint64(0xBF58476D1CE4E5B9) + salt[fits], return_index=True, return_inverse=True)
        origin = fits[at[where]]  # the earliest, as rows stand in order
        again = origin != fits
        if not (same_bytes(text, fits[again], origin[again], c) & (group[fits[again]] == group[origin[again]])).all():
            whole = np.concatenate([text[fits, c : c + MATCH], group[fits].astype("<i8")[:, None].view(np.uint8)], axis=1)
            _, at, where = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
            again = fits[at[where]] != fits
        hit = fits[again]
        first[hit] = np.minimum(first[hit], o)
        last[hit] = np.maximum(last[hit], o)
    hit = last >= 0
    return doc[hit], (pos - last)[hit], (pos - first + MATCH)[hit]


def merge_bucket(blobs: list[bytes]):
    """(doc, start, end) of the stretches that a bucket's runs cover."""
    runs = [unpack_run(b) for b in blobs]
    order, prefixes = [], []
    offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
    for r, i, shared in merge_runs([(r[0], r[1]) for r in runs]):
        order.append(offsets[r] + i)
        prefixes.append(shared)
    order = np.array(order, np.int64)
    group = np.cumsum(np.array(prefixes) < GRAM)
    many = np.bincount(group)[group] > 1
    order, group = order[many], group[many]
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    keys = np.frombuffer(b"".join(k for r in runs for k in r[0]), np.uint8).reshape(-1, MATCH + 1)[order]
    before = np.concatenate([r[2] for r in runs])[order]
    doc, pos = np.concatenate([r[3] for r in runs])[order], np.concatenate([r[4] for r in runs])[order]
    return covered(np.concatenate([keys, before], axis=1), group, doc, pos)


def _merge(doc_buckets: int):
    def run(batches):
        for found in _by_key(batches, lambda blobs: by_doc_bucket(*_cover_rows(*merge_bucket(blobs)), doc_buckets)):
            yield _blob_rows(*found)

    return run


# 4. Back to the documents


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of covered bytes, from (start, end) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([new[1:], [True]])]], axis=1)


def without(data: bytes, spans) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def whole_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The stretch with all of the characters that it cuts in two."""
    while a > 0 and data[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(data) and data[b] & 0xC0 == 0x80:
        b += 1
    return a, b


def _finish(batches):
    for batch in batches:
        out = {"n_bytes": [], "n_removed": [], "spans": [], "kept": [], "text": []}
        for text, payload in zip(batch.column("text"), batch.column("payload"), strict=True):
            data = (text.as_py() or "").encode("utf-8", "replace")
            spans = union(np.frombuffer(payload.as_py() or b"", "<i8").reshape(-1, 2))
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int((spans[:, 1] - spans[:, 0]).sum()))
            out["spans"].append([{"start": a, "end": b} for a, b in spans.tolist()])
            if "carried" in batch.schema.names:
                wide = union(np.array([whole_characters(data, a, b) for a, b in spans.tolist()], np.int64).reshape(-1, 2))
                out["text"].append(without(data, wide.tolist()).decode() if text.is_valid else None)
                out["kept"].append(None)
            else:
                out["kept"].append(without(data, spans.tolist()))
        carried = {"text": pa.array(out["text"], pa.string()), "carried": batch.column("carried")} if "carried" in batch.schema.names else {"kept": pa.array(out["kept"], pa.binary())}
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *carried.values()],
            ["id", "n_bytes", "n_removed", "spans", *carried],
        )


def _numbered(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None, int]:
    """(id, text, carried if any) with ids that are unique and stand in order; the ids' rows if they had to be made; bytes of all texts."""
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.struct(*keep).alias("carried")] * bool(keep))
    per_id = found.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    total = per_id.agg(F.max("n").alias("n"), F.sum("size").alias("size"), F.count(F.when(F.col("id").isNull(), 1)).alias("null")).first()
    if (total["n"] or 0) <= 1 and not total["null"]:
        return found, None, total["size"] or 0
    made = checkpoint(found.orderBy(*found.columns).withColumn("own", F.monotonically_increasing_id()))
    return made.select(F.col("own").alias("id"), *found.columns[1:]), made.select("own", F.col("id").alias("given")), total["size"] or 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_bytes, n_removed, spans (array of start, end) and kept, the remaining bytes: one row per input row.

    With columns named in ``keep``, these instead of ``kept``, and text: what remains as text, in which a character that is cut goes whole; null texts stay null.
    """
    spark = docs.sparkSession
    rows, given, total = _numbered(docs, id_col, text_col, keep)
    buckets, doc_buckets, parts = max(16, total >> 21), max(16, total >> 23), wanted_partitions(spark, total)
    asked_for, packed, dealt = "key long, kind int, blob binary", "key long, blob binary", "at long, payload binary"
    met = lambda df: df.repartition(parts, "key").sortWithinPartitions("key")
    asked = rows.select("id", "text").mapInArrow(_ask(buckets, doc_buckets), asked_for)
    found = checkpoint(met(asked).mapInArrow(_answer(doc_buckets, max(HOT, total >> 26)), packed))
    hot = [r["key"] for r in found.where(F.octet_length("blob") == 0).select("key").collect()]
    shared = spark.sparkContext.broadcast(np.array(hot, np.int64).view(np.uint64)) if hot else None
    answers = met(found.where(F.octet_length("blob") > 0)).mapInArrow(_deal, dealt)
    # Both joins keep every document with all its columns, so that they share one exchange of the texts.
    runs = rows.join(answers, F.col("id") == F.col("at"), "left").select(*rows.columns, "payload").mapInArrow(_runs(buckets, doc_buckets, shared), asked_for)
    covers = met(runs).mapInArrow(_merge(doc_buckets), packed)
    if shared is not None:
        covers = covers.unionByName(covered_by_window(rows, shared, doc_buckets))
    out = rows.join(met(covers).mapInArrow(_deal, dealt), F.col("id") == F.col("at"), "left").select(*rows.columns, "payload")
    rest = f"text string, carried {rows.schema['carried'].dataType.simpleString()}" if keep else "kept binary"
    out = out.mapInArrow(_finish, f"id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, {rest}")
    if given is not None:
        out = out.join(given, F.col("id") == F.col("own")).withColumn("id", F.col("given")).drop("own", "given")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "spans", *(["text", "carried.*"] if keep else ["kept"]))
