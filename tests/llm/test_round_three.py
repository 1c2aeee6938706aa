"""License scans, hard negatives and alignment against plain forms: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import os
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from opinara.llm import align, lang_id, licenses, negatives, quality, url_filters
from opinara.llm.queries import QUERIES, URL_RULES

DOCS = "doc_id long, text string, id long, digest string, words string, label string, number long, shard long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "d", "w", "l", 1, 2) for i, t in rows], DOCS)


# 1, 2, 6, 9


def test_hosts_of_very_many_labels(spark):
    rules = spark.createDataFrame([*URL_RULES, ("d.e.f.com", "/", "block"), ("a.com", "/x", "block"), ("com", "/x", "allow")], "host string, path string, verdict string")
    urls = ["http://" + "s." * 16_000 + "d.e.f.com/", "http://e.f.com/", "http://com/x", "http://a.com/x", "http://a.com./x", "http://.com/", None, None, "no", "http:///x"]
    began = time.time()
    got = [(r["rule"], r["verdict"]) for r in url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()]
    assert time.time() - began < 30
    assert got == [("d.e.f.com/", "block"), ("com/", "allow"), ("com/x", "allow"), ("a.com/x", "block"), (None, "allow"), ("com/", "allow"), *[(None, "allow")] * 4]


def test_signs_are_no_letters():
    assert lang_id.letters("½ ² ① Ⅷ 12 _ ६") == "" and lang_id.letters("Straße 3² 日本 x½y") == "straße 日本 x y"


def test_training_rows_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda buckets, grades, n: seen.append(len(grades)))
    rows = docs(spark, [(i % 3, f"text {i}") for i in range(50)])
    ratings = spark.createDataFrame([(i, i) for i in range(3)], "doc_id long, grade int")
    for bound in (7, 100):
        quality.train(rows, ratings, max_rows=bound)
    assert seen == [7, 50]


def test_token_counts_leave_no_cache(spark):
    from opinara.llm import common

    before = set(os.listdir(common.checkpoint_dir(spark).removeprefix("file:")))
    got = QUERIES["op6_token_counts"](spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and not any(n.startswith("token-counts") for n in set(os.listdir(common.checkpoint_dir(spark).removeprefix("file:"))) - before)


# 11


def plain_matches(text, templates):
    """Every block against every template, by sets."""
    words = licenses.words_of(text or "")
    out = set()
    for k, t in enumerate(templates):
        w = t["width"]
        for s in range(0, max(0, len(words) - w - 1) + 1, w):
            n = len(set(words[s : s + 2 * w]) & set(t["words"]))
            if n >= t["need"]:
                out.add((s, w, k, n / len(t["words"])))
    return out


def test_license_join_equals_plain_form(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["license", "under", "the", "mit"]
    templates = licenses.templates_table([("a", " ".join(rng.sample(vocab, 6))), ("b", " ".join(rng.choices(vocab, k=30))), ("c", " ".join(rng.choices(vocab, k=90))), ("same", "the mit license"), ("same", "the mit license"), ("none", "--- !")], 0.75)
    assert [t["label"] for t in templates] == ["a", "b", "c", "same", "same"] and [t["width"] for t in templates] == [16, 64, 256, 16, 16]
    texts = [" ".join(rng.choices(vocab, k=n)) for n in (0, 1, 5, 16, 17, 33, 34, 64, 65, 129, 300, 700, 2000)] + [None, "", "--", "The MIT\nLICENSE", "The MIT\nLICENSE", "x" * 100_000 + " the mit license"]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    got = collections.Counter((r["id"], bytes(r["digest"]), r["start"], r["width"], r["template"], r["score"]) for r in licenses.matches(docs(spark, rows), templates).collect())
    want = collections.Counter((i, hashlib.sha256((t or "").encode()).digest(), *m) for i, t in rows for m in plain_matches(t, templates))
    assert got == want and len(want) > 50


def test_license_scan(spark):
    texts = ["This work is licensed under the GNU General\nPublic License, version 3.", "mit license MIT-License cc by", "Cc BY-NC", None, "", "été mitlicense", "mit license", "a " * 5000 + licenses.TEMPLATES[10][1], "released under BSD license"]
    got = [tuple(r)[1:] for r in licenses.scan(docs(spark, [(i, t) for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert got[0] == (12, 1, 6, 6, "gpl", "gpl", 1.0)
    assert got[1] == (6, 3, 0, 4, "cc-by,mit", "cc-by,mit", 1.0) and got[2] == (3, 1, 0, 0, "cc-by", "cc-by", 1.0)
    assert got[3] == got[4] == (0, 0, None, None, "", "", 0.0) and got[5][:2] == (2, 0) and got[6][:4] == (2, 1, 0, 0)
    assert got[7][1] == 0 and got[7][4:] == ("", "mit", 1.0) and got[8][4:] == ("", "", 0.0)
    # Rows of one id keep what is theirs; equal rows each have a row.
    same = [tuple(r) for r in licenses.scan(docs(spark, [(None, "mit license"), (None, "x"), (1, "mit license"), (1, "mit license"), (1, None)])).collect()]
    assert sorted(r[0] is None and r[2] for r in same) == [False, False, False, 0, 1] and sorted(r[2] for r in same if r[0] == 1) == [0, 1, 1]
    assert licenses.scan(docs(spark, [])).count() == 0
    assert {r["labels"] for r in licenses.scan(docs(spark, [(1, "mit license"), (2, "x")]), templates=[]).collect()} == {"mit", ""}
    plan = licenses.scan(docs(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 12


def plain_negatives(rows, k=5):
    rows = [(i, row, label, [math.floor(256 * float(np.float32(x))) for x in v]) for row, (i, label, v) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in rows:
        if a[0] is None or a[0] % 10:
            continue
        by = sorted(((-sum(x * y for x, y in zip(a[3], b[3])), math.inf if b[0] is None else b[0], b[1], b[2] == a[2]) for b in rows if b[1] != a[1]), key=lambda s: s[:3])
        for p in [b for b in by if b[3]][:k]:
            fit = [b for b in by if not b[3] and 80 * -p[0] <= 100 * -b[0] <= 100 * -p[0]][:k]
            out += [(a[0], None if p[1] == math.inf else p[1], n, None if b[1] == math.inf else b[1], -p[0], -b[0]) for n, b in enumerate(fit, 1)]
    return out


@pytest.mark.parametrize("scores,block", [(1 << 20, 8 << 20), (7, 100)])
def test_hard_negatives_equal_plain_form(spark, monkeypatch, scores, block):
    monkeypatch.setattr(negatives, "SCORES", scores)
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", block)
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), [rng.choice([0.1, 0.3, 0.5, -0.2]) for _ in range(3)]) for i in range(120)]
    rows += [(i, 1, [0.5, 0.5, 0.5]) for i in range(120, 160)] + [(i, 2, [0.5, 0.5, 0.5]) for i in range(160, 200)]  # ties
    rows += [(200, None, [1.0, 1.0, 1.0]), (210, 1, None), (220, 1, [1.0, None, 1.0]), (230, 1, [1.0, float("nan"), 1.0]), (240, 2, [float("inf"), 0.0, 0.0]), (None, 0, [0.4, 0.4, 0.4]), (250, 0, []), (260, 0, [0.3]), (260, 0, [0.3]), (270, 9, [0.5, 0.1, 0.1]), (280, 0, [0.5, 0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(i, l, v, 1, "s") for i, l, v in rows], "vec_id long, label int, embedding array<float>, row int, score string")
    got = [tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_negatives(rows))) and len(got) > 100
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_are_exact_beyond_doubles():
    a, b = negatives.whole(np.array([[2.0**50, 3.0], [1.0, 1.0]])), negatives.whole(np.array([[1 / 64, 1 / 256], [2.0**48, -1 / 256]]))
    assert negatives.scores(a, b).tolist() == [[2**60 + 768, (1 << 63) - 1], [256 * 4 + 256, (1 << 63) - 1]]
    assert negatives.scores(-a, b)[0].tolist() == [-(2**60) - 768, -(1 << 63) + 1]
    assert negatives.whole(np.array([[1e308, -1e-300]])).tolist() == [[int(1e308) * 256, -1]]
    assert list(negatives.vectors(__import__("pyarrow").array([[1.0], [], [2.0, 3.0]])).tolist()) == [[1.0, 0.0], [0.0, 0.0], [2.0, 3.0]]


# 13


def plain_alignment(rows):
    """Token by token, with the tokenizers library on both sides."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib, byte = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), align.byte_of_character()
    docs, held = [], collections.Counter()
    for i, text in rows:
        groups, a, b = [], [], []
        if text:
            e = a_lib.encode(" " + text, add_special_tokens=False)
            a, ends_a = e.ids, np.cumsum([len(t) for t in e.tokens]).tolist()
            b = b_lib.encode(text)
            parts = [align.Pieces._bytes(b_lib.id_to_piece(k)) for k in b]
            if bytes(byte[c] for t in e.tokens for c in t) != (" " + text).encode() or b"".join(parts) != (" " + text).encode():
                a, b, ends_a, parts = [], [], [], []
            ends_b = np.cumsum([len(p) for p in parts]).tolist()
            last = 0
            for cut in sorted(set(ends_a) & set(ends_b)):
                groups.append(([k for k, x in zip(a, ends_a) if last < x <= cut], [k for k, x in zip(b, ends_b) if last < x <= cut]))
                last = cut
        links = [(x, y) for g, h in groups for x in g for y in h]
        held.update(set(links))
        docs.append((i, a, b, groups, links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    said = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return [(i, len(a), len(b), len(g), len(l), sum(held[x] == best[x[0]] for x in l), sum(held[x] for x in l), hashlib.sha256(said(g).encode()).hexdigest() if g else "") for i, a, b, g, l in docs]


@pytest.mark.parametrize("shard,pairs", [(1 << 20, 1 << 21), (100, 3)])
def test_alignment_equals_plain_form(spark, monkeypatch, shard, pairs):
    monkeypatch.setattr(align, "SHARD", shard)
    monkeypatch.setattr(align, "PAIRS", pairs)
    rng = random.Random(3)
    words = ["token", "alignment", "straße", "naïve", "日本語", "🙂🙃", "  ", "\n\n", "<|endoftext|>", "<s>", "don't", "123456", "​", "ﬁ", "▁", "á"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 25))) for _ in range(20)] + [None, "", " ", "x", "x", "y" * 3000, "é" * 400]
    rows = [(i if i % 6 else None, t) for i, t in enumerate(texts)]
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    frame = align.align(spark, docs(spark, rows), a, b)
    got = [tuple(r) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_alignment(rows)))
    assert align.align(spark, docs(spark, []), a, b).count() == 0


def test_fast_side_equals_library():
    side = align.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"))
    assert side.fast is not None
    texts = ["".join(f" a{chr(c)}b 1{chr(c)}2 {chr(c)}'{chr(c)}\n" for c in range(s, s + 40) if not 0xD800 <= c < 0xE000) for s in (*range(0, 0x3000, 40), *range(0x1F300, 0x1F600, 40))] + ["\t" * 20_000 + "x", " " * 300, "don't we'll I'd"]
    assert side.encode(texts) == [e.ids for e in side.library.encode_batch(texts, add_special_tokens=False)]


def test_groups_and_overlaps():
    a, b, overlaps = align.groups_of(np.array([1, 2, 3]), np.array([3, 1, 2]))
    assert a.tolist() == [0, 0, 1] and b.tolist() == [0, 1, 1] and overlaps.tolist() == [0, 0, 1, 1]
    x, y = np.array([5, -1, 1 << 40]), np.zeros(0, np.int64)
    assert [v.tolist() for v in align.unpack(align.pack(x, y))] == [x.tolist(), []]
