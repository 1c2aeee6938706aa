"""Small cases of the numbered operators: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import common, components, decontam, embed_dedup, html_main, lang_id, lsh_forest, pieces, quality, suffix_dedup, token_counts, url_filters
from opinara.llm.queries import ORACLES, QUERIES, URL_RULES, piece_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, rep string"


def docs(spark, texts, lang=None):
    rows = [(i, t, (lang[i] if lang else "en"), "s", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# 1


def test_url_rules(spark):
    urls = ["http://example.com/en/1", "https://WWW.Example.com/en/x?q", "http://a.net/es/1", "http://net/fr/", "http://a.org/en/", None, "no scheme", "http://x.example.com/de/", "http://badexample.com/en/", "http://example.com?/en/", "http://example.com/en/1"]
    pages = spark.createDataFrame([(i, u, "rule", "h") for i, u in enumerate(urls)], "page_id long, url string, rule string, h string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages, rules).collect()}
    assert got[0] == ("example.com", "/en/1", "example.com/en/", "block") == got[10]
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3][2:] == ("net/fr/", "block")
    assert got[4][2:] == (None, "allow") and got[5] == ("", "", None, "allow") == got[6]
    assert got[7][2:] == ("com/", "allow") and got[8][2:] == ("com/", "allow") and got[9] == ("example.com", "", None, "allow")
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filters.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    # Ties: of rules of one length the longer host wins, then block; repeated rules count once. Long URLs are read whole.
    even = spark.createDataFrame([("a.com", "/x", "allow"), ("com", "/xyz", "block"), ("b.com", "/", "allow"), ("b.com", "/", "block"), ("b.com", "/", "block"), ("c.com", "/" + "p" * 5000, "block")], "host string, path string, verdict string")
    urls = ["http://a.com/xyz", "http://b.com/", "http://b.com/", "http://c.com/" + "p" * 5000 + "q", "http://c.com/" + "p" * 4999, "http://" + "s." * 3000 + "b.com/", None]
    tied = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge_urls(tied, even).collect()}
    assert found[0] == ("a.com/x", "allow") and found[1] == found[2] == found[5] == ("b.com/", "block") and found[3][1] == "block" and found[4] == found[6] == (None, "allow") and len(found) == 7


# 2


def test_ordinal_model_orders_grades(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(30)) for _ in range(300)]
    texts = [t + (" JUNK!! JUNK!!" if i % 3 == 0 else " vile" if i % 3 == 1 else "") for i, t in enumerate(base)] + [None, ""]
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, 1 if i % 3 == 1 else 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs(spark, texts), quality.graded(labels))
    assert model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in quality.grade(docs(spark, texts), model).collect()}
    means = [np.mean([got[i]["expected_grade"] for i in range(300) if i % 3 == k]) for k in range(3)]
    assert means[0] < means[1] < means[2] and len(got) == 302
    assert sum(got[i]["kept"] == (i % 3 == 2) for i in range(300)) > 290
    assert got[300]["tail_probability"] == got[301]["tail_probability"]
    empty = quality.train(docs(spark, ["a"]), quality.graded(labels.limit(0)))
    assert [r["kept"] for r in quality.grade(docs(spark, ["a", None, "a", ""]), empty).collect()] == [True] * 4
    one = quality.train(docs(spark, texts), quality.graded(labels.where("doc_id % 3 = 0")))
    assert quality.grade(docs(spark, texts), one).where("not kept").count() == 0
    assert quality.grade(docs(spark, []), model).count() == 0
    long = quality.grade(docs(spark, ["alpha beta " * 200_000, "q" * 3_000_000, "alpha beta " * 20, "alpha beta " * 20]), model).collect()
    assert len(long) == 4 and long[0]["tail_probability"] == long[2]["tail_probability"] == long[3]["tail_probability"]


def test_ordinal_fit_is_a_minimum_of_the_plain_loss():
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(400)]
    true = np.array([1.5, -1.5, 1.0, -1.0, 0.8, -0.8, 2.0, -2.0, 0, 0, 0, 0])
    z = np.array([true[r].sum() for r in rows])
    grades = (z + rng.logistic(size=400) > -1).astype(int) + (z + rng.logistic(size=400) > 1)
    model = quality.fit(rows, grades, 3, telling=0, least_shift=0, steps=3000, rate=0.05)
    used = np.flatnonzero(model.weights[:12])

    def loss(w, theta):
        z = np.array([sum(w[b] for b in r) for r in rows])
        below = lambda t: 1 / (1 + np.exp(-(t - z)))
        p = np.where(grades == 0, below(theta[0]), np.where(grades == 1, below(theta[1]) - below(theta[0]), 1 - below(theta[1])))
        return -np.log(p).mean() + 0.5e-4 * sum(x * x for x in w)

    w, theta = model.weights[:12].astype(float), model.thresholds
    least = loss(w, theta)
    for k in used:
        for step in (-0.03, 0.03):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, theta) > least - 1e-5
    for step in (-0.03, 0.03):
        assert loss(w, theta + np.array([step, 0])) > least - 1e-5 and loss(w, theta + np.array([0, step])) > least - 1e-5


def test_grades_of_held_out_documents(spark):
    """Trained on one half of the labels, the classifier sorts the other."""
    sf = "/root/testdata/sf0.1"
    rows, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2))
    model = quality.train(rows, quality.graded(labels.where(half == 0)))
    got = quality.grade(rows, model).join(quality.graded(labels.where(half == 1)), "doc_id").groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["grade"]: r["kept"] for r in got}
    assert kept[2] > 0.9 and kept[1] < 0.1 and kept[0] < 0.1, kept


# 3


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 16))
    x = np.repeat(base, 20, axis=0) + rng.standard_normal((240, 16)) * rng.choice([0.02, 0.12, 0.2], size=(240, 1))
    x[5], x[17] = x[3], x[3]
    rows = [(int(i), v.astype(np.float32).tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, x[3].tolist(), None), (904, [None] + [1.0] * 15, 0), (905, [], 0), (906, [1.0] * 4, 0)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, component string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.link_vectors(frame).collect()}
    y = np.array([r[1] for r in rows[:240]], float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    label = np.arange(240) % 2
    near = (y @ y.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(240)
    while True:
        new = np.array([min([root[i], *root[near[i]]]) for i in range(240)])
        if (new == root).all():
            break
        root = new
    assert near.sum() > 200
    for i in range(240):
        assert got[i] == (near[i].sum(), root[i], root[i] == i)
    for i in range(900, 907):
        assert got[i] == (0, i, True)
    tall = [(i, (np.array(r[1], float) * f).tolist(), r[2]) for i, (r, f) in enumerate(zip(rows[:240], [1e300, 1e-300, 1e154, 1e-200, 1.0] * 48))] + [(240, [5e-324] * 16, 0), (241, [1e308] * 16, 0)]
    huge = spark.createDataFrame(tall, "vec_id long, embedding array<double>, label int")
    scaled = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.link_vectors(huge).collect()}
    assert all(scaled[i] == got[i][:2] for i in range(240)) and scaled[240] == (1, 240) == scaled[241]
    twice = spark.createDataFrame([(1, x[0].tolist(), 0), (1, x[0].tolist(), 0), (1, x[40].tolist(), 0), (None, x[0].tolist(), 0), (None, None, None)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in embed_dedup.link_vectors(twice).where("vec_id is not null").collect()) == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True)]
    assert [tuple(r) for r in embed_dedup.link_vectors(twice).where("vec_id is null").collect()] == [(None, 0, None, True)] * 2
    assert embed_dedup.link_vectors(frame.limit(0)).count() == 0


def test_blocks_of_large_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(24) + 0.11 * rng.standard_normal((90, 24))
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    whole = sorted(tuple(r) for r in embed_dedup.link_vectors(frame).collect())
    y = x / np.linalg.norm(x, axis=1)[:, None]
    assert [r[1] for r in whole] == ((y @ y.T >= 0.98).sum(axis=1) - 1).tolist() and sum(r[1] for r in whole) > 100
    monkeypatch.setattr(embed_dedup, "BLOCK", 4)
    assert sorted(tuple(r) for r in embed_dedup.link_vectors(frame).collect()) == whole


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(5, 5), (30, 7), (30, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(101, 141)} == {100} and {got[i] for i in range(8, 31)} == {7} and 5 not in got
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 4


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(piece_model())


def best_score(v, data: bytes):
    keys = {v.pieces[i].encode(): v.scores[i] for i in range(len(v.pieces)) if v.pieces[i] and i > 258}
    best = [0.0] + [-np.inf] * len(data)
    for j in range(1, len(data) + 1):
        for i in range(max(0, j - 48), j):
            if data[i:j] in keys and best[i] > -np.inf:
                best[j] = max(best[j], best[i] + keys[data[i:j]])
    return best[-1]


def test_viterbi_is_the_best_path_and_decodes(vocabulary):
    v = vocabulary
    texts = ["Hello world", "the thereof", "a  b   c", " lead", "tail ", "Zürich déjà vu", "x" * 70, "日本語 text", "line\nbreak\n\nend", "emoji 🙂🙂", "\x00\t", "", "word " * 400]
    for t in texts:
        ids = np.frombuffer(v.encode([t])[0], "<i4").tolist()
        assert v.decode(ids) == t
        for stretch in pieces.STRETCH.findall("▁" + t.replace(" ", "▁")) if t else []:
            assert pieces._packed(v._best_one(stretch.encode())) == v._best_many([stretch.encode()])[0] == v._best_many([b"zz", stretch.encode(), "é☃".encode()])[1]
            if stretch.isascii() or "ü" in stretch or "é" in stretch or stretch.strip("▁").isalpha():
                total = sum(v.scores[i] for i in v._best_one(stretch.encode()))
                if "\n" not in stretch and not any(v.bytes_at <= i < v.bytes_at + 256 for i in v._best_one(stretch.encode())):
                    assert total == best_score(v, stretch.encode())
    assert [v.pieces[i] for i in np.frombuffer(v.encode(["\n"])[0], "<i4")] == ["▁", "<0x0A>"]


def test_encode_and_decode_frames(spark, vocabulary):
    texts = ["one two", None, "", "one two", "ünïcode ☃", "long " * 5000]
    out = pieces.encode(docs(spark, texts), vocabulary)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(out, vocabulary).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    trips = {r["doc_id"]: r for r in pieces.round_trips(docs(spark, texts), vocabulary).collect()}
    clash = pieces.round_trips(docs(spark, texts).withColumn("n_tokens", F.lit("mine")).withColumn("_text", F.lit("x")), vocabulary).collect()
    assert sorted(map(tuple, clash)) == sorted(tuple(r) for r in trips.values())
    assert all(r["round_trip"] for r in trips.values()) and trips[1]["n_tokens"] == 0 and trips[0]["tokens_sha256"] == trips[3]["tokens_sha256"]
    assert pieces.encode(docs(spark, []), vocabulary).count() == 0


# 5


def brute_groups(texts, percent=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(n)] for n in (60, 80, 120, 300, 7)]
    texts = [None, "", "  \n", "One two", "one TWO", "a b c d", "ÀB c d e f", "àb c d e f", "x y z " * 3000, "x y z " * 100_000 + "end"]
    for b in base:
        for edits in [0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 6] * 3:
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in lsh_forest.link_documents(docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute_groups(texts)))
    assert lsh_forest.link_documents(docs(spark, [])).count() == 0


def test_forest_parts_dense_regions_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "ROUNDS", 0)
    rng = random.Random(6)
    texts = []
    for _ in range(2):
        b = [f"w{rng.randrange(10_000)}" for _ in range(100)]
        for _ in range(30):
            c = list(b)
            for _ in range(rng.randint(0, 5)):
                c[rng.randrange(100)] = "z"
            texts.append(" ".join(c))
    groups = lambda: {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in lsh_forest.link_documents(docs(spark, texts)).collect()}
    want = dict(enumerate(brute_groups(texts)))
    assert groups() == want
    monkeypatch.setattr(lsh_forest, "BLOCK", 4)
    seen = []
    real = lsh_forest.leaves
    monkeypatch.setattr(lsh_forest, "leaves", lambda rows: (seen.append(real(rows)), seen[-1])[1])
    assert groups() == want
    sizes = [r["count"] for r in seen[0].groupBy("leaf").count().collect()]
    assert seen[0].where("parted").count() > 0 and len(set(sizes)) > 2
    # Without the forest's leaves nothing is found.
    monkeypatch.setattr(lsh_forest, "leaves", lambda rows: real(rows).limit(0))
    assert groups() != want


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(7, a, 1), (7, b, 2), (3, b + " c", 3), (None, a, 4), (None, "one two three four five six", 5), (None, None, 6), (9, "", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_shingles long")
    got = sorted((tuple(r) for r in lsh_forest.link_documents(frame).collect()), key=str)
    assert got == sorted([(7, 36, 7, True), (7, 36, 3, False), (3, 37, 3, True), (None, 36, 7, False), (None, 2, None, True), (None, 0, None, True), (9, 0, 9, True)], key=str)


# 6


def test_token_counts_equal_the_library_and_fill_the_cache(spark, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = ["Hello  world", None, "", "<s> x </s>", "Hello  world", " ünï ☃ " * 50, "a" * 500]
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = {r["doc_id"]: r for r in token_counts.count_tokens(spark, docs(spark, texts), piece_model(), cache, limit=40).collect()}
        for i, t in enumerate(texts):
            assert got[i]["n_tokens"] == len(sp.encode(t or "")) and got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (got[i]["n_tokens"] > 40)
    assert spark.read.parquet(cache).count() == 5  # one row for each distinct text, encoded once
    more = token_counts.count_tokens(spark, docs(spark, ["new", "Hello  world"]), piece_model(), cache)
    assert more.count() == 2 and spark.read.parquet(cache).count() == 6
    long = " ".join(random.Random(1).choice(["ab", "cde", "x  y", "ü"]) for _ in range(3000))
    assert sum(len(sp.encode(p)) for p in token_counts.parts(long, 500)) == len(sp.encode(long)) and len(token_counts.parts(long, 500)) > 5
    assert token_counts.count_tokens(spark, docs(spark, []), piece_model()).count() == 0


# 7


def test_html_extraction():
    model = html_main.default_model()
    page = """<html><head><title>T</title><script>var a='<p>';</script></head><body><header><p>Site name</p></header><nav><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this site to serve you better.</p></div>
    <article><h1>A &amp; B</h1><p>First   <b>line</b> of
    the text&nbsp;here, long enough to be read as prose by anyone.<p>Second &lt;line&gt; with a <a href=z>link</a> inside and words.<script>x</script></article>
    <aside class=sidebar><h3>More</h3><ul><li><a href=1>one</a></li></ul></aside><div id="comments"><div class=comment><p>I think this is wrong, said a reader.</p></div></div>
    <form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2020</footer></body></html>"""
    assert model.extract(page) == "A & B\nFirst line of the text here, long enough to be read as prose by anyone.\nSecond <line> with a link inside and words."
    assert model.extract(None) == model.extract("") == ""
    model.extract("<p" * 50 + "<!-- " + "</div>" * 20 + "<script>")
    held = html_main.labelled_pages(40, seed=99)
    wrong = total = 0
    for source in held:
        parsed = html_main.Page(source)
        for m, want, n in zip(model.marginals(parsed), parsed.labels(), parsed.chars):
            total += n > 0
            wrong += n > 0 and (m >= 0.5) != want
    assert wrong < 0.02 * total


def enumerated(model, page):
    """Marginals by summing over all labellings."""
    import itertools
    import math

    n = len(page.tags)
    own = [model._own(page.tags[i], page.attributes[i]) + sum(model.weights.get(f, 0.0) for f in html_main.shape_features(page, i)) for i in range(n)]
    total, on = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(own[i] * y[i] for i in range(n)) + sum(model.pairs[html_main.pair_feature(page, i)][y[page.parents[i]]][y[i]] for i in range(1, n)))
        total += w
        for i in range(n):
            on[i] += w * y[i]
    return [x / total for x in on]


def test_marginals_and_texts_equal_enumeration():
    model = html_main.default_model()
    rng = random.Random(3)
    pages = ["<body><div class=nav><a>x</a></div><article><p>some words in a row here</p><p>b</p></article></body>"]
    for _ in range(12):
        part = lambda: rng.choice(["<nav><a href=x>link</a></nav>", "<div class=ad>buy this now</div>", "<p>words of prose that go on for a while, as they do</p>", "<h2>Head</h2>", "<footer>end</footer>", "<article><p>short one</p></article>", "plain"])
        pages.append("<body>" + "".join(part() for _ in range(rng.randint(1, 6))) + "</body>")
    for source in pages:
        page = html_main.Page(source)
        plain = enumerated(model, page)
        assert np.allclose(plain, model.marginals(page))
        assert model.extract(source) == page.text([m >= 0.5 for m in plain])


def test_names_never_seen_in_training():
    """Trained on half of the names, the model tells the blocks of pages that use the other half."""
    model = html_main.train(html_main.labelled_pages(120, 7, lambda names: names[::2]))
    wrong = total = 0
    for source in html_main.labelled_pages(60, 99, lambda names: names[1::2]):
        page = html_main.Page(source)
        for m, want, n in zip(model.marginals(page), page.labels(), page.chars):
            total += n > 0
            wrong += n > 0 and (m >= 0.5) != want
    assert wrong < 0.03 * total


def test_deep_and_long_pages_take_linear_time():
    import time

    model = html_main.default_model()
    began = time.time()
    for inner in ("<div>", "<p>", "<li>", "<a>", "<td>", "<dt><div>"):
        model.extract(inner * 20_000 + "words" + "</b></ul>" * 20_000)
    model.extract("<p>word " * 100_000)
    assert time.time() - began < 60


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "<article><p>Words that make up a small article, all of them read.</p></article>", "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_main.extract(pages).collect()}
    assert got[1]["text"] == "" and got[1]["n_chars"] == 0 and got[2]["n_chars"] == len(got[2]["text"]) > 20
    assert html_main.extract(pages.limit(0)).count() == 0
    twice = html_main.extract(pages.unionByName(pages).withColumn("_html", F.lit("clash")).withColumn("n_chars", F.lit(1)), keep=("page_id",)).collect()
    assert sorted((r["page_id"], r["text"]) for r in twice) == sorted((i, got[i]["text"]) for i in (1, 1, 2, 2))
    learned = html_main.learn(spark.createDataFrame([(t,) for t in html_main.labelled_pages()] + [(None,)], "html string"))
    assert learned.extract(pages.collect()[1]["html"]) == got[2]["text"]
    assert html_main.learn(pages.limit(0)).extract("<p>a</p><script>b</script>") == "a"


# 8


def test_block_max_wand_retrieves_all_above_the_threshold():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(200)]
    index = decontam.Index(items, retrieve=0.3)
    for _ in range(100):
        terms = [index.numbers[w] for w in rng.sample(words, rng.randint(1, 40)) if w in index.numbers]
        score = {}
        for t in set(terms):
            for s, w in zip(index.postings[t].segments, index.postings[t].weights):
                score[s] = score.get(s, 0) + w
        assert sorted(s for s, _ in index.search(terms)) == sorted(s for s, x in score.items() if x >= 0.3 - 1e-9)


def test_leaks(spark):
    rng = random.Random(9)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    questions = [f"{make(20)}. {make(8)}." for _ in range(30)] + [make(150), "short one"]
    items = spark.createDataFrame([*enumerate(questions), (98, None), (99, "")], "item_id long, text string")
    texts = [None, "", make(500), f"{make(300)} {questions[3]} {make(200)}", questions[5].upper(), questions[30], f"{make(90)}\n{questions[7]}\n{questions[8]}", questions[3].split(".")[0][:40], make(20) + " " + questions[3].replace(" ", "  ")]
    got = {r["doc_id"]: (r["items"], r["contaminated"]) for r in decontam.find_leaks(docs(spark, texts), items).collect()}
    assert [got[i][0] for i in range(9)] == [[], [], [], [3], [5], [30], [7, 8], [], [3]]
    assert all(c == bool(i) for i, c in got.values())
    assert {r["contaminated"] for r in decontam.find_leaks(docs(spark, texts), items.limit(0)).collect()} == {False}
    assert decontam.find_leaks(docs(spark, []), items).count() == 0


def brute_leaks(texts, items, retrieve=0.5, question=0.6, answer=0.6):
    """Every passage against every segment of every item, by the plain BM25 formula."""
    import math

    whole = [(i, t, decontam.segments_of(t)) for i, t in dict.fromkeys(items) if t]
    cut = [s for _, _, c in whole for s in c]
    mean = sum(sum(s.values()) for s in cut) / max(1, len(cut))
    held = {w: sum(w in s for s in cut) for s in cut for w in s}

    def share_of(s, words):
        size = sum(s.values())
        weight = {w: math.log(1 + (len(cut) - held[w] + 0.5) / (held[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean)) for w, n in s.items()}
        return sum(x for w, x in weight.items() if w in words) / sum(weight.values())

    out = []
    for t in texts:
        words = decontam.word_list(t)
        met, n = {}, max(1, -(-len(words) // decontam.SEGMENT) - 1) if words else 0
        for p in range(n):
            a, b = p * decontam.SEGMENT, (p + 2) * decontam.SEGMENT
            for k, (_, _, c) in enumerate(whole):
                if any(share_of(s, set(words[a:b])) >= retrieve - 1e-9 for s in c):
                    met[k] = min(met.get(k, (a, b))[0], a), b
        found = set()
        for k, (a, b) in met.items():
            i, text, _ = whole[k]
            q, s = decontam.question_and_answer(text)
            size = len(decontam.word_list(text))
            here = words[max(0, a - size) : b + size]
            if decontam.share(q, here) >= question and (not s or decontam.share(s, here) >= answer):
                found.add(i)
        out.append(decontam.in_order(found))
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(15)
    make = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 3))) for _ in range(n))
    questions = [f"{make(rng.randint(4, 40))}. {make(rng.randint(1, 8))}." for _ in range(25)] + [make(150)]
    items = [*enumerate(questions), (3, questions[4]), (40, questions[0]), (41, questions[0]), (42, None), (43, "")]  # repeated ids, equal texts
    edit = lambda t, p: " ".join(w if rng.random() > p else "zz" for w in t.split(" "))
    texts = [None, "", "...", make(400), make(3000) + " " + questions[7] + " " + make(2000)]
    for q in questions:
        texts += [f"{make(rng.randint(0, 200))} {edit(q, p)} {make(rng.randint(0, 200))}" for p in (0, 0.05, 0.15, 0.4)]
    texts += texts[5:7]
    frame = docs(spark, texts).withColumn("items", F.lit("clash"))
    got = {r["doc_id"]: r["items"] for r in decontam.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(texts, items)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(map(bool, want)) > 40 and [0, 40, 41] in want and any(3 in w for w in want)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    make = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{make(30)}. {make(8)}." for _ in range(40)]
    rows = [(None if k % 10 == 9 else k % 7, t) for k, t in enumerate(texts)]  # null ids, and ids with several texts
    items = spark.createDataFrame([*rows, (3, None), (4, "")], "item_id long, text string").repartition(3)
    edited = lambda t: " ".join(w if rng.random() > 0.3 else word() for w in t.split(" "))
    read = docs(spark, [None, "", make(300), *[f"{make(50)} {t} {make(50)}" for t in texts], *[f"{make(50)} {edited(t)} {make(50)}" for t in texts]])
    found = lambda: sorted((r["doc_id"], r["n_passages"], r["items"], round(r["best_score"], 9), r["contaminated"]) for r in decontam.find_leaks(read, items).collect())
    whole = found()
    assert all(rows[k][0] in whole[3 + k][2] for k in range(40)) and not any(r[4] for r in whole[:3])
    monkeypatch.setattr(decontam, "MAX_ITEMS", 9)
    assert found() == whole


# 9


def test_language_id(spark):
    rng = random.Random(3)
    speech = {"xx": "lorem ipsum dolor sit amet consectetur".split(), "yy": "quick brown fox jumps over lazy dog".split(), "zz": "häuser über straße grün schön".split()}
    texts, langs = [], []
    for i in range(120):
        lang = ["xx", "yy", "zz"][i % 3]
        texts.append(" ".join(rng.choice(speech[lang]) for _ in range(60)))
        langs.append(lang)
    model = lang_id.learn(docs(spark, texts[:90], langs).select("doc_id", "text", "lang"))
    frame = docs(spark, [*texts[90:], None, "", "123 !!", texts[0] * 200], [*langs[90:], "xx", "xx", "xx", "xx"])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_id.identify(frame, model).collect()}
    assert [got[i][0] for i in range(30)] == langs[90:] and all(0 <= s <= 1 for _, s in got.values())
    assert got[30] == got[31] == got[32] == ("und", 0.0) and got[33][0] == "xx"
    assert lang_id.learn(docs(spark, ["a"], [None]).select("doc_id", "text", "lang")) == {}
    # Plainly: compress each text behind each dictionary, take the smallest, reject narrow margins.
    import zstandard

    mixed = [*texts[90:], *[" ".join(rng.choice(speech["xx"] + speech["yy"]) for _ in range(8)) for _ in range(20)], "x y z " * 2000, "same", "same"]
    plain = []
    for t in mixed:
        data = lang_id.letters(t).encode()
        sizes = {}
        for k, raw in model.items():
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[k] = sum(len(c.compress(data[i : i + lang_id.BLOCK])) for i in range(0, len(data), lang_id.BLOCK))
        (best, pred), (second, _) = sorted((n, k) for k, n in sizes.items())[:2]
        plain.append((pred, (second - best) / second, (second - best) / second < 0.02))
    out = lang_id.identify(docs(spark, mixed).withColumn("lang_pred", F.lit("clash")), model).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in out] == plain
    assert any(p[2] for p in plain) and not all(p[2] for p in plain)
    assert lang_id.identify(docs(spark, []), model).count() == 0
    assert [r["lang_pred"] for r in lang_id.identify(docs(spark, ["a"]), {}).collect()] == ["und"]


# 10


def brute_cover(rows):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                covered[p : p + 100] = True
            seen.add(w)
        spans = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        out.append((i, len(b), int(covered.sum()), len(spans) // 2, hashlib.sha256(np.frombuffer(b, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


def repeats(frame):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(frame).collect())


def test_repeats_match_brute_force(spark):
    rng = random.Random(10)
    make = lambda n: "".join(rng.choice("abcdefgh \né") for _ in range(n))
    shared = [make(n) for n in (99, 100, 101, 150, 400, 1000)]
    texts = [None, "", "short", "a" * 350, "ab" * 200, make(99), shared[4], shared[4], "\x00" * 150, "\x00" * 250]
    for _ in range(40):
        text = make(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 30)
            text += s[a : len(s) - rng.randint(0, 30)] + make(rng.randint(0, 60))
        texts.append(text)
    assert repeats(docs(spark, texts)) == brute_cover(enumerate(texts))
    assert repeats(docs(spark, [])) == []


def test_hot_grams_are_split_by_window(spark, monkeypatch):
    rng = random.Random(21)
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    line, passage = make(60), make(160)
    texts = [make(rng.randint(0, 90)) + rng.choice([line, passage, passage[20:], ""]) + make(rng.randint(0, 90)) for _ in range(80)]
    whole = repeats(docs(spark, texts))
    assert whole == brute_cover(enumerate(texts))
    monkeypatch.setattr(suffix_dedup, "HOT", 10)
    used = []
    real = suffix_dedup.covered_by_window
    monkeypatch.setattr(suffix_dedup, "covered_by_window", lambda *a: (used.append(len(a[1].value)), real(*a))[1])
    assert repeats(docs(spark, texts)) == whole and used and used[0] > 0


def test_windows_of_equal_hashes_are_told_apart_by_their_bytes(spark, monkeypatch):
    rng = random.Random(22)
    make = lambda n: "".join(rng.choice("ab") for _ in range(n))
    shared = make(120)
    texts = [make(40) + shared[: rng.randint(90, 120)] + make(40) for _ in range(30)]
    gram = suffix_dedup.selected
    rows = [suffix_dedup._contexts(np.frombuffer(t.encode(), np.uint8), gram(np.frombuffer(t.encode(), np.uint8))[0]) for t in texts]
    flat, doc = np.concatenate(rows), np.repeat(np.arange(30), [len(r) for r in rows])
    plain = suffix_dedup.covered(flat, np.zeros(len(flat), np.int64), doc, np.zeros(len(flat), np.int64))
    monkeypatch.setattr(suffix_dedup, "_BYTE", np.zeros(256, np.uint64))  # every window has the same hash
    again = suffix_dedup.covered(flat, np.zeros(len(flat), np.int64), doc, np.zeros(len(flat), np.int64))
    assert len(plain[0]) and all((a == b).all() for a, b in zip(plain, again))


def test_repeated_and_null_ids_each_get_a_row(spark):
    rng = random.Random(2)
    t = "".join(rng.choice("abcdef ") for _ in range(300))
    frame = spark.createDataFrame([(1, t), (1, t), (None, t[:150]), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(frame).collect())
    assert got == [(0, 150, 0), (1, 300, 150), (1, 300, 300), (2, 0, 0)]


def test_cut_characters_go_whole_and_others_stay(spark):
    rng = random.Random(23)
    make = lambda n: "".join(rng.choice("日本語é☃\ufffd") for _ in range(n))
    shared = make(60)
    texts = [make(9) + shared + make(9), make(5) + shared[1:] + make(7), "\ufffd", None, shared]
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs(spark, texts), keep=("lang", "rep")).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = {k for a, b in [(s["start"], s["end"]) for s in out[i]["spans"]] for k in range(a, b)}
        want, at = "", 0
        for ch in t or "":
            n = len(ch.encode())
            want += "" if gone & set(range(at, at + n)) else ch
            at += n
        assert out[i]["text"] == (None if t is None else want) and len(data) == out[i]["n_bytes"] and out[i]["rep"] == "y"
    assert len(out[1]["spans"]) and out[2]["text"] == "\ufffd"


def test_merge_never_compares_known_prefixes(monkeypatch):
    rng = random.Random(11)
    strings = [bytes(rng.choice(b"ab") for _ in range(20)) for _ in range(300)]
    runs = [sorted(strings[i::7]) for i in range(7)]
    calls = []
    real = suffix_dedup._common
    monkeypatch.setattr(suffix_dedup, "_common", lambda a, b, k: (calls.append(a[:k] == b[:k]), real(a, b, k))[1])
    packed = [(r, suffix_dedup.shared_prefixes(np.frombuffer(b"".join(r), np.uint8).reshape(-1, 20)).tolist()) for r in runs]
    order = list(suffix_dedup.merge_runs(packed))
    merged = [runs[r][i] for r, i, _ in order]
    assert merged == sorted(strings) and all(calls)
    for k in range(1, len(merged)):
        want = next((i for i in range(20) if merged[k][i] != merged[k - 1][i]), 20)
        assert order[k][2] == want


def test_front_coding_round_trip():
    data = np.frombuffer(b"the cat and the cat and the dog sat on the mat with the cat and more words to come here" * 4, np.uint8)
    rows = suffix_dedup._contexts(data, np.arange(0, 200, 7))
    rows = rows[np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")]
    keys, shared, before, doc, pos = suffix_dedup.unpack_run(suffix_dedup.pack_run(rows, np.arange(len(rows)), np.arange(len(rows)) * 3))
    assert b"".join(keys) == rows[:, :101].tobytes() and (before == rows[:, 101:]).all() and pos.tolist() == [3 * i for i in range(len(rows))]


# All


def test_registered_queries_and_slices():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert [b - a for a, b in common.slices([5, 5, 5, 50, 1], 10)] == [2, 1, 1, 1]


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    n = rows.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = common.checkpoint(stage(spark, rows.withColumn("extra", rows["doc_id"]) if k == 0 else rows, sf))
        assert 0.4 * n < rows.count() <= n
        if k + 1 < len(corpus_pipeline.STAGES):
            assert tuple(rows.columns) == corpus_pipeline.COLUMNS
    assert rows.where("n_tokens <> size(tokens)").count() == 0


def odd_ids(spark, texts):
    """Rows with null and repeated ids, each with a lang of its own."""
    rng = random.Random(12)
    rows = [(rng.choice([None, 1, 2, 3, 100 + k]), t, f"l{k}", f"s{k}", len(t or "")) for k, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_near_duplicates_stage_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(11)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = [None, None, "", *[make(40) for _ in range(30)]]
    for t in texts[5:15]:
        texts += [t, t + " " + make(2), make(1) + " " + t][: rng.randint(1, 3)]
    rows, frame = odd_ids(spark, texts)
    sets = [set(lsh_forest.shingles(r[1], lsh_forest.WordHashes()).tolist()) for r in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] or "", rows[k][2]))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for k in order:
        first.setdefault(group[k], k)
    got = sorted(tuple(r) for r in corpus_pipeline.near_duplicates_stage(spark, frame, "").select("lang", "source", F.coalesce("doc_id", F.lit(-1))).collect())
    assert got == sorted((rows[k][2], rows[k][3], -1 if rows[k][0] is None else rows[k][0]) for k in first.values())


def test_repeated_passages_stage_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(13)
    make = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    shared = [make(150), make(300)]
    rows, frame = odd_ids(spark, [None, None, "", "", "\ufffd" + shared[0] + "\ufffd", *[make(rng.randint(0, 80)) + rng.choice([*shared, ""]) + make(rng.randint(0, 80)) for _ in range(30)]])
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2]))
    want = [(r[2], r[3], r[0], None if r[1] is None else c[4]) for r, c in zip(rows, brute_cover([(r[0], r[1]) for r in rows]), strict=True)]
    out = corpus_pipeline.repeated_passages_stage(spark, frame, "").collect()
    assert sorted((r["lang"], r["source"], r["doc_id"], None if r["text"] is None else hashlib.sha256(r["text"].encode()).hexdigest()) for r in out) == sorted(want, key=lambda x: x[0])
    assert all(r["n_chars"] == len(r["text"] or "") for r in out)


def test_pipeline_matches_plain_forms_of_its_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    questions = [f"{make(25)}. {make(6)}." for _ in range(5)]
    passage = make(40)
    texts = [make(rng.randint(30, 90)) + rng.choice(["", "", " " + passage, " " + questions[k % 5]]) + " " + make(10) for k in range(120)]
    texts = [t + " vile vile vile" if k % 4 == 1 else t for k, t in enumerate(texts)]
    texts += [texts[0], texts[2] + " more words", None, "", texts[4]]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int(i % 4 == 1)) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(questions)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["source"], list(r["tokens"]), r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    known: dict = {}
    graded = [2 - (i % 4 == 1) for i in range(120)]
    order = sorted(((graded[i], np.sort(quality.features(texts[i], known)).astype("<i4").tobytes()) for i in range(120)))
    model = quality.fit([np.frombuffer(b, "<i4") for _, b in order], np.array([g for g, _ in order]), 3)
    left = [(i, t) for i, t in enumerate(texts) if float(1 / (1 + np.exp(-(sum(float(model.weights[b]) for b in quality.features(t, known)) - model.thresholds[-1])))) >= 0.85]
    groups = brute_groups([t for _, t in left])
    left = [x for x, g in zip(left, groups) if g[2]]
    cleaned, seen = [], set()
    for i, t in left:
        data = (t or "").encode()
        gone = {p + k for p in range(len(data) - 99) if data[p : p + 100] in seen or seen.add(data[p : p + 100]) for k in range(100)}
        cleaned.append((i, None if t is None else bytes(b for p, b in enumerate(data) if p not in gone).decode()))
    clean = [(i, t) for (i, t), found in zip(cleaned, brute_leaks([t for _, t in cleaned], list(enumerate(questions)))) if not found]
    v = pieces.Vocabulary.load(piece_model())
    assert set(got) == {i for i, _ in clean} and 40 < len(got) < 110
    for i, t in clean:
        assert got[i][0] == f"s{i % 3}" and v.decode(got[i][1]) == (t or "") and got[i][2] == len(got[i][1])
