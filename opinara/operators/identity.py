"""Which names are one product, and which products a post is about.

Names of a brand form greedy clusters with complete links: in the order of their keys, each joins the first cluster to all of whose
members it is alike. Alike pairs are found by set-similarity joins, only pairs found are compared in sequence, and the greedy step gets one
connected set of alike names at a time, never a brand's whole catalogue.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import config as C
from ..functions import extract as E, names as N, text as TX
from ..functions.text import bigrams
from .fingerprints import product_key, product_key_v2, rule_guess
from .similar import similar_pairs, spread
from .store import pinned


def alike(a: str, b: str) -> bool:
    """Keys of one product: equal; or with the same flavours, and two of them and a form in common, or close in sequence or in their sets of characters."""
    if a == b:
        return True
    if N.UNKNOWN in (a, b):
        return False
    x, y = ({w for w in N.FLAVOURS if w in k} for k in (a, b))
    if x != y:
        return False
    forms = [{w for w in N.FORMS if w in k} for k in (a, b)]
    if len(x) > 1 and (forms[0] & forms[1] or all(f & set(N.ICE) for f in forms)):
        return True
    return difflib.SequenceMatcher(None, a, b).ratio() >= C.NAME_SIMILARITY or len(set(a) & set(b)) / len(set(a) | set(b)) >= C.NAME_JACCARD


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def alike_pairs(keys: DataFrame) -> DataFrame:
    """brand, a, b: pairs of keys (brand, key) that are alike.

    A ratio of at least r means that r of all characters are matched, so that the multisets of characters, written as sets of
    (character, how often it came before), have a Jaccard similarity of r / (2 - r) at least.
    """
    chars = F.filter(F.split("key", ""), lambda c: c != "")
    counted = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == c)).cast("string")))
    rows = keys.where(F.col("key") != N.UNKNOWN).select("brand", "key", F.array_distinct(chars).alias("c"), counted.alias("m"), F.struct("brand", "key").alias("id"))
    near = lambda tokens, least: similar_pairs(rows, ["brand"], "id", tokens, least).select("a.brand", F.col("a.key").alias("a"), F.col("b.key").alias("b"))
    r = C.NAME_SIMILARITY
    found = near("c", C.NAME_JACCARD).unionByName(near("m", r / (2 - r)))
    tasty = rows.withColumn("f", F.array_join(F.array_sort(N.words_in(F.col("key"), N.FLAVOURS)), "|")).where(F.col("f").contains("|")).select("brand", "f", "key")
    # Keys of the same two flavours or more, by a form that they share; the ices count as one form.
    forms = F.array_distinct(F.transform(N.words_in(F.col("key"), N.FORMS), lambda w: F.when(w.isin(N.ICE), "ice").otherwise(w)))
    formed = tasty.select("brand", "f", "key", F.explode(forms).alias("form"))
    least = formed.groupBy("brand", "f", "form").agg(F.min("key").alias("a"))
    # Any two of these are alike, so one link to the smallest holds the group together; the rest are told apart below.
    chained = formed.join(least, ["brand", "f", "form"]).where(F.col("a") < F.col("key")).select("brand", "a", F.col("key").alias("b"))
    return found.unionByName(chained).distinct().where(_alike("a", "b"))


def connected(edges: DataFrame, most: int = 50) -> DataFrame:
    """brand, node, part: the smallest node that each node of the edges (brand, a, b) reaches."""
    both = pinned(edges.select("brand", F.col("a").alias("node"), F.col("b").alias("mate")).unionByName(edges.select("brand", F.col("b").alias("node"), F.col("a").alias("mate"))))
    now = pinned(both.groupBy("brand", "node").agg(F.least(F.min("mate"), F.first("node")).alias("part")))
    for _ in range(most):
        offered = both.join(now.select("brand", F.col("node").alias("mate"), "part"), ["brand", "mate"]).groupBy("brand", "node").agg(F.min("part").alias("offer"))
        lower = now.join(offered, ["brand", "node"]).select("brand", "node", F.least("part", "offer").alias("part"), (F.col("offer") < F.col("part")).alias("moved"))
        # Jump on to what the part itself has come to.
        root = lower.select("brand", F.col("node").alias("part"), F.col("part").alias("root"))
        nxt = pinned(lower.join(root, ["brand", "part"], "left").select("brand", "node", F.least("part", F.coalesce("root", "part")).alias("part"), "moved"))
        now = nxt.drop("moved")
        if not nxt.where("moved").take(1):
            return now
    raise RuntimeError("names did not settle")


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """One connected set of keys, in order."""
    clusters: list[list[str]] = []
    for key in sorted(pdf["key"]):
        home = next((c for c in clusters if all(alike(key, other) for other in c)), None)
        if home is None:
            clusters.append([key])
        else:
            home.append(key)
    return pd.DataFrame([(pdf["brand"].iloc[0], k, c[0]) for c in clusters for k in c], columns=["brand", "key", "cluster"])


def cluster_names(names: DataFrame) -> DataFrame:
    """brand, name, cluster: each distinct name with the smallest key of its cluster. Names are canonical ones."""
    distinct = names.select("brand", "name", N.merge_key(F.col("name")).alias("key")).where("name is not null").distinct()
    keys = pinned(distinct.select("brand", "key").distinct())
    pairs = pinned(alike_pairs(keys))
    met = connected(pairs).select("brand", F.col("node").alias("key"), "part")
    found = met.groupBy("brand", "part").applyInPandas(lambda pdf: _greedy(pdf), "brand string, key string, cluster string")
    return distinct.join(found, ["brand", "key"], "left").select("brand", "name", F.coalesce("cluster", "key").alias("cluster"))


def routed(text: Column, names: Column) -> Column:
    """The one name whose distinctive pairs of characters the text holds; null for none or several."""
    hits = _hits(text, _distinctive(names))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["name"])


def route(comments: DataFrame, text: str, names: str) -> DataFrame:
    """With ``routed``, the name that each comment speaks of."""
    return comments.withColumn("routed", routed(F.col(text), F.col(names)))


def _pairs(text):
    return bigrams(F.regexp_replace(text, r"(?U)[^\w一-鿿]", ""))


def _distinctive(names):
    mine = F.transform(names, lambda n: F.struct(n.alias("name"), _pairs(n).alias("b")))
    return F.transform(mine, lambda m: F.struct(m["name"].alias("name"), F.array_except(m["b"], F.flatten(F.transform(F.filter(mine, lambda o: o["name"] != m["name"]), lambda o: o["b"]))).alias("b")))


def _hits(text, distinctive):
    return F.filter(distinctive, lambda m: F.arrays_overlap(m["b"], _pairs(text)))


def labelled_items(labels: DataFrame) -> DataFrame:
    """fingerprint, items: a product-name cache (fingerprint, item_index, product_name, price) as items in order; a label of blank names only has none."""
    item = F.struct(F.col("item_index").cast("int").alias("i"), F.struct(F.trim("product_name").alias("name"), F.col("price").try_cast("int").alias("price")).alias("x"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda r: r["x"])
    return labels.groupBy("fingerprint").agg(F.filter(items, lambda x: x["name"] != "").alias("items"))


def find_items(posts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """With ``items``: the products of a post's field by rules, or by a label under its key, the current one before the legacy one."""
    field = F.when(F.coalesce("is_reply", F.lit(False)), E.reply_part(F.coalesce("product_name", F.lit("")))).otherwise(F.coalesce("product_name", F.lit("")))
    # Reading a field is heavier than its bytes tell.
    rows = spread(posts, "id").withColumns({"_raw": TX.nfkc(field), "_title": TX.nfkc(F.coalesce("title", F.lit("")))})
    # Written once: what follows reads the items several times, and would read the field anew each time.
    rows = pinned(rows.withColumn("items", E.extract_products(F.col("_raw"), F.col("brand"))))
    if labels is None:
        return rows
    known = labelled_items(labels)
    rows = rows.withColumns({"_new": product_key_v2(F.col("brand"), F.col("_title"), TX.nfkc(F.col("product_name")), rule_guess(F.col("items"))), "_old": product_key(F.col("brand"), F.col("_title"), TX.nfkc(F.col("product_name")))})
    for key in ("_new", "_old"):
        rows = rows.join(known.select(F.col("fingerprint").alias(key), F.col("items").alias(f"{key}_items")), key, "left")
    return rows.withColumn("items", E.with_labels(F.col("items"), F.coalesce("_new_items", "_old_items"))).drop("_new", "_old", "_new_items", "_old_items")


def split_posts(posts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A row per post and product: the product's name and price, the others of the post, and its comments, those of a post of several products by whom they speak of.

    Names that are none give way to the title's, a bare form to a title that ends with it; a post without any name goes, unless its field was a plain name already.
    Ids of posts of several products take on the name's key.
    """
    rows = find_items(posts, labels)
    brand, title = F.col("brand"), N.title_fallback(F.col("_title"), F.col("brand"))
    named = F.transform("items", lambda i: F.struct(F.regexp_replace(F.regexp_replace(i["name"], N.PROMO_SUFFIX, ""), r"(?U)\s+", "").alias("name"), i["price"].alias("price")))
    good = F.filter(named, lambda i: (F.length(i["name"]) >= 2) & ~N.is_garbage(i["name"]) & ~N.is_junk(i["name"]))
    known = F.filter(good, lambda i: N.canonical_name(i["name"], brand) != N.UNKNOWN)
    rows = rows.withColumns({"_title_name": title, "_good": known})
    usable = (F.length("_title_name") >= 2) & (N.canonical_name(F.col("_title_name"), brand) != N.UNKNOWN)
    spare = F.when(~N.is_condition(F.col("_raw")), E.first_price(F.col("_raw")))
    fallback = F.when(usable, F.array(F.struct(F.col("_title_name").alias("name"), spare.alias("price")))).otherwise(F.array().cast(E.ITEMS))
    form = lambda n: F.exists(N.words_in(n, N.FORMS), lambda w: F.col("_title_name").endswith(w))
    longer = lambda n: N.is_bare_form(n) & (F.length("_title_name") > F.length(n)) & form(n) & ~N.is_junk(F.col("_title_name"))
    full = F.transform(F.when(F.size("_good") > 0, F.col("_good")).otherwise(fallback), lambda i: F.struct(F.when(longer(i["name"]), F.col("_title_name")).otherwise(i["name"]).alias("name"), i["price"].alias("price")))
    rows = rows.withColumn("_full", full).withColumn("_names", F.transform("_full", lambda i: i["name"]))
    rows = rows.withColumn("_own", _distinctive(F.col("_names")))
    flat = rows.select("*", F.explode("_full").alias("_item"))
    mine = F.filter("comments", lambda c: F.transform(_hits(F.coalesce(c["text"], F.lit("")), F.col("_own")), lambda h: h["name"]) == F.array("_item.name"))
    several = F.size("_full") > 1
    return flat.select(
        F.when(F.size("items") > 1, F.concat("id", F.lit("_"), N.merge_key(F.col("_item.name")))).otherwise(F.col("id")).alias("id"),
        *[c for c in posts.columns if c not in ("id", "product_name", "price", "comments")], F.col("_item.name").alias("product_name"), F.coalesce(F.col("_item.price").cast("string"), F.col("price")).alias("price"),
        F.when(several, mine).otherwise(F.col("comments")).alias("comments"), F.array_remove("_names", F.col("_item.name")).alias("sibling_products"), F.col("product_name").alias("source_product_name"),
    )
