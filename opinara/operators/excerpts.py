"""Excerpts of reviews and representative comments of products: labels first, else rules.

Posts are rows of product (a struct), id, brand, product_name, review_text, posted_at, author_score and sibling_products. What is
picked one after the other is picked in rounds, each an aggregate by product, so no task holds all sentences of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import cleaners as CL, labelling as LB, sentences as SN, text as TX
from . import fingerprints as FP
from .similar import spread
from .store import pinned

# What a representative comment says without.
COMMENT_NOISE = "這款|這個|這品|這次|個人覺得|我覺得|覺得|補充[:：]?|推薦|推推|再推一次"
JOINER = "；"
TEXTS = "array<string>"


def _texts(*columns: Column | str) -> Column:
    return F.array(*columns).cast(TEXTS)


def _beside(rows: DataFrame, each: DataFrame, on: str | list[str] = "product", how: str = "inner") -> DataFrame:
    """Rows with what ``each`` has on their product. Never broadcast: sizes are estimated too low here, as texts come of few bytes, and there is a row for all products."""
    return rows.join(each.hint("merge"), on, how)


def candidates(posts: DataFrame) -> DataFrame:
    """A row per sentence of each product's posts: where it stands, how it is shown, aspects, score, and whether it is told of this very product (strict)."""
    name = F.coalesce("product_name", F.lit(""))
    rows = spread(posts, "product", "id").select("product", "id", F.coalesce("posted_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), "author_score", SN.compact(name).alias("_name"), SN.product_forms(name).alias("_names"), TX.nfkc(F.coalesce("review_text", F.lit(""))).alias("_review"))
    rows = rows.select("*", F.posexplode(SN.sentences(F.col("_review"))).alias("place", "text")).drop("_review")
    text, plain = F.col("text"), F.col("_plain")
    rows = rows.withColumn("_plain", SN.compact(text))
    rows = rows.withColumns({"_own": SN.aspects(plain, F.col("_names")), "_any": SN.aspects(plain), "_decisions": SN.decisions(text, plain), "_sentiments": SN.sentiments(plain)})
    tells = (F.size("_own") > 0) | (F.col("_decisions") > 0) | (F.col("_sentiments") > 0)
    rows = rows.withColumn("strict", tells & ~SN.of_other_form(plain, F.col("_name")))
    rows = rows.withColumn("aspects", F.when(F.col("strict"), F.col("_own")).otherwise(F.col("_any")))
    score = SN.sentence_score(text, F.col("place"), F.size("aspects"), F.col("_decisions"), F.col("_sentiments"), F.col("author_score"))
    shown = CL.render_sentences(F.array(CL.matched_parentheses(text)))
    return rows.select("product", "at", "id", "place", "text", shown.alias("shown"), "strict", "aspects", (F.col("_decisions") > 0).alias("decisive"), text.rlike(SN.FIRST_HAND).alias("first_hand"), score.alias("score"))


def _take(rows: DataFrame, most: int | None, value: Column, order: Callable[[Column], Column], ok: Callable[[Column], Column]) -> DataFrame:
    """Per product the values taken one after the other: each the greatest by ``order`` among those that are ``ok`` beside the ones taken; up to ``most``, or until none is left."""
    kind = T.ArrayType(rows.select(value.alias("v")).schema["v"].dataType)
    taken, rounds = None, 0
    while most is None or rounds < most:
        now = rows.withColumn("_taken", F.array().cast(kind)) if taken is None else _beside(rows, taken)
        now = now.withColumn("_ok", ok(F.col("_taken")))
        pick = F.max(F.when(F.col("_ok"), F.struct(order(F.col("_taken")).alias("o"), value.alias("v"))))
        now = now.groupBy("product").agg(pick.alias("_pick"), F.any_value("_taken").alias("_taken"))
        if most is None:
            now = pinned(now)
        taken = now.select("product", F.when(F.col("_pick").isNull(), F.col("_taken")).otherwise(F.array_append("_taken", F.col("_pick.v"))).alias("_taken"))
        rounds += 1
        if most is None and not now.where("_pick is not null").take(1):
            break
    return taken


def _of(taken: Column, field: str) -> Column:
    return F.transform(taken, lambda t: t[field])


def rule_excerpts(found: DataFrame, length: int = SN.LENGTH, most: int = 3) -> DataFrame:
    """product, excerpt: the sentences that tell most, aspects not yet covered first, in the order of posts (newest first) and text.

    Only sentences of the best kind that a product has count: told of it and of substance, told of it, of substance, any.
    """
    kind = 2 * F.col("strict").cast("int") + ((F.size("aspects") > 0) | F.col("decisive")).cast("int")
    rows = found.withColumn("_kind", kind)
    rows = _beside(rows, rows.groupBy("product").agg(F.max("_kind").alias("_best"))).where("_kind = _best")
    value = F.struct("at", "id", (-F.col("place")).alias("back"), "shown", "text", "aspects", "first_hand")
    fresh = lambda taken: F.size(F.array_except("aspects", F.flatten(_of(taken, "aspects"))))
    used = lambda taken: F.length(F.array_join(F.filter(_of(taken, "shown"), lambda s: s != ""), " "))

    def ok(taken):
        first = F.get(taken, F.lit(0))
        # Of a newer post than the first one taken, which tells more from experience.
        older_says_more = (F.struct("at", "id") > F.struct(first["at"].alias("at"), first["id"].alias("id"))) & (fresh(taken) == 0) & ~F.col("decisive") & (F.size(first["aspects"]) >= 2) & first["first_hand"]
        size = used(taken) + F.when(F.col("shown") == "", 0).otherwise(F.length("shown") + (used(taken) > 0).cast("int"))
        again = F.exists(taken, lambda t: (t["at"] == F.col("at")) & (t["id"] == F.col("id")) & (t["back"] == -F.col("place")))
        return (size <= length) & ~again & ~F.coalesce(older_says_more, F.lit(False)) & ~SN.alike_any(F.col("text"), _of(taken, "text"))

    order = lambda taken: F.struct((F.col("score") + 2.0 * fresh(taken)).alias("gain"), "at", "id", (-F.col("place")).alias("back"))
    taken = _take(rows, most, value, order, ok)
    shown = _of(F.sort_array(F.transform("_taken", lambda t: F.struct(t["at"].alias("at"), t["id"].alias("id"), t["back"].alias("back"), t["shown"].alias("shown"))), asc=False), "shown")
    return taken.select("product", F.array_join(F.filter(shown, lambda s: s != ""), " ").alias("excerpt"))


def body_pools(posts: DataFrame, found: DataFrame) -> DataFrame:
    """Posts with ``pool``: what a labeller is shown, the post's sentences that are unlike each other; posts without any go."""
    own = found.groupBy("product", "id").agg(F.array_sort(F.collect_list(F.struct("place", "shown"))).alias("_all"))  # of one post
    own = own.select("product", "id", SN.unlike(_of(F.col("_all"), "shown"), _texts()).alias("pool"))
    return _beside(posts, own.where(F.size("pool") > 0), ["product", "id"])


def labelled_excerpts(pools: DataFrame, labels: DataFrame, length: int = SN.LENGTH) -> DataFrame:
    """product, excerpt of products all of whose posts with sentences have a label: the posts' rewrites, newest first, unlike each other, while they fit.

    Labels: fingerprint (see ``excerpt_key_v2``), source_indices (array of int), rewrite. A label that points past the pool is none.
    """
    key = FP.excerpt_key_v2(F.col("id"), F.col("product_name"), F.col("review_text"), F.col("brand"), F.array_join("sibling_products", " | "), F.col("pool"))
    given = labels.select(F.col("fingerprint").alias("_key"), F.col("source_indices").alias("_indices"), F.coalesce("rewrite", F.lit("")).alias("text"))
    rows = pools.withColumn("_k", key).join(given, F.col("_k") == F.col("_key"), "left")
    rows = rows.withColumn("_good", F.col("_key").isNotNull() & ~F.exists(F.coalesce("_indices", F.array().cast("array<int>")), lambda i: i >= F.size("pool")))
    rows = pinned(rows.select("product", F.coalesce("posted_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), "id", "text", "_good"))
    whole = rows.groupBy("product").agg(F.bool_and("_good").alias("_whole")).where("_whole").select("product")
    used = lambda taken: F.length(F.array_join(_of(taken, "text"), JOINER))
    after = lambda taken: F.coalesce(F.struct("at", "id") < F.struct(F.get(taken, F.size(taken) - 1)["at"].alias("at"), F.get(taken, F.size(taken) - 1)["id"].alias("id")), F.size(taken) == 0)
    ok = lambda taken: (F.size(taken) == 0) | (after(taken) & (used(taken) <= length) & ~SN.alike_any(F.col("text"), _of(taken, "text")))
    taken = _take(_beside(rows, whole).where("text <> ''"), None, F.struct("at", "id", "text"), lambda _: F.struct("at", "id"), ok)
    # The first that doesn't fit ends the row of rewrites, and isn't part of it.
    fit = F.when(used(F.col("_taken")) > length, F.slice("_taken", F.lit(1), F.size("_taken") - 1)).otherwise(F.col("_taken"))
    return _beside(whole, taken, how="left").select("product", F.coalesce(F.array_join(_of(fit, "text"), JOINER), F.lit("")).alias("excerpt"))


def excerpts(posts: DataFrame, labels: DataFrame | None = None, found: DataFrame | None = None, length: int = SN.LENGTH) -> DataFrame:
    """product, review_excerpt, review_provisional of every product: the labelled excerpt, else that of the rules, which is provisional."""
    found = pinned(candidates(posts)) if found is None else found
    out = _beside(posts.select("product").distinct(), rule_excerpts(found, length), how="left").withColumn("_label", F.lit(None).cast("string"))
    if labels is not None:
        out = _beside(out.drop("_label"), labelled_excerpts(body_pools(posts, found), labels, length).withColumnRenamed("excerpt", "_label"), how="left")
    return out.select("product", F.coalesce("_label", "excerpt", F.lit("")).alias("review_excerpt"), F.col("_label").isNull().alias("review_provisional"))


def comment_pool(comments: DataFrame) -> DataFrame:
    """product, id, idx, text, sentiment: a product's first ``CANDIDATES`` distinct comments that speak of it, cleaned, whatever they think.

    Comments are rows of product, brand, id, idx, text (NFKC), include and sentiment.
    """
    rows = comments.where("include").withColumn("text", CL.representative_comment(F.col("text"), F.col("brand"))).where((F.col("text") != "") & ~CL.structural_noise(F.col("text")))
    first = _first(rows)
    place = F.row_number().over(Window.partitionBy("product").orderBy("id", "idx"))
    return first.withColumn("_n", place).where(F.col("_n") <= SN.CANDIDATES).drop("_n")


def _first(rows: DataFrame) -> DataFrame:
    """Of comments that differ in case and white space only the first one."""
    key = F.regexp_replace(TX.token(F.col("text")), r"(?U)\s+", "")
    return rows.withColumn("_key", key).groupBy("product", "_key").agg(F.min(F.struct("id", "idx", "text", "sentiment")).alias("_r")).select("product", "_r.*")


def _comment_highlights(comments: DataFrame, told: DataFrame, most: int) -> DataFrame:
    """product, _positive, _negative: the first few comments of either side that don't say what the excerpt says."""
    rows = comment_pool(comments).withColumn("text", F.trim(F.regexp_replace("text", COMMENT_NOISE, " ")))
    rows = _first(rows.where((F.col("text") != "") & ~TX.off_topic(F.col("text")) & ~TX.echo(F.col("text"))))
    rows = _beside(rows.where("sentiment <> 0"), told.select("product", "review_excerpt")).withColumn("_like", SN.alike_any(F.col("text"), _texts("review_excerpt"))).where("not _like")
    rows = rows.withColumn("_up", F.col("sentiment") > 0).withColumn("_n", F.row_number().over(Window.partitionBy("product", "_up").orderBy("id", "idx"))).where(F.col("_n") <= most)
    side = lambda up: _of(F.array_sort(F.collect_list(F.when(F.col("_up") == up, F.struct("_n", "text")))), "text")
    return rows.groupBy("product").agg(side(True).alias("_positive"), side(False).alias("_negative"))


def _body_highlights(found: DataFrame, told: DataFrame, up: bool, against: list[str], most: int) -> DataFrame:
    """product, _body: the best sentences of one side, unlike the excerpt and what the columns ``against`` hold. ``told``: products that need some."""
    rows = found.where((F.col("shown") != "") & ((SN.polarity(F.col("text")) > 0) if up else (SN.polarity(F.col("text")) < 0)))
    rows = _beside(rows, told.select("product", F.concat(_texts("review_excerpt"), *against).alias("_against")))
    value = F.struct("shown", "at", "id", "place")
    order = lambda _: F.struct("score", "at", "id", (-F.col("place")).alias("back"))
    again = lambda taken: F.exists(taken, lambda t: (t["at"] == F.col("at")) & (t["id"] == F.col("id")) & (t["place"] == F.col("place")))
    taken = _take(rows, most, value, order, lambda taken: ~again(taken) & ~SN.alike_any(F.col("text"), F.concat("_against", _of(taken, "shown"))))
    return taken.select("product", _of(F.col("_taken"), "shown").alias("_body"))


def shown_for_picks(posts: DataFrame, comments: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """product, fingerprint and what a labeller is shown of a product, in a fixed order: brand, product_name, other_products, comments, body_candidates.

    Comments are those of ``comment_pool``; body candidates the sentences told of the product, those of newer posts first; both at most ``CANDIDATES``,
    which is the labeller's page. names: product, product_name.
    """
    pool = comment_pool(comments).groupBy("product").agg(_of(F.array_sort(F.collect_list(F.struct("id", "idx", "text"))), "text").alias("comments"))
    order = Window.partitionBy("product").orderBy(F.col("at").desc(), F.col("id").desc(), "place")
    told = found.where("strict and shown <> ''").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SN.CANDIDATES)
    body = told.groupBy("product").agg(_of(F.array_sort(F.collect_list(F.struct("_n", "shown"))), "shown").alias("body_candidates"))
    others = posts.select("product", F.explode_outer("sibling_products").alias("_s")).groupBy("product").agg(F.array_join(F.array_sort(F.collect_set("_s")), " | ").alias("other_products"))
    rows = _beside(_beside(_beside(names, others), pool, how="left"), body, how="left").withColumns({c: F.coalesce(c, _texts()) for c in ("comments", "body_candidates")})
    rows = rows.withColumn("brand", F.col("product.brand"))
    return rows.withColumn("fingerprint", FP.picks_key(F.col("brand"), F.col("product_name"), F.col("comments"), F.col("body_candidates"), F.col("other_products")))


def picks_for(shown: DataFrame, cache: DataFrame) -> DataFrame:
    """product, positive, negative, positive_body, negative_body: the rewrites of a cache (see ``operators.picks``) for products of which just what is shown now was judged."""
    kept = cache.select(F.col("fingerprint").alias("_key"), *[_of(LB.parse_rewrites(F.col(c)), "text").alias(n) for c, n in (("positive_rewrites", "positive"), ("negative_rewrites", "negative"), ("positive_body_rewrites", "positive_body"), ("negative_body_rewrites", "negative_body"))])
    return shown.select("product", "fingerprint").join(kept, F.col("fingerprint") == F.col("_key")).drop("fingerprint", "_key")


def representatives(comments: DataFrame, found: DataFrame, told: DataFrame, picks: DataFrame | None = None, most: int = CL.REPRESENTATIVES) -> DataFrame:
    """``told`` (product, review_excerpt, ...) with rep_positive, rep_negative and rep_provisional.

    A product's picks (product, positive, negative, positive_body, negative_body: arrays of rewrites) come first. Without picks: comments by
    their sentiment, and sentences of the reviews for a side without any.
    """
    strict = found.groupBy("product").agg(F.max("strict").alias("_strict"))
    found = _beside(found, strict).where("strict = _strict")
    told = pinned(_beside(told, _comment_highlights(comments, told, most), how="left").withColumns({c: F.coalesce(c, _texts()) for c in ("_positive", "_negative")}))
    for side, other, up in (("_positive", "_negative", True), ("_negative", "_positive", False)):
        body = _body_highlights(found, told.where(F.size(side) == 0), up, [other], most)
        told = pinned(_beside(told, body, how="left").withColumn(side, F.when(F.size(side) == 0, F.coalesce("_body", _texts())).otherwise(F.col(side))).drop("_body"))
    if picks is None:
        return told.withColumnsRenamed({"_positive": "rep_positive", "_negative": "rep_negative"}).withColumn("rep_provisional", F.lit(True))
    chosen = picks.select("product", F.lit(True).alias("_picked"), *[F.coalesce(c, _texts()).alias(f"_{c}_pick") for c in ("positive", "negative", "positive_body", "negative_body")])
    out = _beside(told, chosen, how="left")
    above = _texts("review_excerpt")
    out = out.withColumn("_p", SN.unlike("_positive_pick", above)).withColumn("_n", SN.unlike("_negative_pick", F.concat(above, "_p")))
    out = out.withColumn("_p", F.when(F.size("_p") > 0, F.col("_p")).otherwise(SN.unlike("_positive_body_pick", F.concat(above, "_n"))))
    out = out.withColumn("_n", F.when(F.size("_n") > 0, F.col("_n")).otherwise(SN.unlike("_negative_body_pick", F.concat(above, "_p"))))
    side = lambda mine, rule: F.when(F.col("_picked"), F.col(mine)).otherwise(F.col(rule))
    return out.select(*[c for c in told.columns if c not in ("_positive", "_negative")], side("_p", "_positive").alias("rep_positive"), side("_n", "_negative").alias("rep_negative"), F.col("_picked").isNull().alias("rep_provisional"))
