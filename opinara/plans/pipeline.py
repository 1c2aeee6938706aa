"""From posts to ranked reports: one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions import attribution as AT, cleaners as CL, sentiment as SE, text as TX
from ..functions import names as N
from ..operators import accounts as A, categories as CA, excerpts as X, fingerprints as FP, identity as ID, layers as LY, opinions as O, publish as P, shelf as SH, store as S


def comments(posts: DataFrame, layers: dict[str, DataFrame] | None = None) -> DataFrame:
    """A row per comment with its sentiment, eligibility and whom it speaks of.

    ``layers``: labels by backend (see ``operators.layers``); a label stands before a stored sentiment and the rules, one that says irrelevant leaves none.
    """
    own = [c for c in ("url", "title", "source_product_name", "product_name") if c in posts.columns]
    rows = posts.select("id", "brand", "product_key", "author", *own, F.col("posted_at").alias("post_at"), F.posexplode("comments").alias("idx", "c"))
    text = TX.nfkc(F.coalesce("c.text", F.lit("")))
    rows = rows.withColumns({"text": text, "user_id": F.col("c.user"), "at": F.coalesce("c.posted_at", "post_at")})
    if layers:
        column = lambda c: TX.nfkc(F.coalesce(F.col(c), F.lit(""))) if c in own else F.lit("")
        source = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("id")) if "url" in own else F.col("id")
        product = F.coalesce(F.nullif(column("source_product_name"), F.lit("")), column("product_name"))
        rows = LY.resolve(rows, ["id", "product_key", "idx"], LY.comment_keys(source, F.col("brand"), product, column("title"), F.coalesce("c.tag", F.lit("")), F.col("text")), layers)
        label = F.col("label")
    else:
        label = F.lit(None).cast("struct<score:double,relevant:boolean,backend:string>")
    rule = F.coalesce("c.sentiment", SE.comment_score(F.coalesce("c.tag", F.lit("")), F.col("text")))
    rows = rows.withColumn("s", F.when(label.isNotNull(), F.when(label["relevant"], F.round(label["score"], 4))).otherwise(rule))
    rows = rows.withColumn("backend", F.coalesce(label["backend"], "c.backend", F.lit("lexicon"))).drop("label", *own)
    rows = rows.withColumn("said", AT.attribution(F.col("brand"), F.col("text"), F.col("s"), F.col("backend")))
    good = F.coalesce(F.col("user_id") != "", F.lit(False)) & ~F.col("user_id").eqNullSafe(F.col("author")) & ~TX.off_topic(F.col("text")) & ~TX.echo(F.col("text")) & F.col("said.include")
    return rows.withColumns({"eligible": good & F.col("s").isNotNull() & F.col("said.sentiment").isNotNull(), "sentiment": F.col("said.sentiment")})


def products(posts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A row per post and product, with ``product_key``: the cluster of the name among its brand's."""
    rows = ID.split_posts(posts, labels)
    rows = S.pinned(rows.withColumn("name", N.canonical_name(TX.nfkc(F.col("product_name")), F.col("brand"))))
    found = ID.cluster_names(rows.select("brand", "name")).select("brand", "name", F.col("cluster").alias("product_key"))
    return rows.join(found, ["brand", "name"])


def reports(posts: DataFrame, as_of, labels: DataFrame | None = None, excerpt_labels: DataFrame | None = None, picks: DataFrame | None = None, sentiments: dict[str, DataFrame] | None = None, categories: DataFrame | None = None) -> DataFrame:
    """Fair scores of products (brand and key), authors and commenters voting alike, with counts, the name most posts use, the category, the latest price and date, the posts' URLs, an excerpt and representative comments.

    Label layers: ``labels`` of product names, ``sentiments`` of comments by backend, ``categories`` (key, category), ``excerpt_labels``, ``picks``.
    """
    product = F.struct("brand", F.col("product_key").alias("name")).alias("product")
    posts = S.pinned(products(posts, labels).withColumn("product", product))
    rows = judged(posts, sentiments)
    names = posts.groupBy(product, "name").agg(F.count("*").alias("n")).groupBy("product").agg(F.min_by("name", F.struct(-F.col("n"), -F.length("name"), F.col("name"))).alias("product_name"))
    priced = F.when(F.col("price").rlike("^[0-9]+$"), F.struct(F.coalesce("posted_at", F.lit("0001-01-01").cast("timestamp")), "id"))
    about = posts.groupBy(product).agg(
        F.count("*").alias("n_posts"), F.sum(F.size("comments")).alias("n_comments"), F.max("posted_at").alias("latest_post_date"), F.max_by("price", priced).try_cast("int").alias("price"), F.array_sort(F.collect_set("url")).alias("post_urls")
    )
    out = scored(posts, rows, as_of).join(about, "product", "right").join(names, "product").join(told(posts, rows, excerpt_labels, picks, names), "product")
    name = TX.nfkc(F.col("product_name"))
    return CA.resolve(out, categories, FP.category_key(TX.nfkc(F.col("product.brand")), name), None, F.col("product_name"))


def payload(found: DataFrame, overrides: DataFrame | None = None, excerpts: DataFrame | None = None) -> DataFrame:
    """What is published of reports: the contract's fields alone, products of one id as one, checked.

    ``overrides``: id, line and what stands in place of a field (see ``publish.apply_overrides``); ``excerpts``: product_key, excerpt.
    """
    rows = found.select(F.col("product.brand").alias("brand"), F.col("product.name").alias("product_key"), *[c for c in found.columns if c not in ("product", "brand", "product_key")])
    if excerpts is not None:
        rows = SH.override_excerpts(rows.withColumnRenamed("review_excerpt", "excerpt"), excerpts, "product_key").withColumnRenamed("excerpt", "review_excerpt")
    rows = P.to_products(rows.fillna({"n_eff": 0.0, "sw": 0.0, "sws": 0.0, "sww": 0.0, "consensus": C.INSUFFICIENT, "confidence": "低"}))
    merged = P.merge_products(rows)
    if overrides is not None:
        merged = P.apply_overrides(merged, overrides, {"product_name": "string", "category": "string", "price": "int", "excerpt": "string"})
    return P.validated(S.pinned(merged))


def judged(posts: DataFrame, layers: dict[str, DataFrame] | None = None) -> DataFrame:
    """Comments of products. Written once: accounts, votes, shills, competitors and representatives all read them."""
    return S.pinned(comments(posts, layers).withColumn("product", F.struct("brand", F.col("product_key").alias("name"))).drop("c"))


def told(posts: DataFrame, rows: DataFrame, labels: DataFrame | None = None, picks: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """product, review_excerpt, rep_positive, rep_negative, review_provisional: whether rules stood in for labels in any of them.

    ``picks``: by product, or a cache by the fingerprint of what a labeller was shown (then with ``names``: product, product_name).
    """
    found = S.pinned(X.candidates(posts))
    said = spoken(rows)
    if picks is not None and "fingerprint" in picks.columns:
        picks = S.pinned(X.picks_for(X.shown_for_picks(posts, said, found, names), picks))
    out = X.representatives(said, found, X.excerpts(posts, labels, found), picks)
    return out.withColumn("review_provisional", F.col("review_provisional") | F.col("rep_provisional")).drop("rep_provisional")


def spoken(rows: DataFrame) -> DataFrame:
    """Judged comments as excerpts and representatives read them."""
    return rows.select("product", "brand", "id", "idx", "text", F.col("said.include").alias("include"), "sentiment")


def scored(posts: DataFrame, rows: DataFrame, as_of) -> DataFrame:
    """Moments and scores of products, with eligible comments and distinct commenters, from posts and judged comments."""
    active = rows.where("eligible")
    activity = active.select("user_id", "brand", "sentiment", F.col("at").alias("ts"), F.xxhash64("id", "idx").alias("event_id"), "text")
    trust = A.suspicion(activity).select("user_id", "credibility")
    spoken = active.select("product", F.col("user_id").alias("user"), F.lit("commenter").alias("role"), ((F.col("sentiment") + 1) / 2).alias("score"), "at", F.struct(F.lit(1).alias("k"), "id", "idx").alias("ord"))
    written = posts.where(F.col("author_score").isNotNull()).select(
        F.struct("brand", F.col("product_key").alias("name")).alias("product"), F.col("author").alias("user"), F.lit("author").alias("role"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("author_score") / 100)).alias("score"), F.col("posted_at").alias("at"), F.struct(F.lit(0).alias("k"), "id", F.lit(0).alias("idx")).alias("ord")
    )
    votes = spoken.unionByName(written).join(trust, F.col("user") == F.col("user_id"), "left")
    votes = votes.withColumn("weight", F.coalesce("credibility", F.lit(1.0)) * O.decay_weight(F.col("at"), F.lit(as_of).cast("timestamp")))
    paid = P.shill_stats(rows.select("product", TX.shill(F.col("text")).alias("shill"), (F.trim("text") != "").alias("counted")))
    counts = active.groupBy("product").agg(F.count("*").alias("n_eligible_comments"), F.countDistinct("user_id").alias("n_unique_commenters"))
    named = rows.where("size(said.brands) > 0").select("product", F.col("said.brands").alias("brands"), F.col("said.other_preferred").alias("other_preferred"), F.col("said.own_preferred").alias("own_preferred"))
    out = O.fair_scores(O.product_moments(O.one_vote(votes), paid.where("shill_flag")))
    return out.join(counts, "product", "left").join(paid.select("product", "shill_ratio", "shill_flag"), "product", "left").join(SH.competitor_stats(named), "product", "left")


def query(posts: DataFrame, as_of, window: S.TimeWindow | None = None, brand: str | None = None, recent_days: int | None = None, labels: DataFrame | None = None, **having) -> DataFrame:
    """The whole way: time filter first, as only it may go below the profiles; then reports, those of a brand or of the last days, HAVING, limit."""
    found = reports(S.filter_posts(posts, window) if window else posts, as_of, labels)
    if brand:
        found = found.where(CL.same_brand(F.col("product.brand"), brand))
    if recent_days and recent_days > 0:
        found = found.where(F.col("latest_post_date") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(recent_days)} days"))
    return O.filter_reports(found, **having)


@dataclass(frozen=True)
class Answer:
    """What was asked for, as it was applied; the brands of the selected posts; the reports."""

    filters: dict
    brands: DataFrame
    reports: DataFrame


def select_posts(posts: DataFrame, start=None, end=None, recent_days: int | None = None, now=None) -> DataFrame:
    """Posts and comments of a time window, without any scoring."""
    return S.filter_posts(posts, S.TimeWindow(start, end, recent_days, now))


def brands_of(posts: DataFrame) -> DataFrame:
    """brand, n_products (distinct normal names), n_posts, n_comments; most products first, then most posts, then by name."""
    name = N.merge_key(N.canonical_name(TX.nfkc(F.coalesce("product_name", F.lit(""))), F.col("brand")))
    g = posts.groupBy("brand").agg(F.countDistinct(name).alias("n_products"), F.count("*").alias("n_posts"), F.sum(F.size("comments")).cast("long").alias("n_comments"))
    return g.orderBy(F.col("n_products").desc(), F.col("n_posts").desc(), "brand")


def answer(posts: DataFrame, as_of, start=None, end=None, recent_days: int | None = None, now=None, brand: str | None = None, **having) -> Answer:
    """A whole question: posts of the window are selected once, their brands listed, their products scored, filtered and ranked, and the filters told as applied."""
    window = S.TimeWindow(start, end, recent_days, now)
    chosen = S.filter_posts(posts, window)
    told = {"brand": brand, "start": window.start.isoformat() if window.start else None, "end": window.end.isoformat() if window.end else None, "recent_days": recent_days, **having}
    return Answer(told, brands_of(chosen), query(chosen, as_of, brand=brand, **having))


DEFAULTS = {"min_n_eff": C.N_EFF_MIN}
