"""Publishing: merging partial groups, shill shares, overrides, payload checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions import cleaners as CL, display as D
from .opinions import confidence, consensus, percent_split, recommendation


def pooled_merge(reports: DataFrame) -> DataFrame:
    """Groups of one public id, pooled by their moments (stored deviations and means are rounded ones)."""
    second = F.col("sw") * (F.col("score_std") * F.col("score_std") + F.col("score_mean") * F.col("score_mean"))
    g = reports.groupBy("id").agg(
        F.count("*").alias("n_members"), F.sum("n_votes").alias("n_votes"), F.sum("sw").alias("w"), F.sum("sws").alias("ws"), F.sum("sww").alias("ww"), F.sum(second).alias("second"),
        F.max_by("product", F.struct("n_eff", -F.col("product"))).alias("dominant"),
    )
    mean = F.try_divide(F.col("ws"), F.col("w"))
    return g.withColumns(
        {
            "fair_score": F.round(100 * (C.PRIOR_STRENGTH * C.PRIOR_MEAN + F.col("ws")) / (C.PRIOR_STRENGTH + F.col("w")), 1),
            "score_std": F.round(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("second"), F.col("w")) - mean * mean)), 3),
            "n_eff": F.round(F.try_divide(F.col("w") * F.col("w"), F.col("ww")), 2),
        }
    )


def shill_stats(comments: DataFrame) -> DataFrame:
    """Share of counted comments that look paid for, flagged from a quarter of at least three on; ``shill`` and ``counted`` are booleans."""
    n, k = F.count_if("counted"), F.count_if(F.col("counted") & F.col("shill"))
    ratio = F.when(n >= C.SHILL_MIN_COMMENTS, k / n).otherwise(0.0)
    return comments.groupBy("product").agg(n.alias("n_comments"), ratio.alias("shill_ratio"), (ratio >= C.SHILL_RATIO).alias("shill_flag"))


def apply_overrides(products: DataFrame, overrides: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Left join of overrides by id (the last row of an id wins): excluded rows go, a value replaces, a clear mark nulls.

    ``fields``: the product's columns and their types. A price that is no number is an error.
    """
    last = overrides.groupBy("id").agg(*[F.max_by(c, "line").alias(f"o_{c}") for c in [*fields, "exclude"]])
    out = products.join(last, "id", "left").where(F.coalesce(F.col("o_exclude") != C.EXCLUDED, F.lit(True)))
    for name, kind in fields.items():
        o = F.col(f"o_{name}")
        value = F.expr(f"try_cast(o_{name} AS {kind})") if kind != "string" else o
        bad = o.isNotNull() & (o != "") & (o != C.CLEARED) & value.isNull()
        checked = F.when(bad, F.raise_error(F.concat(F.lit(f"bad {name} override: "), o)).cast(kind)).otherwise(value)
        out = out.withColumn(name, F.when(o.isNull() | (o == ""), F.col(name)).when(o != C.CLEARED, checked))
    return out.select(products.columns)


def violations(products: DataFrame, counts: list[str], texts: list[str]) -> DataFrame:
    """Rows that break the public contract, with what they break: negative counts, links in texts, missing ids."""
    checks = [F.when(F.col(c) < 0, F.lit(f"negative {c}")) for c in counts] + [F.when(F.col(t).rlike(r"https?://"), F.lit(f"link in {t}")) for t in texts]
    checks.append(F.when(F.col("id").isNull() | (F.col("id").cast("string") == ""), F.lit("no id")))
    return products.withColumn("broken", F.explode(F.array_compact(F.array(*checks)))).select("id", "broken")


def repeated_ids(products: DataFrame) -> DataFrame:
    return products.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def names_in(schema, path: str = "") -> list[str]:
    """Every field name of a schema, nested ones with their path."""
    out = []
    for f in getattr(schema, "fields", []):
        out.append(path + f.name)
        kind = f.dataType
        while hasattr(kind, "elementType"):
            kind = kind.elementType
        out += names_in(kind, f"{path}{f.name}.")
    return out


def public_rows(rows: DataFrame, private: tuple[str, ...] = ("contributors", "key", "n_eff", "score_std", "score_mean", "user")) -> DataFrame:
    """Without the private columns; a nested field that names users is an error."""
    out = rows.drop(*private)
    if bad := [n for n in names_in(out.schema) if n.split(".")[-1] == "user" or n.split(".")[-1].startswith("suspicion_")]:
        raise ValueError(f"fields name accounts: {bad}")
    return out


def user_hash(user, salt: str):
    """A salted, shortened digest in place of an account's name."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), user.cast("string")), 256), 1, 12)


#: The fields of a published product, with their types.
CONTRACT = """
id string, brand string, product_name string, price int, category string, fair_score long, recommendation_score long, consensus string, confidence string, n_posts long, n_comments long,
raw_comments long, eligible_comments long, unique_eligible_commenters long, independent_threads long, volume_level string, positive_pct long, neutral_pct long, negative_pct long,
likes array<string>, cautions array<string>, excerpt string, review_provisional boolean, post_urls array<string>, latest_date date
"""
#: What merging needs besides, and publishing drops.
INNER = ("sw", "sws", "sww", "score_mean", "score_std", "n_eff", "positive_weight", "neutral_weight", "negative_weight")


def _confident(confidence_col, consensus_col):
    return (confidence_col != "低") & (consensus_col != C.INSUFFICIENT)


def to_products(reports: DataFrame) -> DataFrame:
    """Reports as products: the contract's fields and the inner ones. Scores and shares only with enough evidence; one thread alone is never 高.

    Reports: brand, product_name, price, category, moments and scores, n_posts, n_comments, n_eligible_comments, n_unique_commenters, rep_positive, rep_negative,
    review_excerpt, review_provisional, post_urls, latest_post_date.
    """
    sure = _confident(F.col("confidence"), F.col("consensus"))
    split = [F.when(sure, x) for x in percent_split(F.col("positive_weight"), F.col("neutral_weight"), F.col("negative_weight"))]
    people = F.coalesce("n_unique_commenters", "n_comments")
    return reports.select(
        F.concat("brand", F.lit("::"), "product_name").alias("id"), "brand", "product_name", F.col("price").cast("int").alias("price"), F.coalesce("category", F.lit(D.OTHER)).alias("category"),
        F.bround("fair_score", 0).cast("long").alias("fair_score"), recommendation(F.col("fair_score"), sure).alias("recommendation_score"), "consensus",
        D.display_confidence(F.col("confidence"), F.col("n_posts")).alias("confidence"), F.col("n_posts").cast("long").alias("n_posts"), people.cast("long").alias("n_comments"), F.col("n_comments").cast("long").alias("raw_comments"),
        F.coalesce("n_eligible_comments", "n_comments").cast("long").alias("eligible_comments"), people.cast("long").alias("unique_eligible_commenters"), F.col("n_posts").cast("long").alias("independent_threads"),
        D.volume_level(F.col("confidence"), F.col("consensus"), F.col("n_posts")).alias("volume_level"), *[x.alias(n) for x, n in zip(split, ("positive_pct", "neutral_pct", "negative_pct"), strict=True)],
        *[CL.clean_representatives(F.coalesce(c, F.array().cast("array<string>"))).alias(n) for c, n in (("rep_positive", "likes"), ("rep_negative", "cautions"))],
        F.coalesce("review_excerpt", F.lit("")).alias("excerpt"), F.coalesce("review_provisional", F.lit(False)).alias("review_provisional"), F.coalesce("post_urls", F.array().cast("array<string>")).alias("post_urls"),
        F.col("latest_post_date").cast("date").alias("latest_date"), *INNER,
    )


def merge_products(products: DataFrame) -> DataFrame:
    """Products of one id as one, of the contract's fields: counts added up, scores from pooled moments, the newest price and excerpt.

    Where no weight is left there is no score. Other fields come from the member with the most evidence. A product alone stays as it is.
    """
    evidence = CL.evidence(F.col("n_eff"), F.col("n_comments"))
    newest = F.struct(F.coalesce(F.col("latest_date").cast("string"), F.lit("")), "product_name")
    kept = ["brand", "product_name", "category", "price", "excerpt", "fair_score", "recommendation_score", "consensus", "confidence", "volume_level", "positive_pct", "neutral_pct", "negative_pct", "likes", "cautions", "post_urls"]
    added = ["n_posts", "n_comments", "raw_comments", "eligible_comments", "unique_eligible_commenters", "independent_threads", "sw", "sws", "sww", "positive_weight", "neutral_weight", "negative_weight"]
    in_order = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(-evidence, "product_name", c)), True), lambda x: x[c]))
    g = products.groupBy("id").agg(
        F.count("*").alias("_n"), F.max_by(F.struct(*kept), F.struct(evidence, "n_comments", "product_name")).alias("_d"), *[F.sum(c).alias(c) for c in added],
        F.sum(F.col("sw") * (F.col("score_std") * F.col("score_std") + F.col("score_mean") * F.col("score_mean"))).alias("_second"),
        F.max_by("price", F.when(F.col("price").isNotNull(), newest)).alias("_price"), F.max_by("excerpt", F.when(F.col("excerpt") != "", newest)).alias("_excerpt"),
        F.max("latest_date").alias("latest_date"), F.max("review_provisional").alias("review_provisional"),
        in_order("likes").alias("_likes"), in_order("cautions").alias("_cautions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("post_urls")))).alias("_urls"),
    )
    weighed = F.col("sw") > 0
    mean = F.try_divide(F.col("sws"), F.col("sw"))
    std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("_second"), F.col("sw")) - mean * mean))
    n_eff = F.coalesce(F.try_divide(F.col("sw") * F.col("sw"), F.col("sww")), F.lit(0.0))
    g = g.withColumns({"_fair": F.when(weighed, 100 * (C.PRIOR_STRENGTH * C.PRIOR_MEAN + F.col("sws")) / (C.PRIOR_STRENGTH + F.col("sw"))), "_cons": F.when(weighed, consensus(mean, std, n_eff)).otherwise(C.INSUFFICIENT), "_conf": F.when(weighed, confidence(n_eff)).otherwise("低")})
    sure = weighed & _confident(F.col("_conf"), F.col("_cons"))
    split = percent_split(F.col("positive_weight"), F.col("neutral_weight"), F.col("negative_weight"))
    pooled = {
        "fair_score": F.bround("_fair", 0).cast("long"), "recommendation_score": F.when(weighed, recommendation(F.col("_fair"), F.lit(True))), "consensus": F.col("_cons"), "confidence": F.col("_conf"),
        "positive_pct": F.when(sure, split[0]), "neutral_pct": F.when(sure, split[1]), "negative_pct": F.when(sure, split[2]),
        "likes": CL.clean_representatives(F.col("_likes")), "cautions": CL.clean_representatives(F.col("_cautions")), "post_urls": F.col("_urls"), "price": F.col("_price"), "excerpt": F.coalesce("_excerpt", F.lit("")),
        "volume_level": D.volume_level(F.col("_conf"), F.col("_cons"), F.col("n_posts")),
    }
    merged = {c: F.when(F.col("_n") > 1, pooled[c]).otherwise(F.col(f"_d.{c}")) if c in pooled else F.col(f"_d.{c}") for c in kept}
    fields = [f.split()[0] for f in CONTRACT.replace("\n", " ").split(",")]
    return g.withColumns(merged).select(*fields)


def contract_faults(products: DataFrame) -> list[str]:
    """Fields that the contract lacks or misses, and wrong types."""
    want = {f.split()[0]: f.split(maxsplit=1)[1].strip() for f in CONTRACT.replace("\n", " ").split(",")}
    have = {f.name: f.dataType.simpleString() for f in products.schema.fields}
    kinds = {"long": "bigint"}
    return [f"no {c}" for c in want if c not in have] + [f"extra {c}" for c in have if c not in want] + [f"{c} is {have[c]}" for c, k in want.items() if c in have and have[c] != kinds.get(k, k)]


def validated(products: DataFrame) -> DataFrame:
    """The products, if they are fit to be published; an error tells what isn't."""
    if faults := contract_faults(products):
        raise ValueError(f"not the contract: {faults}")
    flat = products.withColumns({"_likes": F.array_join("likes", " "), "_cautions": F.array_join("cautions", " ")})
    broken = violations(flat, ["n_posts", "n_comments", "raw_comments", "eligible_comments"], ["_likes", "_cautions"]).limit(5).collect()
    if broken or (twice := repeated_ids(products).limit(5).collect()):
        raise ValueError(f"not fit to publish: {[tuple(r) for r in broken or twice]}")
    return products
