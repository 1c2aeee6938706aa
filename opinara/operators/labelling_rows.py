"""Rows for human labels: a comment each, with its post, and a few of the comments around it.

What stands around a comment is a window of its post's ordered comments, so a row's context is bounded however long the thread is. A sample is the first n
by a digest of seed and id: the first n of each partition, then of these, so nothing is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Columns of a labelling file, and those that a person fills in.
CONTEXT = ["comment_id", "source", "board", "post_id", "post_url", "post_title", "post_brand", "product_name", "price", "post_tag", "comment_user", "comment_tag", "comment_text", "comment_posted_at", "context"]
LABELS = ["sentiment", "target_brand", "is_comparative", "favored_brand", "notes"]
COLUMNS = [*CONTEXT, *LABELS]


def post_tag(title: Column) -> Column:
    """What stands in the title's first brackets."""
    return F.trim(F.regexp_extract(F.coalesce(title, F.lit("")), r"(?s)[\[【](.*?)[\]】]", 1))


def context(brand: Column, product: Column, tag: Column, price: Column, title: Column) -> Column:
    """The post in one line: brand, product and tag always, price and title where there is one."""
    full = lambda c, name: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    some = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return F.concat_ws("; ", F.concat(F.lit("貼文品牌="), F.coalesce(brand, F.lit(""))), F.concat(F.lit("商品="), some(product)), F.concat(F.lit("tag="), some(tag)), full(price, "價格="), full(title, "標題="))


def iso(at: Column) -> Column:
    """A time as ISO text, parts of a second only where there are some."""
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def labelling_rows(posts: DataFrame, around: int = 2) -> DataFrame:
    """The file's columns, all text, and ``around``: up to so many comments before and after, in order, as ``tag user: text`` lines with the comment's own marked by >."""
    tag = post_tag(F.col("title"))
    rows = posts.select(
        "source", "board", F.col("id").alias("post_id"), F.col("url").alias("post_url"), F.col("title").alias("post_title"), F.col("brand").alias("post_brand"), "product_name", "price", tag.alias("post_tag"),
        context(F.col("brand"), F.col("product_name"), tag, F.col("price"), F.col("title")).alias("context"),
        F.posexplode(F.transform("comments", lambda c, i: F.struct(c.alias("own"), F.transform(F.slice(F.col("comments"), F.greatest(F.lit(1), i + 1 - around), F.least(i, F.lit(around)) + around + 1), lambda x, j: F.struct((j == F.least(i, F.lit(around))).alias("own"), x["tag"].alias("tag"), x["user"].alias("user"), x["text"].alias("text"))).alias("near")))).alias("idx", "c"),
    )
    near = F.array_join(F.transform("c.near", lambda x: F.concat(F.when(x["own"], ">").otherwise(""), F.coalesce(x["tag"], F.lit("")), F.lit(" "), F.coalesce(x["user"], F.lit("")), F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n")
    number = F.when(F.col("idx") < 1000, F.lpad(F.col("idx").cast("string"), 3, "0")).otherwise(F.col("idx").cast("string"))
    rows = rows.withColumns({
        "comment_id": F.concat("post_id", F.lit("#"), number), "comment_user": F.col("c.own.user"), "comment_tag": F.col("c.own.tag"), "comment_text": F.col("c.own.text"), "comment_posted_at": iso(F.col("c.own.posted_at")), "around": near,
    })
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CONTEXT], *[F.lit("").alias(c) for c in LABELS], "around")


def labelling_sample(rows: DataFrame, n: int, seed: int = 0, key: str = "comment_id") -> DataFrame:
    """The same n rows for the same seed. The order is that of a digest, not of another library's shuffle."""
    if n < 0:
        raise ValueError("a sample of less than no rows")
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key)), 256), key).limit(n)
