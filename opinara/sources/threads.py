"""A board's pages: lists of threads, and threads with their comments, read from HTML as Columns."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import cleaners as CL, text as TX
from ..functions.attribution import infer_brand


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references, for which Spark has no function."""
    return text.map(lambda t: None if t is None else html.unescape(t) if "&" in t else t)


def _plain(markup: Column) -> Column:
    """A fragment's text: no tags, no white space around it."""
    return F.regexp_replace(F.regexp_replace(markup, r"(?s)<[^>]*>", ""), r"(?U)^\s+|\s+$", "")


def _of_class(markup: Column, name: str) -> Column:
    """The text of the first element of a class; empty if there is none. Elements of these pages hold none of their own kind."""
    return _plain(F.regexp_extract(markup, rf'(?s)<(\w+)[^>]*\bclass="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</\1>', 2))


def _blocks(page: Column, name: str) -> Column:
    """What stands between the starts of elements of a class."""
    parts = F.split(page, rf'<div[^>]*\bclass="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>')
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def metadata(page: Column) -> Column:
    """The head of a thread as a map, as 作者 (author), 標題 (title), 時間 (time)."""
    lines = _blocks(page, "article-metaline")
    pairs = F.transform(lines, lambda b: F.struct(_of_class(b, "article-meta-tag").alias("k"), _of_class(b, "article-meta-value").alias("v")))
    first = F.filter(pairs, lambda p, i: (p["k"] != "") & ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def comments(page: Column, posted_at: Column, year: int | None = None) -> Column:
    """The comments in order; those of one account in a row are one, with the first tag that is no arrow and the first time."""
    kind = "array<struct<tag:string,user:string,text:string,posted_at:timestamp>>"
    rows = F.transform(
        _blocks(page, "push"),
        lambda b: F.struct(
            _of_class(b, "push-tag").alias("tag"), _of_class(b, "push-userid").alias("user"), F.trim(F.regexp_replace(_of_class(b, "push-content"), r"^[:：\s]+", "")).alias("text"),
            TX.comment_time(_of_class(b, "push-ipdatetime"), posted_at, year).alias("posted_at"),
        ),
    )

    def add(done, row):
        last = F.element_at(done, -1)
        merged = F.struct(F.when(last["tag"] == "→", row["tag"]).otherwise(last["tag"]).alias("tag"), last["user"].alias("user"), F.concat(last["text"], row["text"]).alias("text"), last["posted_at"].alias("posted_at"))
        same = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["user"] == row["user"])
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged))).otherwise(F.concat(done, F.array(row)))

    return F.aggregate(rows, F.array().cast(kind), lambda done, row: add(done, row).cast(kind))


def body(page: Column) -> Column:
    """The text of a thread without its head, its comments and the board's notes; every tag breaks the line."""
    main = F.regexp_extract(page, r'(?s)<div[^>]*\bid="main-content"[^>]*>(.*)$', 1)
    main = F.when(main != "", main).otherwise(page)
    main = F.regexp_replace(main, r'(?s)<div[^>]*\bclass="(?:[^"]*\s)?(?:article-metaline(?:-right)?|push)(?:\s[^"]*)?"[^>]*>.*?</div>', "")
    main = F.regexp_replace(main, r'(?s)<span[^>]*\bclass="(?:[^"]*\s)?f2(?:\s[^"]*)?"[^>]*>.*?</span>', "")
    return F.regexp_replace(F.regexp_replace(main, r"(?s)<(?:script|style)\b.*?</(?:script|style)>", ""), r"(?s)<[^>]*>", "\n")


def parse_threads(pages: DataFrame, html_col: str = "html", url_col: str = "url", board: str = "CVS", year: int | None = None) -> DataFrame:
    """Posts of product threads, one per page; pages whose title lacks the product tag go."""
    page = unescape(F.col(html_col))
    rows = pages.select(F.col(url_col).alias("url"), page.alias("_page")).withColumn("_meta", metadata(F.col("_page")))
    title = F.coalesce(F.try_element_at("_meta", F.lit("標題")), F.lit(""))
    rows = rows.withColumns({"title": title, "author": CL.clean_author(F.coalesce(F.try_element_at("_meta", F.lit("作者")), F.lit(""))), "posted_at": TX.board_time(F.try_element_at("_meta", F.lit("時間"))), "_body": body(F.col("_page"))})
    rows = rows.where(CL.is_product_title(F.col("title"))).withColumn("_fields", TX.field_map(F.col("_body")))
    fields = F.col("_fields")
    score = CL.first_field(fields, "評分", "分數")
    is_reply = F.lower("title").startswith("re:")
    review = F.coalesce(CL.first_field(fields, "心得", "心得分享"), F.lit(""))
    name = F.coalesce(F.nullif(CL.first_field(fields, "商品名稱", "商品"), F.lit("")), F.nullif(CL.title_name(F.col("title")), F.lit("")), F.col("title"))
    vendor = F.coalesce(CL.first_field(fields, "便利商店/廠商名稱", "便利商店", "廠商名稱", "商店"), F.lit(""))
    return rows.select(
        TX.post_id(F.col("url")).alias("id"), F.lit("PTT").alias("source"), F.lit(board).alias("board"), "url", "title", infer_brand(F.concat_ws(" ", vendor, "title"), F.col("_body")).alias("brand"), name.alias("product_name"),
        CL.first_field(fields, "商品價格", "價格").alias("price"), "author", TX.author_score(score).alias("author_score"),
        F.when((review == "") & ~is_reply, CL.review_after_score(score)).otherwise(review).alias("review_text"), "posted_at", is_reply.alias("is_reply"), F.lit(None).cast("int").alias("push_count"),
        F.struct(fields.alias("fields")).alias("raw"), F.transform(comments(F.col("_page"), F.col("posted_at"), year), lambda c: c.withField("sentiment", F.lit(None).cast("double")).withField("backend", F.lit(None).cast("string"))).alias("comments"),
    )


def parse_lists(pages: DataFrame, base: str, html_col: str = "html") -> DataFrame:
    """title, url, author, date, push_count of the product threads of list pages, with the page's own columns."""
    keep = [c for c in pages.columns if c != html_col]
    rows = pages.withColumn("_page", unescape(F.col(html_col))).select(*keep, F.posexplode(_blocks(F.col("_page"), "r-ent")).alias("place", "_row"))
    link = F.regexp_extract("_row", r'(?s)<a[^>]*\bhref="([^"]*)"[^>]*>', 1)
    title = _plain(F.regexp_extract("_row", r"(?s)<a\b[^>]*>(.*?)</a>", 1))
    rows = rows.select(*keep, "place", title.alias("title"), CL.absolute_url(link, base).alias("url"), _of_class(F.col("_row"), "author").alias("author"), _of_class(F.col("_row"), "date").alias("date"), _of_class(F.col("_row"), "nrec").alias("push_count"))
    return rows.where(CL.is_product_title(F.col("title")))


def previous_page(page: Column, base: str) -> Column:
    """The link of the button to older threads; null if there is none."""
    href = F.regexp_extract(page, r'(?s)<a[^>]*\bclass="btn wide"[^>]*\bhref="([^"]*)"[^>]*>[^<]*上頁[^<]*</a>', 1)
    return F.when(href != "", CL.absolute_url(href, base))
