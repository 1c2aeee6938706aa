"""The post store: schema, strict and audited reading, writing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.attribution import OTHER, infer_brand
from ..operators.store import append_new, latest, pinned
from .snapshots import Snapshots

POST_SCHEMA = """
id string, source string, board string, url string, title string, brand string, product_name string, price string, author string, author_score double, review_text string,
posted_at timestamp, is_reply boolean, push_count int, raw struct<fields: map<string,string>>,
comments array<struct<tag:string,user:string,text:string,posted_at:timestamp,sentiment:double,backend:string>>
"""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block and line: rows in the order of their file; a line is numbered within its split."""
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return rows.where(F.trim("value") != "").withColumnsRenamed({"file_path": "file", "file_block_start": "block"})


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no JSON object of the schema: file, value, and whether it is cut off, as by a broken append."""
    parsed = F.from_json("value", POST_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    cut = F.trim("value").startswith("{") & ~F.trim("value").endswith("}")
    return _lines(spark, path).withColumn("p", parsed).where(F.col("p._bad").isNotNull() | F.col("p.id").isNull()).select("file", "value", cut.alias("cut_off"))


def read_posts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The last line of each post, by file and line; a bad line is an error that names some, unless ``strict`` is off. Brands are told anew from title and text."""
    if strict and (bad := bad_lines(spark, path).limit(5).collect()):
        raise ValueError("; ".join(f"{r['file']}: {'cut off' if r['cut_off'] else 'bad'} line {r['value'][:80]!r}" for r in bad))
    parsed = F.from_json("value", POST_SCHEMA, {"mode": "PERMISSIVE"})
    rows = _lines(spark, path).select("file", "block", "line", parsed.alias("p")).where("p.id is not null").select("p.*", F.struct("file", "block", "line").alias("_at"))
    return _told_anew(latest(rows, "id", "_at").drop("_at"))


def _told_anew(posts: DataFrame) -> DataFrame:
    told = infer_brand(F.concat_ws(" ", "title", "product_name"), F.coalesce("review_text", F.lit("")))
    return posts.withColumn("brand", F.when(told == OTHER, F.col("brand")).otherwise(told))


def last_stored(rows: DataFrame) -> DataFrame:
    """Of numbered lines (file, line, p) the last of each post, with its brand told anew from title and text."""
    rows = rows.where("p.id is not null").select("p.*", F.struct("file", "line").alias("_at"))
    return _told_anew(latest(rows, "id", "_at").drop("_at"))


def save_new_posts(spark: SparkSession, batch: DataFrame, path: str, order: str = "posted_at") -> int:
    """Append the posts of a batch that the store doesn't hold, and tell how many; a stored id wins. A store with a bad line is not appended to."""
    try:
        if (bad := bad_lines(spark, path)).take(1):
            raise ValueError(f"{path} holds {bad.count()} bad lines")
        stored = spark.read.schema(POST_SCHEMA).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = batch.limit(0)
    new = pinned(append_new(stored, batch, "id", order))
    new.write.mode("append").json(path)
    return new.count()


def write_labels(rows: DataFrame, path: str, key: str) -> int:
    """A new version of a label cache, as CSV with a header, in the order of its keys."""
    return Snapshots(rows.sparkSession, path).write(rows.orderBy(key), "csv", header=True, escape='"')


def label_files(spark: SparkSession, path: str) -> str:
    """Where the label file is: that of the latest version of a cache, or the path itself."""
    found = Snapshots(spark, path).manifest()
    return f"{path.rstrip('/')}/data/{found['folder']}" if found else path


def read_labels(spark: SparkSession, path: str, columns: list[str], exact: bool = False) -> DataFrame:
    """A label file: every column is needed (and with ``exact`` in this order and no other), a byte-order mark is taken off, later rows of a key come later in ``line``."""
    rows = spark.read.csv(label_files(spark, path), header=True, multiLine=True, escape='"')
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"{path} lacks {missing}")
    if exact and rows.columns != columns:
        raise ValueError(f"{path} has other columns or another order: {rows.columns}")
    return rows.select(*columns).withColumn("line", F.monotonically_increasing_id())
