"""Single accounts looked at closely: their comments with the marks that made them suspicious, out of a store laid out by account.

The store's folders are buckets of accounts. A list of suspects is short by its limit and is broadcast; its buckets, known only when it
has been made, prune the store's folders at run time, and its ids prune within files, which are sorted by account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import config as C
from ..sources.snapshots import Snapshots
from . import accounts as A
from .store import pinned

BUCKETS = 64
#: How many accounts a list may hold, as it is broadcast.
MAX_SUSPECTS = 1000


def bucket_of(user: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


def store_activity(activity: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """A new version of the store. Spark parts large buckets and joins small ones, so that an account of very many comments isn't one task's."""
    rows = activity.withColumn("account_bucket", bucket_of(F.col("user_id"), buckets))
    rows = rows.hint("rebalance", F.col("account_bucket")).sortWithinPartitions("account_bucket", "user_id", "ts")
    return Snapshots(activity.sparkSession, path).write(rows, partition_by=("account_bucket",), told={"buckets": buckets})


def suspects(activity: DataFrame, n: int = 30) -> DataFrame:
    """rank, user_id, total, suspicion, credibility and the features of the ``n`` most suspicious accounts; busier ones first, then the smaller id."""
    if not 0 <= n <= MAX_SUSPECTS:
        raise ValueError(f"a list of {n} accounts; at most {MAX_SUSPECTS}")
    order = (F.col("suspicion").desc(), F.col("total").desc(), F.col("user_id"))
    top = A.suspicion(activity).orderBy(*order).limit(n)
    return pinned(top.withColumn("rank", F.row_number().over(Window.orderBy(*order))))


def stored_comments(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """The stored comments of the accounts in a list (rank, user_id): other buckets' folders aren't read."""
    store = Snapshots(spark, path)
    told = store.manifest()
    if told is None:
        raise ValueError(f"no activity is stored in {path}")
    short = listed.where(F.col("rank") <= MAX_SUSPECTS).select("rank", "user_id", bucket_of(F.col("user_id"), told["buckets"]).alias("account_bucket"))
    return store.read().join(F.broadcast(short), ["account_bucket", "user_id"]).drop("account_bucket")


def marked_comments(comments: DataFrame) -> DataFrame:
    """Comments with ``template`` and ``burst``; an undated one is in no burst."""
    rows = pinned(A.template_flags(comments))
    dated = A.burst_flags(rows.where("ts is not null"))
    return dated.unionByName(rows.where("ts is null").withColumn("burst", F.lit(False)))


def first_marked(marked: DataFrame, mark: str, n: int = 10) -> DataFrame:
    """An account's first ``n`` comments with a mark, in the order of time: what a detail shows."""
    order = Window.partitionBy("user_id").orderBy(F.col("ts").asc_nulls_last(), "event_id")
    return marked.where(mark).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def brand_lines(activity: DataFrame) -> DataFrame:
    """user_id, nth, brand, n, mean: an account's brands, most comments first, then by name."""
    stats = A.brand_stats(activity).select("user_id", "brand", "n", F.round("mean", 4).alias("mean"))
    return stats.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("n").desc(), "brand")))


#: What the features mean, in the order in which a detail tells them.
EXPLAINED = {"one_sided": "偏向單一品牌正面、競品負面的程度", "single_brand": "留言集中在單一品牌的程度", "extreme": "極端情感留言比例", "template_like": "完全重複或近似樣板留言比例", "burst": "同品牌短時間爆發留言比例"}


def detail_lines(listed: DataFrame, comments: DataFrame, marked: DataFrame) -> DataFrame:
    """rank, user_id, line, text: the lines of each account's detail; features below the needed activity aren't told."""
    two = lambda c: F.format_number(c, 2)
    told = listed.select("rank", "user_id", "total", "suspicion", "credibility", *C.SUSPICION_WEIGHTS)
    lean = A.profiles(A.brand_stats(comments)).select("user_id", "lean_brand")
    head = told.join(lean, "user_id", "left").select("rank", "user_id", F.posexplode(F.array(
        F.concat(F.lit("帳號可疑明細: "), F.col("user_id").cast("string")),
        F.concat(F.lit("總留言數: "), F.col("total").cast("string"), F.lit("; 信度: "), two("credibility"), F.lit("; 可疑分: "), two("suspicion"), F.lit("; 傾向品牌: "), F.coalesce("lean_brand", F.lit("-"))),
        F.lit("品牌互動"),
    )).alias("at", "text"), F.lit(0).alias("part"))
    brands = brand_lines(comments).join(told.select("rank", "user_id"), "user_id").select("rank", "user_id", F.col("nth").alias("at"), F.concat(F.lit("- "), "brand", F.lit(": 留言數="), F.col("n").cast("string"), F.lit(", 平均情感="), two("mean")).alias("text"), F.lit(1).alias("part"))
    features = F.array(F.lit("特徵明細"), *[F.concat(F.lit(f"- {n}: "), two(n), F.lit(f" ({words})")) for n, words in EXPLAINED.items()])
    features = F.when(F.col("total") >= C.MIN_ACTIVITY, features).otherwise(F.array(F.lit("特徵明細"), F.lit("- 未達活動量門檻，未計算特徵")))
    known = told.select("rank", "user_id", F.posexplode(features).alias("at", "text"), F.lit(2).alias("part"))
    parts = [head.select("rank", "user_id", "part", "at", "text"), brands.select("rank", "user_id", "part", "at", "text"), known.select("rank", "user_id", "part", "at", "text")]
    for k, (mark, title) in enumerate({"template": "template_like 標記留言", "burst": "burst 標記留言"}.items()):
        shown = first_marked(marked, mark)
        line = F.concat(F.lit("- ["), "brand", F.lit("] "), F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("時間未知")), F.lit(" "), F.coalesce("text", F.lit("")))
        parts.append(told.select("rank", "user_id", F.lit(3 + k).alias("part"), F.lit(0).alias("at"), F.lit(title).alias("text")))
        parts.append(shown.select("rank", "user_id", F.lit(3 + k).alias("part"), F.col("nth").alias("at"), line.alias("text")))
        none = told.join(shown.select("user_id").distinct(), "user_id", "left_anti")
        parts.append(none.select("rank", "user_id", F.lit(3 + k).alias("part"), F.lit(1).alias("at"), F.lit("- 無").alias("text")))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return lines.withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy("part", "at"))).select("rank", "user_id", "line", "text")
