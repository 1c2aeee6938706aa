"""The store: latest snapshots, append-if-new, deltas, refreshes, statistics, time windows."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order]))).where("_k = 1").drop("_k")


def first_of_batch(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order)))).where("_k = 1").drop("_k")


def append_new(stored: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """What a batch adds: its first row of each key that isn't stored yet."""
    return first_of_batch(batch, key, order).join(stored.select(key), key, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str, replace: bool) -> DataFrame:
    """Merge by key: new keys are added, known ones replaced only if asked for."""
    kept = stored.join(new.select(key), key, "left_anti") if replace else stored
    added = new if replace else new.join(stored.select(key), key, "left_anti")
    return kept.unionByName(added)


def refresh(stored: DataFrame, fetched: DataFrame, key: str, take: list[str], keep_if_blank: list[str]) -> DataFrame:
    """Columns ``take`` come from the fetched row where there is one; those of ``keep_if_blank`` only if it has a value."""
    new = fetched.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in (*take, *keep_if_blank)], F.lit(True).alias("_found"))
    out = stored.join(new, key, "left")
    changed = {c: F.when(F.col("_found"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in take}
    changed |= {c: F.when(F.col("_found") & F.col(f"_n_{c}").isNotNull() & (F.trim(F.col(f"_n_{c}").cast("string")) != ""), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in keep_if_blank}
    return out.withColumns(changed).select(*stored.columns, F.coalesce("_found", F.lit(False)).alias("refreshed"))


def lacks_review(posts: DataFrame, on_board: Column) -> DataFrame:
    """Posts worth fetching again for their review: none stored, no reply, on the board. ``on_board``: whether the URL may be fetched."""
    title = F.lower(F.coalesce("title", F.lit("")))
    blank = F.regexp_replace(F.coalesce("review_text", F.lit("")), r"(?U)\s+", "") == ""
    return posts.where(blank & ~F.coalesce("is_reply", F.lit(False)) & ~title.startswith("re:") & F.coalesce(on_board, F.lit(False)))


def attempts(candidates: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The first ``limit`` candidates, all if there is no limit: what a run may fetch."""
    return candidates if limit is None else candidates.orderBy(order).limit(limit)


def backfill(posts: DataFrame, tried: DataFrame, fetched: DataFrame, key: str = "url") -> DataFrame:
    """Posts with the review of a fetched page where theirs was tried for; and per post its ``outcome``.

    ``tried``: keys that were attempted; ``fetched``: key, review_text and ``problem`` (null if the page could be read; a page that is no
    product thread has a null review). Outcomes: not_tried, failed, non_product, no_review_text, updated. A failure keeps the row.
    """
    new = fetched.select(F.col(key), F.col("review_text").alias("_review"), F.col("problem").alias("_problem"), F.lit(True).alias("_there"))
    out = posts.join(tried.select(key, F.lit(True).alias("_tried")), key, "left").join(new, key, "left")
    empty = F.trim("_review") == ""
    outcome = F.when(F.col("_tried").isNull(), "not_tried").when(F.col("_there").isNull() | F.col("_problem").isNotNull(), "failed").when(F.col("_review").isNull(), "non_product").when(empty, "no_review_text").otherwise("updated")
    out = out.withColumn("outcome", outcome)
    return out.withColumn("review_text", F.when(F.col("outcome") == "updated", F.col("_review")).otherwise(F.col("review_text"))).select(*posts.columns, "outcome")


class TimeWindow:
    """Inclusive bounds, either open. ``recent_days`` beats start and end; a date as end means its last microsecond."""

    def __init__(self, start=None, end=None, recent_days: int | None = None, now: dt.datetime | None = None):
        if recent_days is not None:
            if recent_days < 0:
                raise ValueError("recent_days is negative")
            end, start = now, now - dt.timedelta(days=recent_days)
        if isinstance(end, dt.date) and not isinstance(end, dt.datetime):
            end = dt.datetime.combine(end, dt.time.max)
        if isinstance(start, dt.date) and not isinstance(start, dt.datetime):
            start = dt.datetime.combine(start, dt.time.min)
        if start and end and start > end:
            raise ValueError("the window ends before it starts")
        self.start, self.end = start, end

    def holds(self, at: Column) -> Column:
        out = at.isNotNull()
        for bound, test in ((self.start, at.__ge__), (self.end, at.__le__)):
            if bound is not None:
                out = out & test(F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz"))
        return out


def filter_posts(posts: DataFrame, window: TimeWindow) -> DataFrame:
    """Posts in the window, or with a comment in it; comments (array of struct with ``at``) outside go.

    A comment without a date stays with a post that is inside. Where only comments match, the post's own opinion is blanked.
    """
    inside = F.coalesce(window.holds(F.col("posted_at")), F.lit(False))
    kept = F.filter("comments", lambda c: window.holds(c["at"]) | (c["at"].isNull() & inside))
    out = posts.withColumn("_in", inside).withColumn("comments", kept).where(F.col("_in") | (F.size("comments") > 0))
    return out.withColumns({"author_score": F.when(F.col("_in"), F.col("author_score")), "review_text": F.when(F.col("_in"), F.col("review_text")).otherwise("")}).drop("_in")


def age_label(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).when(days < 30, F.concat((F.floor(days / 7)).cast("string"), F.lit(" weeks ago"))).otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit(" months ago")))


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only on a local master."""
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(base or tempfile.mkdtemp(prefix="opinara-"))
    return spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Materialised in the session's checkpoint folder, so that what is read twice is the same."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """With ``number``, from 0 on in the order: ranks within ranges plus the ranges' offsets, so no single task orders all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = pinned(ranged.withColumns({"_part": F.spark_partition_id(), "_k": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return ranged.join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + F.col("_k")).drop("_part", "_k", "_before")


def chunk_numbers(rows: DataFrame, order: str, size: int) -> DataFrame:
    """The chunk of ``size`` rows that each row falls in, by order."""
    return numbered(rows, order).withColumn("chunk", F.floor(F.col("number") / size)).drop("number")


def positional_join(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """The n-th row of one beside the n-th row of the other."""
    return numbered(left, left_order).join(numbered(right, right_order), "number")
