"""Queries that run a stream over a table to its end, and read what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.store import shared_folder
from .registry import query
from .standins import table


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type AS who, CASE WHEN event_id % 3 = 0 THEN '推' WHEN event_id % 3 = 1 THEN '→' ELSE '噓' END AS tag, coalesce(props, '') AS text FROM events),
w AS (SELECT date_trunc('milliseconds', max(ts) - INTERVAL 1 HOUR) AS w FROM e),
l AS (SELECT e.*, w, CASE WHEN lag(who) OVER o IS DISTINCT FROM who OR ts - lag(ts) OVER o > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM e, w WHERE ts < w WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run, sum(new) OVER (PARTITION BY user_id) AS runs FROM l)
SELECT user_id, who, CAST(count(*) AS BIGINT) AS n_merged, min(event_id) AS first_event, arg_min(tag, (tag = '→', ts, event_id)) AS tag, sha256(string_agg(text, '' ORDER BY ts, event_id)) AS text_sha256
FROM r GROUP BY user_id, who, run HAVING max(run) < max(runs) OR max(ts) + INTERVAL 6 HOURS < max(w)
""")
def run_merge_stream(spark, sf_dir):
    """Events of a user as what is said, their kind as the speaker; runs still open when the table ends aren't told."""
    from ..streaming import runs as R

    k = F.col("event_id")
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream takes no single file
    rows = rows.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("who"), F.when(k % 3 == 0, "推").when(k % 3 == 1, "→").otherwise("噓").alias("tag"), F.col("props").alias("text"))
    before, at = spark.conf.get(R.CONF, None), shared_folder(spark, "runs")
    spark.conf.set(R.CONF, R.PROVIDER)
    try:
        merged = R.merge_runs(rows, ("user_id",), "ts", "event_id", "who", "tag", "text", late="1 hour", pause_hours=6)
        merged.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").format("parquet").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(R.CONF) if before is None else spark.conf.set(R.CONF, before)
    return spark.read.parquet(f"{at}/out").select("user_id", "who", "n_merged", F.col("first_ord").alias("first_event"), "tag", F.sha2("text", 256).alias("text_sha256"))
