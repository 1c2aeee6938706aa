"""Runs of a speaker merged in a stream: equal to the batch form on shuffled and late input, after a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opinara.operators import accounts as A
from opinara.streaming import runs as R

SCHEMA = "conv long, at timestamp, ord long, who string, tag string, text string"


def test_stream_equals_batch_after_restart(spark, tmp_path):
    rng = random.Random(6)
    start, rows = dt.datetime(2024, 1, 1), []
    for conv in range(6):
        at = start
        for k in range(40):
            at += dt.timedelta(minutes=rng.choice([0, 1, 7, 20, 200]))
            rows.append((conv, at, k, rng.choice("ab"), rng.choice(["推", "→", "→", "噓"]), rng.choice(["x", "yy", "", None]) if k else "é"))
    # Batches follow time, but each row may come up to 55 minutes late.
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(55)))
    source, n = tmp_path / "in", 8
    source.mkdir()
    frame = spark.createDataFrame(rows, SCHEMA)
    end = (99, max(r[1] for r in rows) + dt.timedelta(days=9), 0, "z", "推", "end")
    parts = [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]

    def put(name, part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(source))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        merged = R.merge_runs(stream, ("conv",), "at", "ord", "who", "tag", "text", late="1 hour", pause_hours=2)
        q = merged.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(ValueError):
        R.merge_runs(frame, ("conv",), "at", "ord", "who", "tag", "text")
    spark.conf.set(R.CONF, R.PROVIDER)
    try:
        for i, part in enumerate(parts):
            put(i, part)
            if i == n // 2:
                run()  # and then begin again from what is kept
        put("end", [end])
        run()
        put("late", [(0, start, 1000, "late", "推", "left out"), (99, end[1] + dt.timedelta(days=1), 1, "z", "推", "end")])
        run()
    finally:
        spark.conf.unset(R.CONF)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("conv < 99").select("conv", "who", "n_merged", "first_at", "first_ord", "tag", "text").collect()]
    batch = A.merge_runs(frame, ("conv",), ("at", "ord"), "who", "tag", "text", at="at", pause_hours=2)
    want = [tuple(r) for r in batch.select("conv", "who", "n_merged", "first.at", "first.ord", "tag", "text").collect()]
    assert sorted(got) == sorted(want) and len(want) > 60
