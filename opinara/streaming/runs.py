"""Merging runs of a speaker's rows in a stream: the batch form's result, each run once, when nothing can change it any more.

Rows may come in any order within the watermark. State of a key: rows that the watermark hasn't passed yet, in a list of packs that is read and written as a whole (each row
on its own would be a message to the state store, three in all), and the open run: its head in one value, its texts in a list. A row behind the watermark comes in no more, so rows up to it are settled, taken in
order and folded into the open run; another speaker, or a pause longer than ``pause``, closes it. Timers wake a key for its rows
and for the end of the pause, after which nothing of it is left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONF = "spark.sql.streaming.stateStore.providerClass"
ARROW = "→"
#: Waiting rows that one element of their list carries, as JSON.
TOGETHER = 2_000
ROW = ["at", "ord", "who", "tag", "text"]
ROWS = T.StructType().add("rows", T.StringType())
HEAD = T.StructType().add("who", T.StringType()).add("tag", T.StringType()).add("first_at", T.LongType()).add("first_ord", T.LongType()).add("last_at", T.LongType()).add("n", T.LongType())
TEXT = T.StructType().add("text", T.StringType())


class Runs(StatefulProcessor):
    """Times are microseconds; timers are milliseconds, rounded up, so that none wakes too early."""

    def __init__(self, keys: list[str], pause: int):
        self.keys, self.pause = keys, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("pending", ROWS)
        self.head = handle.getValueState("head", HEAD)
        self.texts = handle.getListState("texts", TEXT)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(*[pdf[c].tolist() for c in ROW], strict=True)]
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs(), [])

    def _settle(self, key, watermark: int, new: list[tuple]) -> Iterator[pd.DataFrame]:
        # The watermark lets rows of its own millisecond in; only earlier ones are settled.
        limit, done = watermark * 1000, []
        held = [tuple(r) for (rows,) in self.waiting.get() for r in json.loads(rows)]
        rows = {(r[0], r[1]): r for r in (*held, *new)}  # of rows of one place the last one counts
        settled, later = sorted(k for k in rows if k[0] < limit), [k for k in rows if k[0] >= limit]
        if later:
            self.handle.registerTimer(min(later)[0] // 1000 + 1)
        if len(later) == len(held) + len(new):
            self._wait(new, keep=True)
        else:
            self._wait([rows[k] for k in later])
            if held and not later:
                self.waiting.clear()
        head = self.head.get() if settled or not new else None
        head = known = None if head is None else tuple(head)
        texts = []
        for place in settled:
            at, ord_, who, tag, text = rows[place]
            if head is not None and (head[0] != who or at - head[4] > self.pause):
                done.append(self._closed(key, head, texts, known))
                head, known, texts = None, None, []
            if head is None:
                head = (who, tag, at, ord_, at, 1)
            else:
                head = (who, tag if head[1] == ARROW and tag != ARROW else head[1], head[2], head[3], at, head[5] + 1)
            texts.append(text or "")
        stored = known is not None or bool(done)
        if head is not None and limit > head[4] + self.pause:  # no row of the pause can come
            done.append(self._closed(key, head, texts, known))
            head, texts = None, []
        if head is None:
            if stored:
                self.head.clear()
        elif settled:
            self.head.update(head)
            self.texts.appendValue(("".join(texts),))
            self.handle.registerTimer((head[4] + self.pause) // 1000 + 2)
        if done:
            names = [*self.keys, "who", "n_merged", "first_at", "first_ord", "tag", "text"]
            yield pd.DataFrame(done, columns=names).astype({"n_merged": "int64", "first_at": "int64", "first_ord": "int64"})

    def _wait(self, rows: list[tuple], keep: bool = False) -> None:
        """Rows that wait, beside those that do or in their place."""
        packed = [(json.dumps(rows[low : low + TOGETHER]),) for low in range(0, len(rows), TOGETHER)]
        if packed:
            self.waiting.appendList(packed) if keep else self.waiting.put(packed)

    def _closed(self, key, head, texts, known):
        """A run's row. Only a run whose head was in the state has texts there."""
        kept = []
        if known is not None:
            kept = [t[0] for t in self.texts.get()]
            self.texts.clear()
        return (*key, head[0], head[5], head[2], head[3], head[1], "".join([*kept, *texts]))


def merge_runs(stream: DataFrame, keys: tuple[str, ...], at: str, order: str, who: str, tag: str, text: str, late: str = "1 hour", pause_hours: float = 24.0) -> DataFrame:
    """keys, who, n_merged, first_at, first_ord, tag, text: consecutive rows of a speaker as one, by (at, order), which is one row's place alone.

    Equals ``accounts.merge_runs`` with the same pause, but for rows later than ``late``, which are left out, and rows without a time.
    """
    spark = stream.sparkSession
    if spark.conf.get(CONF, "") != PROVIDER:
        raise ValueError(f"set {CONF} to {PROVIDER}: ordered state and timers need it")
    if stream.schema[order].nullable:
        stream = stream.where(F.col(order).isNotNull())
    rows = stream.withWatermark(at, late).where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_event_time"), F.unix_micros(F.to_timestamp_ltz(at)).alias("at"), F.col(order).cast("long").alias("ord"), F.col(who).alias("who"), F.col(tag).alias("tag"), F.col(text).alias("text"))
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("who", T.StringType()), T.StructField("n_merged", T.LongType()), T.StructField("first_at", T.LongType()), T.StructField("first_ord", T.LongType()), T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])
    found = rows.groupBy(*keys).transformWithStateInPandas(Runs(list(keys), int(pause_hours * 3_600_000_000)), out, "Append", "EventTime")
    return found.withColumn("first_at", F.timestamp_micros("first_at"))
