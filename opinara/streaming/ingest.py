"""Incremental ingestion: new posts once, refreshed snapshots, burst alerts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..operators.store import upsert


def new_once(stream: DataFrame, key: str = "id", at: str = "posted_at", late: str = "7 days") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def _watch(span: int, least: int):
    """Tells events of full windows, each once. Of a day with ``least`` events or more, all of them told, the outer ones are enough to judge what comes."""

    def watch(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(zip(*state.get, strict=True)) if state.exists else []
        past = state.getCurrentWatermarkMs() * 1000 - span
        for pdf in batches:
            seen = sorted([*seen, *[(int(t), e, False) for t, e in zip(pdf["_at"], pdf["event"], strict=True)]], key=lambda s: s[0])
            full = [i for i in range(len(seen) - least + 1) if seen[i + least - 1][0] - seen[i][0] <= span]
            told = {j for i in full for j in range(i, i + least)}
            news = [seen[j] for j in sorted(told) if not seen[j][2]]
            days: dict[int, list] = {}
            for j, (t, e, was) in enumerate(seen):
                if t >= past:
                    days.setdefault(t // span, []).append((t, e, was or j in told))
            outer = least - 1
            seen = [s for day in days.values() for s in (day if len(day) <= 2 * outer else [*day[:outer], *day[-outer:]])]
            yield pd.DataFrame({**{f"k{i}": [k] * len(news) for i, k in enumerate(key)}, "event": [e for _, e, _ in news], "_at": [t for t, _, _ in news]})
        if seen:
            state.update(tuple(list(column) for column in zip(*seen, strict=True)))
            state.setTimeoutTimestamp((seen[-1][0] + span) // 1000 + 1)
        elif state.exists:
            state.remove()

    return watch


def burst_alerts(stream: DataFrame, at: str = "ts", event: str = "event_id", late: str = "1 hour", keys: tuple[str, ...] = ("user_id", "brand"), hours: int = C.BURST_HOURS, least: int = C.BURST_COUNT) -> DataFrame:
    """keys, event, at of the events that the batch form flags, each once, when its burst is full. Events that come later than ``late`` are left out.

    State of a key: at most 2 * (``least`` - 1) events a day, of the days that events still to come can reach.
    """
    rows = stream.withWatermark(at, late).select(*keys, F.col(event).cast("string").alias("event"), F.col(at).alias("_event_time"), F.unix_micros(F.col(at)).alias("_at")).where("_at is not null")
    kinds = [f"k{i} {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]
    told = rows.groupBy(*keys).applyInPandasWithState(_watch(hours * 3_600_000_000, least), ", ".join([*kinds, "event string, _at long"]), "at array<long>, event array<string>, told array<boolean>", "append", "EventTimeTimeout")
    return told.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "event", F.timestamp_micros("_at").alias("at"))


def upsert_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, order: str):
    """A foreachBatch function that merges each batch's last row per key into a table; ``write`` gets the merged table and the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        write(upsert(read(), last, key, replace=True), number)

    return run
