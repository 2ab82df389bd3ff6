"""Structured Streaming forms of settlement, tagging and event counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.regions import RegionCover, assign_regions

_DONE = "employee_id bigint, active_id bigint, reward double, xp bigint, completed_us bigint"
_PENDING = "active_id bigint, reward double, xp bigint, due_us bigint"


class _Settle(StatefulProcessor):
    """Holds an employee's running jobs until their times come.

    Times are microseconds since the epoch, so the session's time zone, in
    which pandas shows timestamps, plays no part. There is always a timer at
    the earliest due time held; calls to the state cost far more than rows,
    so there is one timer for all jobs that arrive or stay together.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)

    def _wake(self, jobs: list[tuple]) -> None:
        # Timers count in ms; round up so none fires early.
        self.handle.registerTimer(-(-min(due for *_, due in jobs) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            jobs = [
                (int(active), float(reward), int(xp), int(start_us) + round(float(duration_s) * 1_000_000))
                for active, start_us, duration_s, reward, xp in zip(
                    df["active_id"], df["start_us"], df["duration_s"], df["reward"], df["xp"], strict=True)
            ]
            if jobs:
                self.pending.appendList(jobs)
                self._wake(jobs)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        done, held = [], []
        for job in self.pending.get():
            due_ms = -(-job[3] // 1000)
            (done if due_ms <= fired or due_ms < now else held).append(tuple(job))
        if not done:
            return
        if held:
            self.pending.put(held)
            self._wake(held)
        else:
            self.pending.clear()
        df = pd.DataFrame(done, columns=["active_id", "reward", "xp", "completed_us"])
        df.insert(0, "employee_id", key[0])
        yield df

    def close(self) -> None:
        pass


def settle_stream(starts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Completion rows at start + duration from a stream of job starts.

    ``starts``: employee_id, active_id, start_time, duration_s, reward, xp. A
    start that arrives twice counts once; one below the watermark is dropped
    and counted, see ``late_rows``.
    """
    marked = starts.withWatermark("start_time", delay).dropDuplicatesWithinWatermark(["active_id"])
    timed = marked.withColumn("start_us", F.unix_micros("start_time"))
    done = timed.groupBy("employee_id").transformWithStateInPandas(
        statefulProcessor=_Settle(), outputStructType=_struct(_DONE), outputMode="Append", timeMode="EventTime",
    )
    return done.select("employee_id", "active_id", "reward", "xp", F.timestamp_micros("completed_us").alias("completed_at"))


def late_rows(query) -> int:
    """Rows a streaming query has dropped as later than its watermark."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"][-1:])


def _struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def tag_stream(points: DataFrame, cover: RegionCover, predicate: str = "covers", **kw) -> DataFrame:
    """Region of each arriving point, by a stream-static join with the cover."""
    return assign_regions(points, cover, predicate=predicate, **kw)


def windowed_counts(
    events: DataFrame, size: str = "1 hour", slide: str | None = None, gap: str | None = None,
    time: str = "ts", key: str = "event_type", delay: str = "1 hour",
) -> DataFrame:
    """Events per key and window: tumbling, sliding, or session with ``gap``."""
    source = events.withWatermark(time, delay) if events.isStreaming else events
    span = F.session_window(time, gap) if gap else F.window(time, size, slide) if slide else F.window(time, size)
    return source.groupBy(span.alias("w"), key).agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "events", "value")
