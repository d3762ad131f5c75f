"""Sessions, duplicates and labelled segments over event streams, with late data bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late) if events.isStreaming else events


def sessions(events: DataFrame, keys: Sequence[str], ts: str = "ts", v: str = "v", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """keys, session_start, session_end (gap included), n, mean, first and last value of runs of events less than ``gap`` apart.

    Works on batch and streaming input.  State is one partial aggregate per open session: sessions that a late event
    joins are merged, and a session leaves once the watermark passes its end.
    """
    rows = _timed(events, ts, late)
    out = rows.groupBy(*keys, F.session_window(ts, gap)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.min_by(v, ts).alias("first"), F.max_by(v, ts).alias("last"))
    return out.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", "mean", "first", "last")


def distinct_events(events: DataFrame, identity: Sequence[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each identity; on a stream an identity is held until the watermark passes, then forgotten."""
    rows = _timed(events, ts, late)
    return rows.dropDuplicatesWithinWatermark(list(identity)) if rows.isStreaming else rows.dropDuplicates(list(identity))


SEGMENTS = "start timestamp, end timestamp, status string"


class _Segments(StatefulProcessor):
    """Marks wait in the state until the watermark passes them, then they are read in order of time."""

    def __init__(self, names: list[str], start: str, end: str, timeout_ms: int):
        self.names, self.start, self.end, self.timeout = names, start, end, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, mark string")
        self.open = handle.getValueState("open", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            marks = [(int(t.value // 1_000_000), m) for t, m in zip(pd.to_datetime(f["ts"]), f["mark"])]
            for ms, mark in marks:
                self.waiting.appendValue((ms, mark))
                self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((int(ms), mark) for ms, mark in self.waiting.get()) if self.waiting.exists() else []
        due, later = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        start = int(self.open.get()[0]) if self.open.exists() else None
        out = []
        for ms, mark in due:
            if start is not None and ms - start > self.timeout:
                out.append((start, None, "timed_out"))
                start = None
            if mark == self.start:
                if start is not None:
                    out.append((start, None, "replaced"))
                start = ms
            elif mark == self.end and start is not None:
                out.append((start, ms, "closed"))
                start = None
        if start is not None and now - start > self.timeout and not any(ms - start <= self.timeout for ms, _ in later):
            out.append((start, None, "timed_out"))
            start = None
        if start is None:
            self.open.clear()
        else:
            self.open.update((start,))
            self.handle.registerTimer(start + self.timeout + 1)
        if not out:
            return
        frame = pd.DataFrame({**{n: [k] * len(out) for n, k in zip(self.names, key)}, "start": [x[0] for x in out], "end": [x[1] for x in out], "status": [x[2] for x in out]})
        frame["start"], frame["end"] = pd.to_datetime(frame["start"], unit="ms"), pd.to_datetime(frame["end"], unit="ms")
        yield frame

    def close(self) -> None:
        pass


def stream_segments(events: DataFrame, keys: Sequence[str], ts: str, mark: str, start: str, end: str, timeout_s: float, late: str = "10 seconds") -> DataFrame:
    """Segments between start and end marks of a stream: keys, start, end, status (closed, replaced or timed_out).

    A start opens a segment, the next end within ``timeout_s`` closes it; a second start replaces it, and one that stays
    open times out with a null end, by a timer even if the key sends nothing more.  Ends without a start are left out.
    Marks are read in order of time (milliseconds), late ones within ``late`` included, and of equal times by name.
    Needs the RocksDB state store.
    """
    rows = _timed(events, ts, late).select(*keys, F.col(ts).alias("ts"), F.col(mark).alias("mark")).where(F.col("mark").isin(start, end))
    kinds = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    processor = _Segments(list(keys), start, end, int(timeout_s * 1000))
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"{kinds}, {SEGMENTS}", outputMode="append", timeMode="EventTime")


def batch_segments(events: DataFrame, keys: Sequence[str], ts: str, mark: str, start: str, end: str, timeout_s: float, target_rows: int = 1_000_000) -> DataFrame:
    """What ``stream_segments`` finds, from a finished table: each start looks at the next mark of its key."""
    from strideframe.operators.ordered import adjacent_pairs

    ms = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000)
    rows = events.where(F.col(mark).isin(start, end)).select(*keys, ms.alias("ms"), F.col(mark).alias("mark"))
    pairs = adjacent_pairs(rows, keys, "ms", ["mark"], target_rows=target_rows, with_last=True)
    at, then = F.col("prev.ms"), F.col("cur.ms")
    soon = then.isNotNull() & (then - at <= int(timeout_s * 1000))
    status = F.when(soon & (F.col("cur.mark") == end), "closed").when(soon, "replaced").otherwise("timed_out")
    return pairs.where(F.col("prev.mark") == start).select(
        *keys, F.timestamp_millis(at).alias("start"), F.when(soon & (F.col("cur.mark") == end), F.timestamp_millis(then)).alias("end"), status.alias("status"))
