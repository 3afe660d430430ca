"""Message and activity streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from cloakframe.operators.messages import parse_messages, route, split_valid
from cloakframe.streaming.store import PackedMap


def fan_out(raw: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]],
            dead_letters: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Validate a stream of JSON lines and hand each route to its handler.

    A message no handler is named for goes to the dead letters, like one that
    cannot be read.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        valid, bad = split_valid(parse_messages(batch))
        routed = route(valid)
        for name, handle in handlers.items():
            handle(routed.where(F.col("route") == name), batch_id)
        lost = routed.where(~F.col("route").isin(list(handlers)))
        dead_letters(bad.unionByName(
            lost.drop("route").withColumn("code", F.lit("UNKNOWN_TYPE"))), batch_id)

    return raw.writeStream.foreachBatch(process)


PARTS = 128


class BurstProcessor(StatefulProcessor):
    """Bursts of the keys of one part, closed after a quiet period and cut at a hard limit.

    Events wait, as counts per time, until the watermark has passed them, so
    they are taken in order whatever the order they come in.  The part has one
    timer, set to the first time at which something can happen to one of its
    keys: an event that becomes safe, the quiet period over, or the limit reached.
    """

    def __init__(self, quiet_us: int, cap_us: int):
        self.quiet, self.cap = quiet_us, cap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ["burst", "start", "last", "piece", "first", "n", "due_ms"]
        self.bursts = PackedMap(handle, "bursts", pa.schema([("key", pa.string()), *((f, pa.int64()) for f in fields), ("waiting", pa.binary())]), 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat([r[["key", "ts"]] for r in rows], ignore_index=True)
        events["ts"] = events["ts"].astype("datetime64[us]").astype("int64")
        counts = events.groupby(["key", "ts"], dropna=False, sort=True).size().reset_index(name="n")
        names, times = counts["key"].to_numpy(object), counts[["ts", "n"]].to_numpy(np.int64)
        cut = [0, *(np.flatnonzero(counts["key"].ne(counts["key"].shift()).to_numpy()[1:]) + 1).tolist(), len(counts)]
        work = {(None if pd.isna(names[lo]) else names[lo],): times[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)}
        yield self._advance(self.bursts.load(), work, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        entries = self.bursts.load()
        due = {name: np.empty((0, 2), np.int64) for name, held in entries.items() if held[6] is not None and held[6] < now}
        yield self._advance(entries, due, timerValues.getCurrentWatermarkInMs())

    def _advance(self, entries: dict[tuple, tuple], work: dict[tuple, np.ndarray], watermark_ms: int) -> pd.DataFrame:
        """Take the safe events of some keys; ``work`` holds their new times and counts."""
        done = []
        for name, new in work.items():
            *state, _, packed = entries.get(name, (0, None, None, 0, None, 0, None, b""))
            waiting = np.concatenate([np.frombuffer(packed, np.int64).reshape(-1, 2), new])
            waiting = waiting[np.argsort(waiting[:, 0], kind="stable")]
            safe = int(np.searchsorted(waiting[:, 0], watermark_ms * 1000))
            due = self._take(name[0], state, waiting[:safe].tolist(), waiting[safe:], watermark_ms * 1000, done)
            entries[name] = (*state, due, waiting[safe:].tobytes())
        self.bursts.save(entries)
        wake = [held[6] for held in entries.values() if held[6] is not None]
        timers = list(self.handle.listTimers())
        if timers != ([min(wake)] if wake else []):
            for timer in timers:
                self.handle.deleteTimer(timer)
            if wake:
                self.handle.registerTimer(min(wake))
        table = pd.DataFrame(done, columns=["key", "burst", "piece", "started_at", "last_event_at", "n_events"])
        for column in ("started_at", "last_event_at"):
            table[column] = pd.to_datetime(table[column], unit="us").astype("datetime64[ns]")
        return table

    def _take(self, key: str, state: list, safe: list, later: np.ndarray, watermark: int, done: list) -> int | None:
        """Fold safe events into the open burst ``state``; returns when to look again, in milliseconds."""
        burst, start, last, piece, first, n = state

        def emit():
            nonlocal n
            if n:
                done.append((key, burst, piece, first, last, n))
            n = 0

        for at, count in safe:
            if last is None or at - last > self.quiet:
                emit()
                burst, start, piece, first = burst + 1, at, 0, at
            elif (at - start) // self.cap != piece:
                emit()
                piece, first = (at - start) // self.cap, at
            elif not n:
                first = at
            last, n = at, n + count
        if last is not None and (watermark > last + self.quiet or watermark >= start + (piece + 1) * self.cap):
            emit()
        state[:] = burst, start, last, piece, first, n
        times = [int(later[0, 0])] if len(later) else []
        if n:
            times.append(min(last + self.quiet, start + (piece + 1) * self.cap))
        return min(times) // 1000 + 1 if times else None

    def close(self) -> None:
        pass


def settled_bursts(events: DataFrame, quiet_s: float = 0.3, cap_s: float = 3.0, late: str = "3 seconds",
                   key: str = "session_id", parts: int = PARTS) -> DataFrame:
    """Bursts of change events per key: closed after a quiet period, cut every ``cap_s`` seconds from their start."""
    rows = events.select(F.col(key).cast("string").alias("key"), "ts").withWatermark("ts", late)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    out = rows.groupBy("part").transformWithStateInPandas(
        statefulProcessor=BurstProcessor(round(quiet_s * 1e6), round(cap_s * 1e6)),
        outputStructType="key string, burst bigint, piece bigint, started_at timestamp, last_event_at timestamp, n_events bigint",
        outputMode="Append", timeMode="EventTime")
    return out.withColumnRenamed("key", key)
