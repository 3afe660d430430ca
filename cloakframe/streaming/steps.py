"""Step tracking as a stateful stream, a batch of events at a time.

A session's steps are dealt to buckets, each with its own state, so a busy
session is not one task's work; what concerns the whole session (pause, resume,
stop, close) is sent to every bucket.  Buckets are dealt to parts by hash, and a
part's sessions are worked on together.  An event is a map from what a step may
be to what it becomes.  The maps of a step's events are composed by doubling,
for all steps of a part together, so the work is a few array operations per
part and batch however the events are spread over sessions and steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cloakframe.functions import constants as K
from cloakframe.streaming.store import PackedMap

OUTPUT = ("session_id string, step_id int, ts timestamp, seq bigint, op string, state string, "
          "attempts int, accepted boolean, code string")
BUCKETS = 8
PARTS = 128
CONTROLS = ("pause", "resume", "stop", "close")
STATES = list(K.STEP_TRANSITIONS)
#: What a step without a record is: in a session that runs, and in one that was stopped.
ABSENT, ABSENT_STOPPED = len(STATES), len(STATES) + 1
OPS = ["run", "success", "fail", "block", "retry", "fallback", "approve", "deny", "skip", "plan", "?"]
_NUMBER = {op: k for k, op in enumerate(OPS)}
_TARGETS = {"run": "RUNNING", "success": "SUCCESS", "fail": "FAILED", "block": "BLOCKED_APPROVAL",
            "fallback": "HYBRID_FALLBACK", "deny": "CANCELLED", "skip": "SKIPPED"}
#: What lies between a step's events: nothing, a stop, a close, a close and then a stop.
NOTHING, STOP, CLOSE, CLOSE_STOP = range(4)


class Maps:
    """Maps over (state, attempts up to the limit), numbered state * width + attempts, per (op, what lies before)."""

    def __init__(self, max_retries: int):
        self.width = max_retries + 1
        n = (len(STATES) + 2) * self.width
        self.between = np.array([[self._between(c, pre) for c in range(n)] for pre in range(4)], np.int16)
        after = np.zeros((len(OPS), n), np.int16)
        accepted, ran = np.zeros((len(OPS), n), bool), np.zeros((len(OPS), n), bool)
        for k, op in enumerate(OPS):
            for c in range(n):
                after[k, c], accepted[k, c], ran[k, c] = self._event(op, c, max_retries)
        pick = lambda table: np.stack([table[:, self.between[pre]] for pre in range(4)], 1).reshape(len(OPS) * 4, n)
        self.after, self.accepted, self.ran = pick(after), pick(accepted), pick(ran)

    def _between(self, c: int, pre: int) -> int:
        state, attempts = divmod(c, self.width)
        if pre in (CLOSE, CLOSE_STOP):
            state, attempts = ABSENT, 0
        if pre in (STOP, CLOSE_STOP):
            if state == ABSENT:
                state = ABSENT_STOPPED
            elif state < len(STATES) and STATES[state] in ("PENDING", "RETRYING"):
                state = STATES.index("CANCELLED")
        return state * self.width + attempts

    def _event(self, op: str, c: int, max_retries: int) -> tuple[int, bool, bool]:
        state, attempts = divmod(c, self.width)
        if op == "plan":
            return STATES.index("PENDING") * self.width, True, False
        now = "PENDING" if state == ABSENT else "CANCELLED" if state == ABSENT_STOPPED else STATES[state]
        target = _TARGETS.get(op)
        if op == "retry":
            target = "HYBRID_FALLBACK" if attempts >= max_retries else "RETRYING"
        elif op == "approve" and now == "BLOCKED_APPROVAL":
            target = "RUNNING"
        ok = target in K.STEP_TRANSITIONS[now]
        ran = ok and target == "RUNNING"
        return STATES.index(target if ok else now) * self.width + min(attempts + ran, max_retries), ok, ran


def fold_events(step: np.ndarray, op: np.ndarray, before: np.ndarray, start: np.ndarray, attempts: np.ndarray, maps: Maps):
    """Outcome of every event; events are sorted by step, then in order.

    ``step`` numbers the steps from 0, ``before`` is what lies between an event
    and the one before it; ``start`` and ``attempts`` are per step.  Returns per
    event the number of (state, attempts), whether it was accepted, and the attempts.
    """
    n, code = len(step), op * 4 + before
    first = np.append(True, step[1:] != step[:-1])
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    composed = maps.after[code]
    d = 1
    while d < n:
        far = np.flatnonzero(np.arange(n) - d >= begin)
        if not len(far):
            break
        composed[far] = np.take_along_axis(composed[far], composed[far - d].astype(np.int64), 1)
        d *= 2
    after = composed[np.arange(n), start[step]]
    was = np.where(first, start[step], np.append(0, after[:-1]))
    ran = maps.ran[code, was]
    total = np.cumsum(ran)
    reset = np.maximum.accumulate(np.where((op == OPS.index("plan")) | (before >= CLOSE), np.arange(n), -1))
    since = np.where(reset >= begin, reset, begin)
    count = total - (total[since] - ran[since]) + np.where(reset >= begin, 0, attempts[step])
    return after, maps.accepted[code, was], count


class StepProcessor(StatefulProcessor):
    """Applies events to the steps of the sessions of one part.

    Ops are those of :mod:`cloakframe.operators.steps`, and ``plan`` (register
    a pending step) and ``close`` (drop the session).  An op the state does not
    allow yields a row with ``accepted`` false and a code; nothing is raised.
    With ``idle_ms`` a session is closed when its events pause for longer; a
    row with the op ``expire`` tells that, once, by a timer or by the next event.
    The state holds one entry per session and bucket, its steps as rows of
    (step, state, attempts, stops seen); a part's entries are stored together.  A part has one timer, set to the
    first of its sessions that may expire.
    """

    def __init__(self, max_retries: int = K.MAX_RETRIES, idle_ms: int | None = None):
        self.max_retries, self.idle_ms = max_retries, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.maps = Maps(self.max_retries)
        fields = [("session_id", pa.string()), ("bucket", pa.int32()), ("stops", pa.int64()), ("last_us", pa.int64()), ("steps", pa.binary())]
        self.sessions = PackedMap(handle, "sessions", pa.schema(fields), 2)

    @staticmethod
    def _stored(entries: dict[tuple, tuple], names: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Whether a session is known, its stops, the time of its last event and its steps."""
        known, stops, last_us = np.zeros(len(names), bool), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        tables = [np.empty((0, 4), np.int32)] * len(names)
        for k, name in enumerate(names):
            if name in entries:
                stops[k], last_us[k], packed = entries[name]
                known[k], tables[k] = True, np.frombuffer(packed, np.int32).reshape(-1, 4)
        return known, stops, last_us, tables

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True)
        events["_key"] = events.groupby(["session_id", "bucket"], dropna=False, sort=False).ngroup()
        events = events.sort_values(["_key", "ts", "seq"], ignore_index=True)
        n, group = len(events), events["_key"].to_numpy()
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        end = np.append(begin[1:], n)  # of each session's events
        heads = events.iloc[begin]
        names = [(None if pd.isna(s) else s, int(b)) for s, b in zip(heads["session_id"], heads["bucket"], strict=True)]
        entries = self.sessions.load()
        known, stops, last_us, tables = self._stored(entries, names)
        at_us = events["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        ops = events["op"].to_numpy()
        closed = np.full(2 * n + 2, -1)  # places: event g stands at 2g + 1, what expires before it at 2g
        stopped = closed.copy()
        expired = []
        if self.idle_ms is not None:
            earlier = np.append(at_us[0], at_us[:-1])
            earlier[begin] = np.where(known, last_us, at_us[begin])
            for g in np.flatnonzero(at_us - earlier > self.idle_ms * 1000).tolist():
                closed[2 * g] = 2 * g
                expired.append((names[group[g]][0], int(earlier[g]) + self.idle_ms * 1000))
        for name, place in (("close", closed), ("stop", stopped)):
            g = np.flatnonzero(ops == name)
            place[2 * g + 1] = 2 * g + 1
        halts = np.flatnonzero(ops == "stop")
        closed, stopped = np.maximum.accumulate(closed), np.maximum.accumulate(stopped)

        def between(place, previous):
            close = closed[place] > previous
            stop = stopped[place] > np.where(close, closed[place], previous)
            return np.where(close, CLOSE, NOTHING) + np.where(stop, STOP, NOTHING)

        control = np.isin(ops, CONTROLS)
        own = np.flatnonzero(~control)
        final_close = np.where(closed[2 * end - 1] >= 2 * begin, closed[2 * end - 1], -1)
        after_close = np.bincount(group[halts[2 * halts + 1 > final_close[group[halts]]]], minlength=len(begin))
        new_stops = np.where(final_close >= 0, 0, stops) + after_close
        sizes = [0 if c >= 0 else len(t) for t, c in zip(tables, final_close.tolist(), strict=True)]
        kept_of = np.repeat(np.arange(len(begin)), sizes)
        kept = np.concatenate([t for t, size in zip(tables, sizes, strict=True) if size] or [np.empty((0, 4), np.int32)])
        if len(own):
            wide = lambda of, step: (of.astype(np.int64) << 32) + (step.astype(np.int64) & 0xFFFFFFFF)
            ids, numbers = np.unique(wide(group[own], events["step_id"].fillna(-1).to_numpy()[own]), return_inverse=True)
            held = np.concatenate([t for t in tables]).astype(np.int64)
            held_ids = wide(np.repeat(np.arange(len(begin)), [len(t) for t in tables]), held[:, 0])
            of = ids >> 32
            start, attempts = np.where(stops[of] > 0, ABSENT_STOPPED, ABSENT) * self.maps.width, np.zeros(len(ids), np.int64)
            _, at_new, at_old = np.intersect1d(ids, held_ids, assume_unique=True, return_indices=True)
            _, state, tries, seen = held[at_old].T
            attempts[at_new] = tries
            start[at_new] = self.maps.between[np.where(seen < stops[of[at_new]], STOP, NOTHING), state * self.maps.width + np.minimum(tries, self.max_retries)]
            order = np.argsort(numbers, kind="stable")
            g, step = own[order], numbers[order]
            place = 2 * g + 1
            previous = np.where(np.append(True, step[1:] != step[:-1]), 2 * begin[group[g]] - 1, np.append(0, place[:-1]))
            op = np.array([_NUMBER.get(o, _NUMBER["?"]) for o in ops[g]])
            after, accepted, count = fold_events(step, op, between(place, previous), start, attempts, self.maps)
            rows_ = events.iloc[g]
            approve, deny = op == _NUMBER["approve"], op == _NUMBER["deny"]
            code = np.where(accepted, np.where(deny, "APPROVAL_DENIED", None), np.where(approve, "INVALID_APPROVAL", "INVALID_TRANSITION"))
            yield self._table({
                "session_id": rows_["session_id"].to_numpy(), "step_id": rows_["step_id"].to_numpy(), "ts": rows_["ts"].to_numpy(), "seq": rows_["seq"].to_numpy(),
                "op": rows_["op"].to_numpy(), "state": np.array(STATES, object)[after // self.maps.width], "attempts": count, "accepted": accepted, "code": code})
            last = np.flatnonzero(np.append(step[1:] != step[:-1], True))
            of, finish = group[g[last]], 2 * end[group[g[last]]] - 1
            final = self.maps.between[between(finish, place[last]), after[last]]
            stay = closed[finish] <= place[last]
            touched = np.stack([ids & 0xFFFFFFFF, final // self.maps.width, count[last], new_stops[of]], 1).astype(np.uint32).view(np.int32)
            rest = ~np.isin(wide(kept_of, kept[:, 0]), ids)
            kept_of, kept = np.append(kept_of[rest], of[stay]), np.concatenate([kept[rest], touched[stay]])
        order = np.argsort(kept_of, kind="stable")
        kept = np.ascontiguousarray(kept[order], np.int32)
        cut = np.searchsorted(kept_of[order], np.arange(len(begin) + 1))
        newest = np.where(known, np.maximum(last_us, at_us[end - 1]), at_us[end - 1])
        for k, name in enumerate(names):
            entries[name] = int(new_stops[k]), int(newest[k]), kept[cut[k] : cut[k + 1]].tobytes()
        self.sessions.save(entries)
        told = events[control & (events["bucket"].to_numpy() == 0)]
        if len(told):
            none = np.full(len(told), None)
            yield self._table({"session_id": told["session_id"].to_numpy(), "step_id": none, "ts": told["ts"].to_numpy(), "seq": told["seq"].to_numpy(),
                               "op": told["op"].to_numpy(), "state": none, "attempts": none, "accepted": np.full(len(told), True), "code": none})
        if expired:
            yield self._expiries(expired)
        if self.idle_ms is not None:
            self._wake(int(newest.min()) // 1000 + self.idle_ms + 1)

    def _wake(self, at_ms: int) -> None:
        """Set the part's timer, if it is not set to an earlier time."""
        timers = list(self.handle.listTimers())
        if not timers or at_ms < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        entries = self.sessions.load()
        wake = {name: last // 1000 + self.idle_ms + 1 for name, (_, last, _) in entries.items()}
        expired = [(name, entries[name][1]) for name, at_ms in wake.items() if at_ms < now]
        if expired:
            self.sessions.save({name: value for name, value in entries.items() if wake[name] >= now})
        if len(expired) < len(entries):
            self.handle.registerTimer(min(at_ms for at_ms in wake.values() if at_ms >= now))
        if expired:
            yield self._expiries([(name[0], last + self.idle_ms * 1000) for name, last in expired])

    def _expiries(self, gone: list[tuple[str, int]]) -> pd.DataFrame:
        none = np.full(len(gone), None)
        return self._table({"session_id": np.array([s for s, _ in gone], object), "step_id": none, "ts": np.array([us for _, us in gone], "datetime64[us]"),
                            "seq": none, "op": np.full(len(gone), "expire", object), "state": none, "attempts": none, "accepted": np.full(len(gone), True), "code": none})

    @staticmethod
    def _table(columns: dict[str, pd.Series]) -> pd.DataFrame:
        table = pd.DataFrame(columns)
        table["ts"] = pd.to_datetime(table["ts"]).astype("datetime64[ns]")
        for name, kind in (("step_id", "Int32"), ("attempts", "Int32"), ("seq", "Int64"), ("accepted", "boolean")):
            table[name] = table[name].astype(kind)
        return table

    def close(self) -> None:
        pass


def track_steps(events: DataFrame, max_retries: int = K.MAX_RETRIES, idle_ms: int | None = None, late: str = "0 seconds",
                buckets: int = BUCKETS, parts: int = PARTS) -> DataFrame:
    """Outcome row per event of a stream (session_id, step_id, ts, seq, op).

    With ``idle_ms`` a session whose events pause for longer is dropped by
    event time; its state is then kept as one, because every event of it counts.
    """
    buckets = 1 if idle_ms is not None else buckets
    events = events.select("session_id", "step_id", "ts", "seq", "op")
    if idle_ms is not None:
        events = events.withWatermark("ts", late)
    everywhere = F.sequence(F.lit(0), F.lit(buckets - 1))
    where = F.when(F.col("op").isin(*CONTROLS), everywhere).otherwise(F.array(F.coalesce(F.pmod(F.col("step_id"), F.lit(buckets)), F.lit(-1))))
    dealt = events.withColumn("bucket", F.explode(where))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("session_id", "bucket"), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").transformWithStateInPandas(
        statefulProcessor=StepProcessor(max_retries, idle_ms), outputStructType=OUTPUT,
        outputMode="Append", timeMode="EventTime" if idle_ms is not None else "None")
