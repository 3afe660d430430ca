"""Packing token streams into training windows: bounded-space online best fit.

Every partition keeps a fixed number of open windows.  A piece goes to the open
window that it fills best; when none has room and all are taken, the fullest is
topped up with the front of the piece and emitted, and the rest is placed anew.
What is left open at the end of a partition is merged in rounds, a fixed number
of partitions at a time, and the last open windows are joined end to end.

Defined cases: a null or empty text is its end token alone.  A text longer than
a window is cut into full windows and a rest.  Repeated rows are packed once
each.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cloakframe.llm.common import stored
from cloakframe.llm.tokens import encoder

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open int, ids binary"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.int32()), ("ids", pa.binary()),
])


class Packer:
    """Best-fit packing with at most ``most_open`` open windows; ``emit`` gets (piece, sequence, offset)."""

    def __init__(self, window: int, most_open: int, base: int, emit: Callable):
        self.window, self.most_open, self.next, self.emit = window, most_open, base, emit
        self.free: list[tuple[int, int]] = []  # (free ids, window), ascending
        self.held: dict[int, list[tuple]] = {}  # window: its pieces, until it closes

    def sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _close(self, w: int) -> None:
        at = 0
        for piece in self.held.pop(w):
            self.emit(piece, w, at)
            at += len(piece[3])

    def put(self, doc: int | None, start: int, total: int, ids: np.ndarray) -> None:
        while True:
            n = len(ids)
            if n == self.window:
                self.emit((doc, start, total, ids), self.sequence(), 0)
                return
            k = bisect_left(self.free, (n, -1))
            if k < len(self.free):
                free, w = self.free.pop(k)
                self.held[w].append((doc, start, total, ids))
                if free == n:
                    self._close(w)
                else:
                    insort(self.free, (free - n, w))
                return
            if len(self.free) < self.most_open:
                w = self.sequence()
                self.held[w] = [(doc, start, total, ids)]
                insort(self.free, (self.window - n, w))
                return
            free, w = self.free.pop(0)
            self.held[w].append((doc, start, total, ids[:free]))
            self._close(w)
            start, ids = start + free, ids[free:]

    def leftovers(self) -> list[tuple]:
        out = [p for _, w in self.free for p in self.held[w]]
        self.free, self.held = [], {}
        return out

    def finish(self) -> None:
        """Join all open windows end to end; the last, partial one is split by powers of two, which need no padding."""
        pieces: list[tuple] = []

        def flush() -> None:
            n, at = self.sequence(), 0
            for p in pieces:
                self.emit(p, n, at)
                at += len(p[3])
            pieces.clear()

        rest = self.leftovers()
        left = sum(len(p[3]) for p in rest)
        room = 0
        for doc, start, total, ids in rest:
            while len(ids):
                if not room:
                    if pieces:
                        flush()
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                k = min(room, len(ids))
                pieces.append((doc, start, total, ids[:k]))
                start, ids, room, left = start + k, ids[k:], room - k, left - k
        if pieces:
            flush()


class _Rows:
    """Output rows of one task; an open piece carries its ids, and the task's number in sequence_id."""

    def __init__(self, task: int):
        self.task, self.rows = task, []

    def closed(self, piece: tuple, sequence: int, offset: int) -> None:
        doc, start, total, ids = piece
        self.rows.append((doc, start, len(ids), zlib.crc32(ids), total, sequence, offset, 0, None))

    def left(self, piece: tuple) -> None:
        doc, start, total, ids = piece
        self.rows.append((doc, start, len(ids), 0, total, self.task, 0, 1, ids.tobytes()))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _packing(path: str, end_id: int, window: int, most_open: int):
    def run(batches):
        task = TaskContext.get().partitionId()
        out = _Rows(task)
        code = encoder(path, False)
        packer = Packer(window, most_open, task << 28, out.closed)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for lo, hi, ids, at in code.encode(batch.column("text")):
                for k in range(hi - lo):
                    doc, n = ids_of[lo + k], int(at[k + 1] - at[k])
                    body, total, cut = ids[at[k] : at[k + 1]], n + 1, 0
                    while total - cut > window:
                        out.closed((doc, cut, total, body[cut : cut + window]), packer.sequence(), 0)
                        cut += window
                    packer.put(doc, cut, total, np.concatenate([body[cut:], end]))
                yield out.batch()
        for piece in packer.leftovers():
            out.left(piece)
        yield out.batch()

    return run


def _merging(window: int, most_open: int, level: int, last: bool):
    def run(key, pieces):
        group = key[0].as_py()
        out = _Rows(group)
        packer = Packer(window, most_open, (level << 60) + (group << 28), out.closed)
        pieces = pieces.sort_by([(c, "ascending") for c in ("sequence_id", "doc_id", "start", "length", "ids")])
        for doc, start, total, ids in zip(*(pieces[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
            packer.put(doc, start, total, np.frombuffer(ids, np.uint32))
        if last:
            packer.finish()
        for piece in packer.leftovers():
            out.left(piece)
        return pa.Table.from_batches([out.batch()])

    return run


def pack(
    docs: DataFrame, path: str, end_id: int = 0, window: int = 1024, most_open: int = 64, fan_in: int = 64
) -> DataFrame:
    """Pieces of all documents and their places in windows of at most ``window`` ids.

    One scan tokenizes and packs; each partition leaves fewer than ``most_open``
    open windows.  Those are merged ``fan_in`` partitions to a task, in as many
    rounds as it takes, so no task holds more than fan_in * most_open windows.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_packing(path, end_id, window, most_open), PIECES)
    level, n = stored(rows), 0
    done = [level.where("open = 0")]
    while (tasks := level.where("open = 1").agg(F.max("sequence_id")).first()[0]) is not None:
        n += 1
        groups = level.where("open = 1").groupBy(F.floor(F.col("sequence_id") / fan_in))
        level = stored(groups.applyInArrow(_merging(window, most_open, n, tasks < fan_in), PIECES))
        done.append(level.where("open = 0"))
    return reduce(DataFrame.unionByName, done).drop("open", "ids")
