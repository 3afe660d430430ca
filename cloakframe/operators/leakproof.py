"""Search of secret values in texts: every (text, value) where the value occurs, exactly.

Texts and values meet by scope (a session, or everything).  How finely a scope
is dealt out is read from the data: its values are parted by hash so that a
part's index fits a task, and its texts are salted so that no task reads much
more than ``SHARE`` bytes.  A task streams: the values of a part come first,
then the texts.  One pass takes the eight bytes at every place of a text as a
number, masks it to the lengths that occur, and asks a bit table sized to the
part, then the sorted beginnings.  What is left is looked up among the sorted
values: all values that begin a text's rest are prefixes of its predecessor in
that order, so the cost does not grow with the values that share a beginning.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.session import materialize

PART = 1 << 18             # values of a scope that one index holds
SHARE = 64 << 20           # bytes of text of a scope that one task reads
RUN = 1 << 20              # places looked at together
FEW = 64                   # pairs of a text and a value that are compared without an index
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Index:
    """Values of one part, ready to be found in a run of UTF-8 bytes."""

    def __init__(self, values: list[bytes]):
        owners: dict[bytes, list[int]] = {}
        for i, value in enumerate(values):
            owners.setdefault(value, []).append(i)
        owners.pop(b"", None)
        self.values = sorted(owners)
        self.owners = [owners[v] for v in self.values]
        self.longest = max(map(len, self.values), default=0)
        # The longest other value that begins each value.
        self.parent, chain = [], []
        for i, value in enumerate(self.values):
            while chain and not value.startswith(self.values[chain[-1]]):
                chain.pop()
            self.parent.append(chain[-1] if chain else -1)
            chain.append(i)
        self.heads = {}
        for size in {min(len(v), 8) for v in self.values}:
            heads = np.unique(np.array([int.from_bytes(v[:8], "little") for v in self.values if min(len(v), 8) == size], np.uint64))
            bits = max(10, int(16 * len(heads)).bit_length())
            table = np.zeros(1 << bits, bool)
            table[(heads * _MIX) >> np.uint64(64 - bits)] = True
            self.heads[size] = (heads, np.uint64(64 - bits), table)

    def places(self, body: np.ndarray) -> np.ndarray:
        """Places at which the beginning of some value stands."""
        out = []
        padded = np.concatenate([body, np.zeros(8, np.uint8)])
        for lo in range(0, len(body), RUN):
            hi = min(lo + RUN, len(body))
            eight = np.zeros(hi - lo, np.uint64)
            for k in range(8):
                eight |= padded[lo + k : hi + k].astype(np.uint64) << np.uint64(8 * k)
            hit = np.zeros(hi - lo, bool)
            for size, (heads, shift, table) in self.heads.items():
                head = eight if size == 8 else eight & np.uint64((1 << 8 * size) - 1)
                maybe = np.flatnonzero(table[(head * _MIX) >> shift])
                at = np.minimum(np.searchsorted(heads, head[maybe]), len(heads) - 1)
                hit[maybe[heads[at] == head[maybe]]] = True
            out.append(np.flatnonzero(hit) + lo)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def find(self, body: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(text, value number) for texts that end at ``ends`` in ``body``."""
        found: set[tuple[int, int]] = set()
        if not self.values:
            return found
        places = self.places(body)
        raw, rows = body.tobytes(), np.searchsorted(ends, places, side="right")
        for at, row, end in zip(places.tolist(), rows.tolist(), ends[rows].tolist(), strict=True):
            rest = raw[at : min(end, at + self.longest)]
            i = bisect_right(self.values, rest) - 1
            while i >= 0:
                if rest.startswith(self.values[i]):
                    found.update((row, owner) for owner in self.owners[i])
                i = self.parent[i]
        return found


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of plain texts and where each ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return body, offsets[1:] - offsets[0]


def _searching(n_keys: int, n_tags: int):
    """Streams groups (scope, part, salt): values first (kind 0), then the texts (kind 1).

    A group with few texts and values that lies in one batch gets no index, and
    what is found in all such groups of a batch goes out together.
    """

    def run(batches):
        group, values, tags, index = None, [], [], None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            heads = [batch.column(k).to_pylist() for k in range(3)]
            kinds = batch.column(3).to_numpy(zero_copy_only=False)
            change = [0] + [i for i in range(1, n) if kinds[i] != kinds[i - 1] or any(h[i] != h[i - 1] for h in heads)] + [n]
            bodies = batch.column(4)
            keys = [batch.column(5 + k) for k in range(n_keys)]
            marks = [batch.column(5 + n_keys + k) for k in range(n_tags)]
            begun, near_rows, near_marks = 0, [], []
            names = [batch.schema.field(5 + k).name for k in range(n_keys + n_tags)]
            inside = False  # whether the group began in this batch
            for lo, hi in zip(change, change[1:]):
                here = tuple(h[lo] for h in heads)
                if here != group:
                    group, values, tags, index, inside, begun = here, [], [], None, True, lo
                if kinds[lo] == 0:
                    values += bodies.slice(lo, hi - lo).to_pylist()
                    tags.append((marks, lo, hi))
                    continue
                if not values:
                    continue
                if inside and index is None and len(values) * (hi - lo) <= FEW:
                    for row, text in enumerate(bodies.slice(lo, hi - lo).to_pylist(), lo):
                        for mark, value in enumerate(values, begun):
                            if text and value and value in text:
                                near_rows.append(row)
                                near_marks.append(mark)
                    continue
                if index is None:
                    index = Index([v.encode() for v in values])
                    tags = [[m.slice(first, end - first) for m in marks_] for marks_, first, end in tags]
                    tags = [pa.concat_arrays([t[k] for t in tags]) for k in range(n_tags)]
                found = sorted(index.find(*_bytes_of(bodies.slice(lo, hi - lo))))
                if found:
                    rows, owners = pa.array([lo + r for r, _ in found]), pa.array([o for _, o in found])
                    yield pa.RecordBatch.from_arrays([*[k.take(rows) for k in keys], *[t.take(owners) for t in tags]], names=names)
            if near_rows:
                rows, owners = pa.array(near_rows), pa.array(near_marks)
                yield pa.RecordBatch.from_arrays([*[k.take(rows) for k in keys], *[m.take(owners) for m in marks]], names=names)

    return run


def occurrences(texts: DataFrame, secrets: DataFrame, keys: list[str], tags: list[str], part: int = PART,
                share: int = SHARE) -> DataFrame:
    """(keys..., tags...) of every text and secret of one scope where the secret's value occurs in the text.

    ``texts`` has ``_scope``, ``_out`` and the key columns, ``secrets`` has
    ``_scope``, ``_value`` and the tag columns.  The texts are stored once; of
    them only the sizes are read to deal them out.  The table of scopes that
    are dealt finer has at most one row per ``part`` values or ``share`` bytes
    and is broadcast.
    """
    texts = materialize(texts.select("_scope", "_out", *keys, F.octet_length("_out").alias("_bytes")))
    secrets = materialize(secrets.select("_scope", "_value", *tags))
    many = (secrets.groupBy("_scope").agg(F.ceil(F.count("*") / part).cast("int").alias("_parts"))
            .where("_parts > 1").withColumn("_salts", F.lit(1)))
    much = (texts.groupBy("_scope").agg(F.ceil(F.sum("_bytes") / share).cast("int").alias("_salts"))
            .where("_salts > 1").withColumn("_parts", F.lit(1)))
    big = many.unionByName(much).groupBy("_scope").agg(F.max("_parts").alias("_parts"), F.max("_salts").alias("_salts"))
    big = F.broadcast(materialize(big))
    parts, salts = F.coalesce("_parts", F.lit(1)), F.coalesce("_salts", F.lit(1))
    left = texts.join(big, "_scope", "left").select(
        "_scope", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), F.pmod(F.xxhash64(*keys), salts).cast("int").alias("_salt"),
        F.lit(1).alias("_kind"), F.col("_out").alias("_body"), *keys)
    right = secrets.join(big, "_scope", "left").select(
        "_scope", F.pmod(F.xxhash64("_value"), parts).cast("int").alias("_part"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"),
        F.lit(0).alias("_kind"), F.col("_value").alias("_body"), *tags)
    both = left.unionByName(right, allowMissingColumns=True)
    group = ["_scope", "_part", "_salt"]
    dealt = both.repartition(*group).sortWithinPartitions(*group, "_kind").select(*group, "_kind", "_body", *keys, *tags)
    types = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    return dealt.mapInArrow(_searching(len(keys), len(tags)), ", ".join(f"`{c}` {types[c]}" for c in (*keys, *tags)))
