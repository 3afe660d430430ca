"""State tables of a stream in storage: one folder per batch, bucketed by session, compacted now and then.

A batch sees what earlier batches wrote, and of that only the buckets of its
own sessions.  Its own rows go to a folder named by its number, so a replay
overwrites them.  Compacting writes all rows up to a batch into one base; the
folders behind the base before it are removed, so a batch that is replayed
after a failure still finds the state it started from.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.session import exists, folders, remove

BUCKETS = 64


def bucket_of(session: Column | str) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class BatchTable:
    """A table ``root``/batch_id=N/bucket=K with bases ``root``/base/upto=N/bucket=K; ``schema`` is that of its rows."""

    root: str
    schema: str

    def _numbers(self, spark: SparkSession, folder: str, prefix: str) -> list[int]:
        names = folders(spark, folder)
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and exists(spark, f"{folder}/{n}/_SUCCESS"))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Rows of one batch; they need ``session_id``."""
        (rows.withColumn("bucket", bucket_of("session_id")).repartition("bucket").write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{self.root}/batch_id={batch_id}"))

    def read(self, spark: SparkSession, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of batches before one (of all), with ``batch_id``; only the named buckets are read."""
        bases = [n for n in self._numbers(spark, f"{self.root}/base", "upto=") if before is None or n < before]
        newest = bases[-1] if bases else None
        batches = [n for n in self._numbers(spark, self.root, "batch_id=") if (before is None or n < before) and (newest is None or n > newest)]
        names = [c.strip().split()[0] for c in _fields(self.schema)]
        out = spark.createDataFrame([], f"{self.schema}, batch_id bigint")
        if newest is not None:
            rows = spark.read.schema(f"{self.schema}, batch_id bigint, bucket int").parquet(f"{self.root}/base/upto={newest}")
            out = out.unionByName((rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*names, "batch_id"))
        if batches:
            rows = (spark.read.schema(f"{self.schema}, batch_id bigint, bucket int").option("basePath", self.root)
                    .parquet(*[f"{self.root}/batch_id={n}" for n in batches]))
            out = out.unionByName((rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*names, "batch_id"))
        return out

    def compact(self, spark: SparkSession, upto: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Write all rows up to a batch, less what ``keep`` drops, as the new base, and remove what no replay needs."""
        bases = [n for n in self._numbers(spark, f"{self.root}/base", "upto=") if n < upto]
        rows = keep(self.read(spark, upto + 1)).withColumn("bucket", bucket_of("session_id"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "session_id").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.root}/base/upto={upto}")
        for n in bases[:-1]:
            remove(spark, f"{self.root}/base/upto={n}")
        for n in self._numbers(spark, self.root, "batch_id="):
            if bases and n <= bases[-1]:
                remove(spark, f"{self.root}/batch_id={n}")


def _fields(schema: str) -> list[str]:
    """The top-level fields of a DDL text."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


class PackedMap:
    """A map of a stateful processor in one value: a table of keys and values in Arrow's form.

    Every call to the state is a round trip to the JVM that may wait for tens of
    milliseconds, so a part's entries are read in one and written in one.
    """

    def __init__(self, handle, name: str, schema: pa.Schema, keys: int):
        self.state, self.schema, self.keys = handle.getValueState(name, "packed binary"), schema, keys

    def load(self) -> dict[tuple, tuple]:
        held = self.state.get()
        if held is None or held[0] is None:
            return {}
        columns = [c.to_pylist() for c in pa.ipc.open_stream(bytes(held[0])).read_all().columns]
        return dict(zip(zip(*columns[: self.keys], strict=True), zip(*columns[self.keys :], strict=True), strict=True))

    def save(self, entries: dict[tuple, tuple]) -> None:
        rows = [(*k, *v) for k, v in entries.items()]
        columns = zip(*rows, strict=True) if rows else [()] * len(self.schema)
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as out:
            out.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))
