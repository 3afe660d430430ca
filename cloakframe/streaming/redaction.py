"""Redaction of a snapshot stream with state that outlives its batches.

Three tables in storage, bucketed by session, hold the state: the vault, the
last version of every element with its spans, and the resets of sessions.  A
micro-batch reads the buckets of its own sessions.  Only elements that are new
or differ from their last version are scanned; known values keep their tokens,
new ones are numbered after the highest number of their session and type.

A row whose ``control`` is ``reset`` (or ``close``) starts a new epoch of its
session from its step on: what was stored before it no longer counts, numbers
restart, and nothing is rewritten.  The rows of dead epochs go when the tables
are compacted.  Sessions are spread over tasks by element and value; every
output folder is named by its batch and overwritten on replay, and working
tables of a batch are removed at its end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cloakframe.operators import audit, tokens
from cloakframe.operators.detect import scan_elements
from cloakframe.operators.incremental import mark_versions, scan_versions, version_spans
from cloakframe.schema import SPAN
from cloakframe.session import materialize, scratch
from cloakframe.streaming.store import BUCKETS, BatchTable, bucket_of

VAULT = ("session_id string, token string, type string, value string, token_no bigint, "
         "category string, method string, confidence double, first_step bigint, "
         "element_pos int, element_id string")
CONTROLS = ("reset", "close")
_COLUMNS = [c.split()[0] for c in VAULT.split(", ")]


def _in_epoch(session: Column | str = "session_id", epoch: Column | str = "epoch") -> Column:
    """Session and epoch as one key."""
    return F.concat(F.coalesce(F.col(session) if isinstance(session, str) else session, F.lit("")), F.lit("\u0001"),
                    (F.col(epoch) if isinstance(epoch, str) else epoch).cast("string"))


def _session() -> Column:
    return F.substring_index("session_id", "\u0001", 1)


def _epoch() -> Column:
    return F.substring_index("session_id", "\u0001", -1).cast("int")


@dataclass(frozen=True)
class RedactionStream:
    """Folders of a redaction stream and the function that scans elements.

    Every ``compact_every`` batches the state is compacted.
    """

    root: str
    scan: Callable[[DataFrame], DataFrame] = scan_elements
    compact_every: int = 20

    @property
    def _vaults(self) -> BatchTable:
        return BatchTable(f"{self.root}/vault", f"{VAULT}, epoch int")

    @property
    def _versions(self) -> BatchTable:
        return BatchTable(f"{self.root}/versions", f"session_id string, epoch int, element_id string, fingerprint string, spans array<{SPAN}>")

    @property
    def _resets(self) -> BatchTable:
        return BatchTable(f"{self.root}/resets", "session_id string, n int")

    def _epochs(self, spark: SparkSession, before: int | None, buckets: list[int] | None = None) -> DataFrame:
        """(session_id, now): the epoch of every session that was ever reset."""
        return self._resets.read(spark, before, buckets).groupBy("session_id").agg(F.sum("n").cast("int").alias("now"))

    def _live(self, rows: DataFrame, epochs: DataFrame) -> DataFrame:
        return rows.join(epochs, "session_id", "left").where(F.col("epoch") == F.coalesce("now", F.lit(0))).drop("now")

    def vault(self, spark: SparkSession, before: int | None = None, history: bool = False) -> DataFrame:
        """Tokens of all sessions' present epochs (assigned before a batch); with ``history`` of all epochs still kept."""
        rows = self._vaults.read(spark, before)
        if history:
            return rows.drop("batch_id")
        return self._live(rows, self._epochs(spark, before)).select(*_COLUMNS)

    def released(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/released")

    def quarantine(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/quarantine")

    def scans(self, spark: SparkSession) -> DataFrame:
        """Per snapshot: elements in total, new, modified, unchanged, and how many were scanned."""
        return spark.read.parquet(f"{self.root}/scans")

    def process(self, rows: DataFrame, batch_id: int) -> None:
        """Redact one micro-batch of element rows and obey its controls."""
        with scratch(rows.sparkSession):
            self._process(rows, batch_id)
        if batch_id and batch_id % self.compact_every == 0:
            self.compact(rows.sparkSession, batch_id - 1)

    def _process(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        columns = [c for c in rows.columns if c != "control"]
        if "control" not in rows.columns:
            rows = rows.withColumn("control", F.lit(None).cast("string"))
        rows = materialize(rows)
        buckets = [r.b for r in rows.select(bucket_of("session_id").alias("b")).distinct().collect()]  # at most BUCKETS
        buckets = None if len(buckets) == BUCKETS else buckets
        controls = rows.where(F.col("control").isin(*CONTROLS))
        resets = controls.groupBy("session_id").agg(F.sort_array(F.collect_list("step_no")).alias("_steps"))
        self._resets.write(resets.select("session_id", F.size("_steps").alias("n")), batch_id)
        elements = (rows.where("control IS NULL").drop("control")
                    .join(self._epochs(spark, batch_id, buckets), "session_id", "left").join(resets, "session_id", "left"))
        inside = F.coalesce(F.size(F.filter("_steps", lambda s: s <= F.col("step_no"))), F.lit(0))
        inside = F.when(F.col("_steps").isNull(), 0).otherwise(inside)
        epoch = F.coalesce("now", F.lit(0)) + inside
        elements = elements.withColumn("session_id", _in_epoch("session_id", epoch)).select(*columns)

        known = self._versions.read(spark, batch_id, buckets)
        last = F.max_by(F.struct("fingerprint", "spans"), "batch_id").alias("v")
        known = known.groupBy("session_id", "epoch", "element_id").agg(last).select(
            _in_epoch().alias("session_id"), "element_id", "v.fingerprint", "v.spans")
        marked = materialize(mark_versions(elements, known))
        scanned = materialize(scan_versions(marked, columns, self.scan))
        spans = materialize(version_spans(marked, scanned))

        newest = (marked.where("change <> 'unchanged'").groupBy("session_id", "element_id")
                  .agg(F.max_by(F.struct("version", "fingerprint"), "version").alias("v")))
        newest = newest.join(scanned.select("session_id", "element_id", F.struct("step_no", "element_pos").alias("_at"), "spans"),
                             ["session_id", "element_id"]).where(F.col("_at") == F.col("v.version"))
        self._versions.write(newest.select(_session().alias("session_id"), _epoch().alias("epoch"), "element_id",
                                           F.col("v.fingerprint").alias("fingerprint"), "spans"), batch_id)

        before = self._vaults.read(spark, batch_id, buckets).withColumn("session_id", _in_epoch())
        highest = before.groupBy("session_id", "type").agg(F.max("token_no").alias("_top"))
        fresh = tokens.build_vault(spans.join(before.select("session_id", "value"), ["session_id", "value"], "left_anti"))
        fresh = (fresh.join(highest, ["session_id", "type"], "left")
                 .withColumn("token_no", F.col("token_no") + F.coalesce("_top", F.lit(0)))
                 .withColumn("token", F.format_string("[%s_%d]", "type", "token_no")).drop("_top"))
        self._vaults.write(fresh.withColumns({"epoch": _epoch(), "session_id": _session()}), batch_id)
        vault = materialize(self._vaults.read(spark, batch_id + 1, buckets).withColumn("session_id", _in_epoch()).select(*_COLUMNS))

        redacted = materialize(tokens.redact(marked.select(*columns), spans, vault))
        safe, blocked = audit.split_by_proof(redacted, materialize(audit.egress_report(redacted, vault)))
        for name, part in (("released", safe), ("quarantine", blocked)):
            part.withColumns({"session_id": _session(), "epoch": _epoch()}).write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")
        work = scanned.groupBy("session_id", "step_no").agg(F.count("*").alias("scanned"))
        changes = marked.groupBy("session_id", "step_no").agg(
            F.count("*").alias("total"), *[F.count_if(F.col("change") == c).alias(c) for c in ("new", "modified", "unchanged")])
        (changes.join(work, ["session_id", "step_no"], "left").withColumn("scanned", F.coalesce("scanned", F.lit(0)))
         .withColumns({"session_id": _session(), "epoch": _epoch()}).write.mode("overwrite").parquet(f"{self.root}/scans/batch_id={batch_id}"))

    def writer(self, elements: DataFrame, checkpoint: str) -> DataStreamWriter:
        """Stream writer over an element stream (see ``explode_elements``), with or without a ``control`` column."""
        return (elements.writeStream.foreachBatch(lambda df, n: self.process(df, n))
                .option("checkpointLocation", checkpoint))

    def compact(self, spark: SparkSession, upto: int) -> None:
        """One base of the state of all batches up to one, without dead epochs and earlier versions."""
        epochs = self._epochs(spark, upto + 1)
        latest = F.max_by(F.struct("fingerprint", "spans", "batch_id"), "batch_id").alias("v")
        self._vaults.compact(spark, upto, lambda rows: self._live(rows, epochs))
        self._versions.compact(spark, upto, lambda rows: self._live(rows, epochs).groupBy("session_id", "epoch", "element_id").agg(latest)
                               .select("session_id", "epoch", "element_id", "v.*"))
        self._resets.compact(spark, upto, lambda rows: rows.groupBy("session_id").agg(
            F.sum("n").cast("int").alias("n"), F.max("batch_id").alias("batch_id")))
