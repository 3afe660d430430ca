"""Quiet-period grouping of change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.operators.segments import fit_segment
from cloakframe.session import materialize


def settle_windows(events: DataFrame, quiet_s: float, cap_s: float, key: str = "session_id",
                   ts: str = "ts", tie: str = "event_id", segment: Column | None = None) -> DataFrame:
    """Bursts of events per key that end after a quiet period or at a cap.

    A gap longer than ``quiet_s`` starts a new burst; a burst that lasts longer
    than ``cap_s`` is cut every ``cap_s`` seconds from its start.  Bursts are
    found inside the segments of a key; a table with one row per segment tells
    whether a segment's first event opens one, and carries numbers and starts on.
    """
    rows = materialize(events.select(key, ts, tie))
    rows = rows.withColumn("_seg", segment if segment is not None else fit_segment(rows, [key], ts))
    local = Window.partitionBy(key, "_seg").orderBy(ts, tie)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(local))) / 1e6 > quiet_s  # null for the first of a segment
    rows = rows.withColumn("_opens", F.coalesce(opens, F.lit(False)))
    parts = rows.groupBy(key, "_seg").agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count_if("_opens").alias("_n"), F.max(F.when(F.col("_opens"), F.col(ts))).alias("_open"))
    line = Window.partitionBy(key).orderBy("_seg")
    prior = line.rowsBetween(Window.unboundedPreceding, -1)
    before = F.lag("_last").over(line)
    parts = parts.withColumn("_edge", before.isNull() | ((F.unix_micros("_first") - F.unix_micros(before)) / 1e6 > quiet_s))
    latest = F.coalesce("_open", F.when(F.col("_edge"), F.col("_first")))
    parts = parts.withColumn("_bursts", F.coalesce(F.sum(F.col("_n") + F.col("_edge").cast("long")).over(prior), F.lit(0)) + F.col("_edge").cast("long"))
    parts = parts.withColumn("_since", F.when(F.col("_edge"), F.col("_first")).otherwise(F.last(latest, ignorenulls=True).over(prior)))
    inside = rows.withColumn("_count", F.count_if("_opens").over(upto)).withColumn(
        "_start", F.last(F.when(F.col("_opens"), F.col(ts)), ignorenulls=True).over(upto))
    joined = inside.join(parts.select(key, "_seg", "_bursts", "_since"), [key, "_seg"])
    piece = F.floor((F.unix_micros(ts) - F.unix_micros(F.coalesce("_start", "_since"))) / 1e6 / cap_s)
    return (joined.withColumns({"burst": F.col("_bursts") + F.col("_count"), "piece": piece}).groupBy(key, "burst", "piece")
            .agg(F.min(ts).alias("started_at"), F.max(ts).alias("last_event_at"),
                 F.count("*").alias("n_events")))
