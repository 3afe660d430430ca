"""Snapshot diffs: rescan what changed, reuse the spans of what did not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.operators.detect import CONTEXT_COLUMNS, scan_elements
from cloakframe.operators.spans import explode_spans
from cloakframe.schema import SPAN

CONTENT_COLUMNS = ("text", "placeholder", "href", "value", "type")


def diff_snapshots(elements: DataFrame, with_context: bool = True) -> DataFrame:
    """Classify every element against the same element one step earlier.

    ``change`` is ``new``, ``modified`` or ``unchanged``.  The lookup is an
    equi-join on (session, step, element), so a long-lived session is spread
    over all its elements and steps.  With ``with_context`` a changed label or
    container also counts, because it can change what is detected.
    """
    watched = list(CONTENT_COLUMNS)
    if with_context:
        watched += [c for c in CONTEXT_COLUMNS if c not in watched] + ["selector", "role"]
    watched = [c for c in watched if c in elements.columns]
    earlier = elements.select(
        "session_id", (F.col("step_no") + 1).alias("step_no"), "element_id",
        F.struct(*watched).alias("_before"))
    joined = elements.join(earlier, ["session_id", "step_no", "element_id"], "left")
    same = F.struct(*watched).eqNullSafe(F.col("_before"))
    return joined.withColumn(
        "change", F.when(F.col("_before").isNull(), "new").when(same, "unchanged")
        .otherwise("modified")).drop("_before")


def diff_stats(diffed: DataFrame) -> DataFrame:
    """Per snapshot: elements in total, unchanged, and to be scanned."""
    return diffed.groupBy("session_id", "step_no").agg(
        F.count("*").alias("total"), F.count_if(F.col("change") == "unchanged").alias("unchanged"),
        F.count_if(F.col("change") != "unchanged").alias("changed"))


def scan_step(elements: DataFrame, previous: DataFrame | None, cache: DataFrame | None,
              scan=scan_elements) -> DataFrame:
    """Scan one step against the one before it.

    ``elements`` and ``previous`` hold one snapshot each per session; ``cache``
    has (session_id, element_id, spans) of the previous step.  Elements that
    did not change take their spans from the cache; the others, and those the
    cache does not know, go through ``scan``.  The result is the new cache with
    every element of the step, also those without a finding.
    """
    if previous is None or cache is None:
        return scan(elements).select("session_id", "step_no", "element_pos", "element_id", "spans")
    watched = [c for c in (*CONTENT_COLUMNS, *CONTEXT_COLUMNS, "selector", "role")
               if c in elements.columns]
    watched = list(dict.fromkeys(watched))
    before = previous.select("session_id", "element_id", F.struct(*watched).alias("_before"))
    known = cache.select("session_id", "element_id", F.col("spans").alias("_cached"))
    joined = (elements.join(before, ["session_id", "element_id"], "left")
              .join(known, ["session_id", "element_id"], "left"))
    reuse = F.struct(*watched).eqNullSafe(F.col("_before")) & F.col("_cached").isNotNull()
    keys = ["session_id", "step_no", "element_pos", "element_id"]
    kept = joined.where(reuse).select(*keys, F.col("_cached").cast(f"array<{SPAN}>").alias("spans"))
    fresh = scan(joined.where(~reuse).select(*elements.columns)).select(*keys, "spans")
    return kept.unionByName(fresh)


def incremental_spans(elements: DataFrame, scan=scan_elements) -> DataFrame:
    """Span rows of a whole history, scanning every distinct version once.

    An unchanged element has the spans of its last changed version: only new
    and modified versions are scanned, and each unchanged row is joined to the
    version it repeats.
    """
    keys = ["session_id", "step_no", "element_pos", "element_id"]
    watched = [c for c in elements.columns if c not in ("step_no", "element_pos")]
    version = F.sha2(F.to_json(F.struct(*watched)), 256)
    tagged = elements.withColumn("_version", version)
    distinct = tagged.dropDuplicates(["session_id", "element_id", "_version"])
    found = scan(distinct)
    reused = tagged.select(*keys, "_version").join(
        found.select("session_id", "element_id", "_version", "spans"),
        ["session_id", "element_id", "_version"])
    return explode_spans(reused, tuple(keys))


def mark_versions(elements: DataFrame, known: DataFrame) -> DataFrame:
    """``elements`` with ``change``, ``fingerprint``, ``version`` and ``known_spans``.

    An element is compared with its row before, in this table or else in
    ``known`` (session_id, element_id, fingerprint, spans).  ``version`` is the
    place (step_no, element_pos) of the row whose content it still has; null if
    that lies in ``known``, whose spans are then in ``known_spans``.
    """
    keys = ("session_id", "step_no", "element_pos", "element_id")
    watched = [c for c in elements.columns if c not in keys]
    history = Window.partitionBy("session_id", "element_id").orderBy("step_no", "element_pos")
    earlier = known.select("session_id", "element_id", F.col("fingerprint").alias("_known"), F.col("spans").alias("known_spans"))
    rows = elements.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*watched)), 256))
    rows = rows.join(earlier, ["session_id", "element_id"], "left")
    before = F.coalesce(F.lag("fingerprint").over(history), F.col("_known"))
    rows = rows.withColumn("change", F.when(before.isNull(), "new").when(before == F.col("fingerprint"), "unchanged").otherwise("modified"))
    place = F.when(F.col("change") != "unchanged", F.struct("step_no", "element_pos"))
    return rows.withColumn("version", F.last(place, ignorenulls=True).over(
        history.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_known")


def scan_versions(marked: DataFrame, columns: list[str], scan=scan_elements) -> DataFrame:
    """(session_id, step_no, element_pos, element_id, spans) of the new and modified rows of a marked table: all that is scanned."""
    fresh = marked.where(F.col("change") != "unchanged").select(*columns)
    return scan(fresh).select("session_id", "step_no", "element_pos", "element_id", F.col("spans").cast(f"array<{SPAN}>").alias("spans"))


def version_spans(marked: DataFrame, scanned: DataFrame) -> DataFrame:
    """Span rows of all rows of a marked table: scanned ones, those of an earlier row, or known ones."""
    keys = ["session_id", "step_no", "element_pos", "element_id"]
    found = scanned.select("session_id", "element_id", F.struct("step_no", "element_pos").alias("version"), "spans")
    repeated = marked.where(F.col("version").isNotNull()).select(*keys, "version").join(found, ["session_id", "element_id", "version"])
    kept = marked.where(F.col("version").isNull()).select(*keys, F.col("known_spans").alias("spans"))
    return explode_spans(repeated.select(*keys, "spans").unionByName(kept), tuple(keys))
