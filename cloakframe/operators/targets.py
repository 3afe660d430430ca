"""Finding the element a step aims at, and checking what a step expects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.intervals import points_in_boxes
from cloakframe.operators.leakproof import occurrences


def resolve_targets(steps: DataFrame, elements: DataFrame) -> DataFrame:
    """Element of each step: by selector, else by text, else by point.

    Each rule takes the first element in document order, the point rule the
    last one (nothing else tells what lies on top).  Selectors are an equi-join.
    Texts are found by the search for values in texts, page by page, points by
    a grid; no step is compared with all elements of its page.
    """
    snap = ["session_id", "step_no"]
    e = elements.select(
        *snap, "element_pos", "element_id", F.col("selector").alias("target_selector"),
        F.col("text").alias("_text"), F.col("value").alias("_value"), F.col("coordinates").alias("_c"))
    found = F.struct("element_id", "_text", "_value")
    ids = [*snap, "step_id"]
    by_selector = (steps.select(*ids, "target_selector").join(e, [*snap, "target_selector"])
                   .groupBy(*ids).agg(F.min_by(found, "element_pos").alias("_m1")))
    rest = steps.select(*ids, "target_text", "target_x", "target_y").join(by_selector, ids, "left_anti")
    rest = rest.where((F.col("target_text") != "") | F.col("target_x").isNotNull())
    page = F.concat_ws("\u0001", F.col("session_id"), F.col("step_no").cast("string"))
    seen = F.struct("element_id", "_text", "_value")
    texts = e.where(F.col("_text").isNotNull()).select(
        page.alias("_scope"), F.trim("_text").alias("_out"), F.col("element_pos").alias("_pos"), seen.alias("_seen"))
    wanted = rest.where(F.col("target_text") != "").select(page.alias("_scope"), "target_text").distinct()
    shown = occurrences(texts, wanted.select("_scope", F.col("target_text").alias("_value"), "_scope", "target_text").toDF("_scope", "_value", "_page", "target_text"),
                        ["_pos", "_seen"], ["_page", "target_text"])
    by_text = (shown.groupBy("_page", "target_text").agg(F.min_by("_seen", "_pos").alias("_m2"))
               .join(rest.select(*ids, "target_text", page.alias("_page")), ["_page", "target_text"]).select(*ids, "_m2"))
    boxed = e.where(F.size("_c") == 4).select(*snap, "element_pos", seen.alias("_seen"), *[F.col("_c")[i].alias(f"_b{i}") for i in range(4)])
    aimed = rest.where(F.col("target_x").isNotNull()).select(*ids, "target_x", "target_y").join(by_text.select(*ids), ids, "left_anti")
    by_point = (points_in_boxes(aimed, boxed, snap, ("target_x", "target_y"), ("_b0", "_b1", "_b2", "_b3"))
                .groupBy(*ids).agg(F.max_by("_seen", "element_pos").alias("_m3")))
    by_sight = by_text.select(*ids, F.struct("_m2.*", F.lit(2).alias("rule")).alias("_m2")).unionByName(
        by_point.select(*ids, F.struct("_m3.*", F.lit(3).alias("rule")).alias("_m2")))
    out = steps.join(by_selector, ids, "left").join(by_sight, ids, "left")

    def pick(name: str) -> Column:
        return F.when(F.col("_m1").isNotNull(), F.col(f"_m1.{name}")).otherwise(F.col(f"_m2.{name}"))

    return out.select(
        *steps.columns, pick("element_id").alias("element_id"),
        F.when(F.col("_m1").isNotNull(), 1).otherwise(F.col("_m2.rule")).alias("matched_by"),
        pick("_value").alias("element_value"), pick("_text").alias("element_text"))


def extracted(value: Column, text: Column) -> Column:
    """Data of an element: its value if it has one, else its trimmed text."""
    return F.coalesce(value, F.trim(F.coalesce(text, F.lit(""))))


def verify_steps(checks: DataFrame, snapshots: DataFrame, elements: DataFrame) -> DataFrame:
    """Evaluate verify conditions against the snapshot after the step.

    ``URL_CHECK`` is an address prefix; ``DOM_CHECK`` takes ``exists:<selector>``
    (an ``#id`` or a tag name) or ``text:<words>``; anything else stays null.
    """
    snap = ["session_id", "step_no"]
    sel = F.regexp_extract("condition", r"^exists:(.*)", 1)
    needle = F.regexp_extract("condition", r"(?s)^text:(.*)", 1)
    ids = [*snap, "step_id"]
    rows = (checks.withColumn("_sel", F.when(F.startswith("condition", F.lit("exists:")), sel))
            .withColumn("_needle", F.when(F.startswith("condition", F.lit("text:")), needle)))
    e = elements.select(*snap, F.col("selector").alias("_s"), F.lower("tag").alias("_tag"),
                        F.coalesce("text", F.lit("")).alias("_t"))
    seen = (rows.where((F.col("method") == "DOM_CHECK")
                       & (F.col("_sel").isNotNull() | F.col("_needle").isNotNull()))
            .join(e, snap, "left").groupBy(*ids)
            .agg(F.bool_or(F.when(F.col("_sel").isNotNull(),
                                  (F.col("_s") == F.col("_sel")) | (F.col("_tag") == F.lower("_sel")))
                           .otherwise(F.contains("_t", F.col("_needle")))).alias("_seen")))
    out = rows.join(snapshots.select(*snap, "url"), snap, "left").join(seen, ids, "left")
    passed = (F.when(F.col("method") == "URL_CHECK",
                     F.coalesce(F.startswith("url", F.col("condition")), F.lit(False)))
              .when((F.col("method") == "DOM_CHECK")
                    & (F.col("_sel").isNotNull() | F.col("_needle").isNotNull()),
                    F.coalesce("_seen", F.lit(False))))
    return out.select(*checks.columns, F.col("method").isin("URL_CHECK", "DOM_CHECK").alias("checked"),
                      passed.alias("passed"))
