"""Geometry of recognised text: lines, words, regions to cover or to read.

Lines are (image_id, line_no, text, x, y, w, h); words the same plus
``word_no`` and ``confidence``; spans have offsets into the lines joined by a
newline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.geometry import box, merged_box
from cloakframe.operators.intervals import overlap_join

MIN_WORD_CONFIDENCE = 40
FORM_REGIONS = ("auth_card", "form_area", "profile_section")


def usable_words(words: DataFrame, least: int = MIN_WORD_CONFIDENCE) -> DataFrame:
    return words.where((F.col("confidence") >= least) & (F.trim("text") != ""))


def line_offsets(lines: DataFrame, key: str = "image_id") -> DataFrame:
    """Start and end of every line in the joined text of its image."""
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return (lines.withColumn("line_start", start)
            .withColumn("line_end", F.col("line_start") + F.length("text")))


def pii_regions(spans: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """Image box of every span.

    A span on one line is boxed by the words it contains, or by the whole line
    if none matches; a span over several lines by all of them.
    """
    placed = line_offsets(lines).select(
        "image_id", "line_no", "line_start", "line_end", "x", "y", "w", "h")
    key = ["image_id", "start", "end", "type", "value"]
    on_lines = (overlap_join(spans.select(*key), placed, ["image_id"], ("start", "end"), ("line_start", "line_end"))
                .groupBy(*key).agg(F.count("*").alias("n_lines"), F.min("line_no").alias("line_no"),
                                   merged_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("line_box")))
    boxes = words.select("image_id", "line_no", F.lower("text").alias("_word"),
                         F.col("x").alias("wx"), F.col("y").alias("wy"),
                         F.col("w").alias("ww"), F.col("h").alias("wh"))
    tight = (on_lines.where(F.col("n_lines") == 1).join(boxes, ["image_id", "line_no"])
             .where(F.contains(F.lower("value"), F.col("_word")))
             .groupBy(*key).agg(merged_box(F.col("wx"), F.col("wy"), F.col("ww"), F.col("wh")).alias("word_box")))
    out = on_lines.join(tight, key, "left").withColumn("bbox", F.coalesce("word_box", "line_box"))
    return out.select(*key, "bbox.*")


def reading_regions(faces: DataFrame, regions: DataFrame, screens: DataFrame) -> DataFrame:
    """Where to run text recognition: around faces and in form-like regions.

    Canvas-heavy screens get no region, which means the whole image.
    """
    near = faces.select(
        "image_id", F.greatest(F.lit(0), F.col("x") - F.col("w")).cast("double").alias("x"),
        F.col("y").cast("double").alias("y"), (F.col("w") * 3).cast("double").alias("w"),
        (F.col("h") * 2.5).cast("double").alias("h"), F.lit("face_vicinity").alias("label"))
    forms = regions.where(F.col("type").isin(*FORM_REGIONS)).select(
        "image_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")],
        F.col("type").alias("label"))
    heavy = screens.where("canvas_heavy").select("image_id")
    return near.unionByName(forms).join(heavy, "image_id", "left_anti")


def needs_reading(has_screenshot: Column, forced: Column, canvas_heavy: Column,
                  elements_count: Column) -> Column:
    return has_screenshot & (F.coalesce(forced, F.lit(False)) | F.coalesce(canvas_heavy, F.lit(False))
                             | (F.coalesce(elements_count, F.lit(0)) < 3))


def element_regions(redacted: DataFrame) -> DataFrame:
    """Boxes of redacted elements that have a complete one."""
    c = F.col("coordinates")
    return (redacted.where(F.col("is_redacted") & (F.size(c) == 4))
            .select("session_id", "step_no", "element_id",
                    F.coalesce(F.get("redacted_types", F.lit(0)), F.lit("DOM_PII")).alias("label"),
                    *[c[i].alias(n) for i, n in enumerate(("x", "y", "w", "h"))]))


def all_regions(text_regions: DataFrame, face_regions: DataFrame,
                key: tuple[str, ...]) -> DataFrame:
    """One list of boxes to cover, typed ``face`` or ``text_pii``."""
    def typed(df: DataFrame, kind: str) -> DataFrame:
        label = F.col("label") if "label" in df.columns else F.lit(None).cast("string")
        return df.select(*key, F.lit(kind).alias("type"), label.alias("label"),
                         *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")])
    return typed(face_regions, "face").unionByName(typed(text_regions, "text_pii"))


__all__ = ["usable_words", "line_offsets", "pii_regions", "reading_regions", "needs_reading",
           "element_regions", "all_regions", "box"]
