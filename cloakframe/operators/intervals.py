"""Joins of intervals by blocks instead of by all pairs of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024  # offsets


def _blocks(start: Column, end: Column, width: int) -> Column:
    """Numbers of the blocks that [start, end) touches; an empty interval is in that of its place."""
    first = F.floor(start / width)
    return F.sequence(first, F.greatest(first, F.floor((end - 1) / width)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str],
                 width: int = BLOCK) -> DataFrame:
    """Rows of both sides with equal keys and overlapping ranges (start < other end and end > other start).

    Both sides are dealt to blocks of ``width``, and a pair is reported in the
    first block that both touch, so only neighbours meet, each pair once.
    """
    (a, b), (c, d) = left_range, right_range
    near = [*keys, "_block"]
    lefts = left.withColumn("_lfirst", F.floor(F.col(a) / width)).withColumn("_block", F.explode(_blocks(F.col(a), F.col(b), width)))
    rights = right.withColumn("_rfirst", F.floor(F.col(c) / width)).withColumn("_block", F.explode(_blocks(F.col(c), F.col(d), width)))
    meet = (F.col(a) < F.col(d)) & (F.col(b) > F.col(c)) & (F.col("_block") == F.greatest("_lfirst", "_rfirst"))
    return lefts.join(rights, near).where(meet).drop("_lfirst", "_rfirst", "_block")


LEVELS = range(6, 25)  # cells of 64 units and more


def _level(width: Column, height: Column) -> Column:
    """The level at which a box touches at most two cells each way."""
    size = F.greatest(width, height, F.lit(1.0))
    return F.least(F.greatest(F.ceil(F.log2(size)).cast("int"), F.lit(LEVELS[0])), F.lit(LEVELS[-1]))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], point: tuple[str, str], box: tuple[str, str, str, str]) -> DataFrame:
    """Rows of both sides with equal keys whose point lies in the box, its edges included.

    A box is filed in the cells that it touches at the level of its size, four
    at the most; a point asks its cell at every level.
    """
    x, y, w, h = (F.col(c).cast("double") for c in box)
    px, py = (F.col(c).cast("double") for c in point)
    near = [*keys, "_level", "_cx", "_cy"]
    filed = boxes.where((w >= 0) & (h >= 0)).withColumn("_level", _level(w, h)).withColumn("_cell", F.pow(F.lit(2.0), "_level"))
    filed = (filed.withColumn("_cx", F.explode(F.sequence(F.floor(x / F.col("_cell")), F.floor((x + w) / F.col("_cell")))))
             .withColumn("_cy", F.explode(F.sequence(F.floor(y / F.col("_cell")), F.floor((y + h) / F.col("_cell"))))).drop("_cell"))
    asked = points.where(px.isNotNull() & py.isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(k) for k in LEVELS])))
    asked = (asked.withColumn("_cx", F.floor(px / F.pow(F.lit(2.0), "_level"))).withColumn("_cy", F.floor(py / F.pow(F.lit(2.0), "_level"))))
    return asked.join(filed, near).where(px.between(x, x + w) & py.between(y, y + h)).drop("_level", "_cx", "_cy")
