"""Boxes: padding, clipping, merging; class scores of model outputs.

A box is (x, y, w, h) everywhere; corner boxes are converted on the way in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def padded_box(x: Column, y: Column, w: Column, h: Column, pad_x: Column, pad_y: Column,
               width: Column, height: Column) -> Column:
    """Grow a box on all sides, round it, and keep it inside the image."""
    left = F.greatest(F.lit(0), round_half_up(x - pad_x))
    top = F.greatest(F.lit(0), round_half_up(y - pad_y))
    return box(left, top, F.least(width - left, round_half_up(w + 2 * pad_x)),
               F.least(height - top, round_half_up(h + 2 * pad_y)))


def face_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column,
             share: float = 0.1) -> Column:
    return padded_box(x, y, w, h, w * share, h * share, width, height)


def text_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column,
             pad: int = 2) -> Column:
    return padded_box(x, y, w, h, F.lit(pad), F.lit(pad), width, height)


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return box(x1, y1, x2 - x1, y2 - y1)


def face_from_output(top: Column, left: Column, bottom: Column, right: Column,
                     width: Column, height: Column, least: int = 5) -> Column:
    """Pixel box of a normalised face output; null if a side is under 5 pixels."""
    x, y = left * width, top * height
    w, h = right * width - x, bottom * height - y
    return F.when((w >= least) & (h >= least), box(x, y, w, h))


def merged_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Aggregate: the smallest box around all boxes of a group."""
    left, top = F.min(x), F.min(y)
    return box(left, top, F.max(x + w) - left, F.max(y + h) - top)


def softmax(values: Column) -> Column:
    """Class probabilities from raw scores."""
    # Maximum and sum are bound once each, not looked up again for every value.
    exps = F.get(F.transform(F.array(F.array_max(values).cast("double")), lambda top: F.transform(
        values.cast("array<double>"), lambda v: F.exp(v - top))), F.lit(0))
    return F.get(F.transform(F.array(exps), lambda es: F.get(F.transform(
        F.array(F.aggregate(es, F.lit(0.0), lambda a, v: a + v)),
        lambda total: F.transform(es, lambda v: v / total)), F.lit(0))), F.lit(0))


def argmax(values: Column) -> Column:
    """Zero-based position of the largest value; the first one on ties."""
    return F.array_position(values, F.array_max(values)) - 1
