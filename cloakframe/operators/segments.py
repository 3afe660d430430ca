"""Ordered computations that stay spread out when one key is huge.

A window over a key runs in one task.  Where a key may hold a large share of
all rows, its ordered range is cut into segments: windows run inside a
segment, one summary row per segment is carried forward, and the two are
joined on (key, segment).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.session import materialize

GROUP_LIMIT = 1_000_000


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str,
                limit: int = GROUP_LIMIT) -> DataFrame:
    """``row_number`` per group, starting at 1, for groups of any size.

    ``df`` is read more than once and must be cheap to re-read (materialized).
    Groups up to ``limit`` rows use a plain window.  Beyond that the rows are
    range-partitioned over (group, order), stored, and numbered by position in
    the partition plus the rows of the group in earlier partitions.
    """
    sizes = df.groupBy(*group).count().agg(F.max("count").alias("top"), F.sum("count").alias("n"))
    top, total = sizes.first()
    if (top or 0) <= limit:
        window = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(out, F.row_number().over(window).cast("bigint"))
    parts = max(2, math.ceil(total / limit))
    keys = [F.col(g) for g in group]
    ranged = materialize(
        df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_pos", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_pos", 33))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*group, "_part")
               .agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .drop("_n"))
    return (ranged.join(offsets, [*group, "_part"])
            .withColumn(out, F.col("_pos") - F.col("_first") + F.col("_before") + 1)
            .drop("_pos", "_part", "_first", "_before"))


def day_of(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 86400)


def fit_segment(df: DataFrame, group: Sequence[str], ts: str = "ts",
                limit: int = GROUP_LIMIT) -> Column:
    """Widest time segment that keeps every (group, segment) within ``limit`` rows.

    Tries day, hour, minute and second; usually the first one fits.  Only the
    largest count comes back to the driver.
    """
    for width in (86400, 3600, 60, 1):
        segment = F.floor(F.unix_seconds(ts) / width)
        sizes = df.groupBy(*group, segment.alias("_seg")).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= limit:
            break
    return segment


def block_of(position: Column, width: int = 4096) -> Column:
    return F.floor(position / width)


def _order_key(order: Sequence[str]) -> Column:
    return F.struct(*order)


def _prior(group: Sequence[str]) -> Window:
    return Window.partitionBy(*group).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], segment: Column,
                 amounts: dict[str, Column]) -> DataFrame:
    """Inclusive running sums along ``order`` within each group, all in one pass."""
    return carry(df, group, order, segment, sums=amounts)


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], segment: Column,
                amount: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``amount`` along ``order`` within each group."""
    return running_sums(df, group, order, segment, {out: amount})


def carry(df: DataFrame, group: Sequence[str], order: Sequence[str], segment: Column, last: dict[str, Column] | None = None,
          before: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Several values along ``order`` of each group, in one shuffle with one table of segments.

    ``last``: the last non-null value at or before each row; ``before``: the
    last non-null value of earlier rows; ``sums``: inclusive running sums.
    ``df`` is read twice, once for the table of segments.
    """
    last, before, sums = last or {}, before or {}, sums or {}
    known = {**last, **before}
    df = df.withColumn("_seg", segment).withColumns({f"_v_{n}": c for n, c in {**known, **sums}.items()})
    local = Window.partitionBy(*group, "_seg").orderBy(*order)
    upto, earlier = (local.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    at = _order_key(order)
    totals = df.groupBy(*group, "_seg").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_t_{n}") for n in known],
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    carried = totals.select(
        *group, "_seg", *[F.last(f"_t_{n}", ignorenulls=True).over(_prior(group)).alias(f"_c_{n}") for n in known],
        *[F.coalesce(F.sum(f"_t_{n}").over(_prior(group)), F.lit(0)).alias(f"_c_{n}") for n in sums])
    inside = {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(upto if n in last else earlier) for n in known}
    inside |= {f"_l_{n}": F.sum(f"_v_{n}").over(upto) for n in sums}
    out = df.withColumns(inside).join(carried, [*group, "_seg"])
    out = out.withColumns({n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in known} | {
        n: F.coalesce(f"_l_{n}", F.lit(0)) + F.col(f"_c_{n}") for n in sums})
    return out.drop("_seg", *[f"_{k}_{n}" for k in "vlc" for n in {**known, **sums}])


def last_known(df: DataFrame, group: Sequence[str], order: Sequence[str], segment: Column,
               value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """Last non-null ``value`` at or before each row (an as-of lookup).

    With ``inclusive=False`` the row's own value does not count.
    """
    return carry(df, group, order, segment, **{"last" if inclusive else "before": {out: value}})
