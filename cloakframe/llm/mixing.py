"""Mixing sources to target weights over a time-varying curriculum, with column expressions only.

Every source has a schedule: its weight as a function of training time from 0
to 1, straight between knots.  The integral of the schedule is the weight of
the source in the whole mix; targets follow from it, a source being repeated
``most`` times at the most.  The documents of a source form a stream, in the
order of a digest and repeated pass after pass; the mix takes the first words
of that stream up to the target.  A copy that begins ``c`` words into the
stream stands at the time when the integral of the schedule reaches the share
c / taken, so that the demand of every moment is met.  A range sort by that
time gives the training order.

Running sums never gather a source: its stream is cut into about sqrt(rows)
ranges of the digest, summed inside the ranges, and the sums of ranges are
carried over.  Numbers along a global order come from range partitions and
the totals of earlier ones.

Defined cases: a null text has no words and is never taken.  A null source is
a source of its own, the last one.  Rows without doc_id, and repeated rows,
are documents like any other; equal rows may swap places.  The document at
which a target ends is taken up to that word.  Where no text has words all
targets are 0.  Unknown sources of a given schedule are ignored, and a source
without one has the weight 0.  An empty table gives no rows.  Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from cloakframe.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
KNOTS = "array<struct<t: double, w: double>>"
_SOURCE = ["_none", "_source"]


def knots(*points: tuple[float, float | Column]) -> Column:
    """A schedule from (time, weight) points; the first at 0, the last at 1."""
    return F.array(*[F.struct(F.lit(float(t)).alias("t"), (w if isinstance(w, Column) else F.lit(w)).cast("double").alias("w")) for t, w in points])


def turns(rank: Column) -> Column:
    """Weights 1, 2, 3 in turns; every first source keeps its weight, every second fades out, every third grows."""
    weight = (F.pmod(rank, F.lit(3)) + 1).cast("double")
    slope = F.when(F.pmod(rank, F.lit(3)) == 0, 0.0).when(F.pmod(rank, F.lit(3)) == 1, -0.5).otherwise(0.5)
    return knots((0, weight * (1 - slope)), (1, weight * (1 + slope)))


def _areas(schedule: Column) -> Column:
    """The integral of the schedule up to each of its knots."""
    step = lambda p, k: F.when(k == 0, 0.0).otherwise(
        (p["t"] - F.get(schedule, k - 1)["t"]) * (p["w"] + F.get(schedule, k - 1)["w"]) / 2
    )
    steps = F.transform(schedule, step)
    return F.transform(steps, lambda _, k: F.aggregate(F.slice(steps, 1, k + 1), F.lit(0.0), lambda a, x: a + x))


def _time_of(area: Column, schedule: Column, areas: Column) -> Column:
    """The time at which the integral of the schedule reaches ``area``."""
    at = F.greatest(F.size(F.filter(areas, lambda a: a <= area)), F.lit(1))
    at = F.least(at, F.size(schedule) - 1) - 1
    t0, w0 = F.get(schedule, at)["t"], F.get(schedule, at)["w"]
    slope = (F.get(schedule, at + 1)["w"] - w0) / (F.get(schedule, at + 1)["t"] - t0)
    rest = area - F.get(areas, at)
    # The root of slope / 2 * x^2 + w0 * x = rest, in the form that also holds without a slope.
    below = w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0)))
    return t0 + F.when(below > 0, 2 * rest / below).otherwise(0.0)


def along(df: DataFrame, order: list[Column], count: str, sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the number of rows before each one, and sums up to it, along a global order.

    Rows are range-partitioned and sorted once and stored; only one row per
    partition meets in a window.
    """
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    names = list(sums or {})
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(sums[x]).alias(f"_t_{x}") for x in names])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ["_n", *[f"_t_{x}" for x in names]]])
    out = ranged.join(carried, "_part").withColumn(count, F.col("_at") + F.col("_before_n"))
    if names:
        upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({x: F.sum(sums[x]).over(upto) + F.col(f"_before_t_{x}") for x in names})
    return out.drop("_id", "_part", "_at", *[c for c in carried.columns if c != "_part"])


def source_targets(sizes: DataFrame, schedule: Callable[[Column], Column] | DataFrame = turns, most: float = 3.0) -> DataFrame:
    """(source, size) rows with rank, schedule, weight and target.

    The targets share the sum of all sizes by weight and stop at ``most`` times
    the size; what is over goes to the others by weight.  At the end of that,
    every target is min(most * size, level * weight) for one level, found in
    the order of size over weight.
    """
    ranked = along(sizes, [F.col("_none"), F.col("_source")], "rank")
    if isinstance(schedule, DataFrame):
        given = schedule.groupBy(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source")).agg(
            F.max(F.col("schedule").cast(KNOTS)).alias("schedule")
        )
        ranked = ranked.join(given, _SOURCE, "left").withColumn("schedule", F.coalesce("schedule", knots((0, 0.0), (1, 0.0))))
    else:
        ranked = ranked.withColumn("schedule", schedule(F.col("rank")))
    ranked = ranked.withColumn("areas", _areas(F.col("schedule"))).withColumn("weight", F.element_at("areas", -1))
    ranked = ranked.withColumn("_cap", most * F.col("source_size")).withColumn("_full", F.when(F.col("weight") > 0, F.col("_cap") / F.col("weight")))
    ranked = ranked.where("weight > 0").transform(
        lambda d: along(d, [F.col("_full"), F.col("rank")], "_place", {"_caps": "_cap", "_weights": "weight"})
    ).unionByName(ranked.where("weight <= 0"), allowMissingColumns=True)
    ranked = stored(ranked)
    words, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    # The level with this source, and all that fill up before it, at their caps.
    rest, unfilled = F.lit(words or 0) - (F.col("_caps") - F.col("_cap")), F.lit(weights or 0.0) - (F.col("_weights") - F.col("weight"))
    first = F.struct("_place", rest.alias("rest"), unfilled.alias("unfilled"))
    level = ranked.where(F.col("_caps").isNotNull() & (rest <= F.col("_full") * unfilled)).agg(F.min(first)).first()[0]
    target = F.col("_cap") if level is None else F.when(F.col("_place") < level["_place"], F.col("_cap")).otherwise(
        F.col("weight") * level["rest"] / level["unfilled"]
    )
    target = F.when(F.col("weight") > 0, target.cast("double")).otherwise(0.0)
    return ranked.select(*_SOURCE, "rank", "source_size", "schedule", "areas", target.alias("target"))


def mix(docs: DataFrame, schedule: Callable[[Column], Column] | DataFrame = turns, most: int = 3) -> DataFrame:
    """Every document with what the mix takes of it and when.

    Columns: row (a number of the row), doc_id, source, size, source_size,
    target, taken, and ``copies``: an array of (pass, words, time).
    ``schedule`` gives the knots of a source from its rank by code point, or is
    a table (source, schedule array<struct<t, w>>).
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").isNull().alias("_none"),
        F.coalesce("source", F.lit("")).alias("_source"), words.alias("size"), digest.alias("_digest"),
    ))
    ranges = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("_range", F.floor(F.conv(F.left("_digest", F.lit(8)), 16, 10).cast("long") * ranges / (1 << 32)))
    parts = stored(rows.groupBy(*_SOURCE, "_range").agg(F.sum("size").alias("_words")))
    targets = source_targets(parts.groupBy(*_SOURCE).agg(F.sum("_words").alias("source_size")), schedule, most)
    before = Window.partitionBy(*_SOURCE).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_earlier", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words").join(targets, _SOURCE)
    inside = Window.partitionBy(*_SOURCE, "_range").orderBy("_digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, [*_SOURCE, "_range"])
    quota = F.floor(F.col("target") + 0.5)
    start = lambda p: F.col("source_size") * p + F.col("_earlier") + F.col("_inside")
    copy = lambda p: F.struct(
        p.cast("int").alias("pass"), F.least(F.col("size"), quota - start(p)).alias("words"),
        _time_of(start(p) / quota * F.element_at("areas", -1), F.col("schedule"), F.col("areas")).alias("time"),
    )
    copies = F.transform(F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: (F.col("size") > 0) & (start(p) < quota)), copy)
    out = placed.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return out.select(
        "row", "doc_id", F.when(~F.col("_none"), F.col("_source")).alias("source"), "size", "source_size", "target", taken.alias("taken"), "copies", "_digest"
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy that ``mix`` takes: row, doc_id, source, pass, words, time and place, the number of copies before it.

    Copies of one time are ordered by source and digest.
    """
    copies = mixed.where(F.size("copies") > 0).select("row", "doc_id", "source", "_digest", F.explode("copies").alias("c"))
    copies = copies.select("row", "doc_id", "source", "_digest", F.col("c.pass").alias("pass"), F.col("c.words").alias("words"), F.col("c.time").alias("time"))
    order = [F.col("time").asc(), F.col("source").asc_nulls_last(), F.col("_digest").asc(), F.col("pass").asc(), F.col("doc_id").asc_nulls_last()]
    return along(copies, order, "place").drop("_digest")


def mixed_documents(docs: DataFrame, schedule: Callable[[Column], Column] | DataFrame = turns, most: int = 3) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and the place and time of its first copy (null if none is taken)."""
    mixed = stored(mix(docs, schedule, most))
    first = training_order(mixed).where("pass = 0").select("row", F.col("place").alias("first_place"), F.col("time").alias("first_time"))
    return mixed.join(first, "row", "left").select("doc_id", "size", "source_size", "target", "taken", "first_place", "first_time")
