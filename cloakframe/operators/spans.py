"""Span tables: exploding, merging sources, de-duplicating, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.operators.intervals import overlap_join
from cloakframe.schema import SPAN

ELEMENT_KEY = ("session_id", "step_no", "element_pos")
FIELD_ORDER = {"text": 0, "placeholder": 1, "value": 2, "href": 3}


def explode_spans(scanned: DataFrame, keys: tuple[str, ...] = (*ELEMENT_KEY, "element_id")
                  ) -> DataFrame:
    """One row per span, keeping the order in which the scan listed them."""
    field_ord = F.create_map(*[F.lit(x) for kv in FIELD_ORDER.items() for x in kv])
    # The outer form keeps the optimizer from inferring a filter on the span
    # array and pushing it down, which would run the whole scan a second time.
    return (scanned.select(*keys, F.posexplode_outer("spans").alias("span_ord", "s"))
            .where(F.col("s").isNotNull()).select(*keys, "span_ord", "s.*")
            .withColumn("field_ord", F.coalesce(field_ord[F.col("field")], F.lit(9))))


_EMPTY = f"cast(array() AS array<{SPAN}>)"

# An extra span either replaces the first listed span it overlaps (when it is
# more certain), is dropped, or is appended.
_MERGE = f"""aggregate(extra, coalesce(base, {_EMPTY}), (kept, x) ->
    CASE WHEN exists(kept, k -> x.start < k.`end` AND x.`end` > k.start) THEN
        transform(kept, (k, i) -> CASE
            WHEN i = array_position(transform(kept, j -> x.start < j.`end` AND x.`end` > j.start), true) - 1
                 AND x.confidence > k.confidence THEN x ELSE k END)
    ELSE concat(kept, array(x)) END)"""
_ORDERED = (f"array_sort({_MERGE}, (x, y) -> CASE WHEN x.start <> y.start "
            "THEN x.start - y.start ELSE x.`end` - y.`end` END)")
_PARTS = ("field", "type", "value", "start", "end", "confidence", "method")


def merge_span_arrays(df: DataFrame, base: str, extra: str, out: str = "spans") -> DataFrame:
    """Merge two span arrays of one field; overlaps keep the surer span."""
    carried = [c for c in df.columns if c not in (base, extra, out)]
    merged = df.select(*carried, F.expr(f"coalesce({base}, {_EMPTY})").alias("base"),
                       F.expr(f"coalesce({extra}, {_EMPTY})").alias("extra"))
    return merged.select(*carried, F.expr(_ORDERED).alias(out))


def merge_span_tables(base: DataFrame, extra: DataFrame,
                      keys: tuple[str, ...] = (*ELEMENT_KEY, "field")) -> DataFrame:
    """Combine pattern spans with spans from another detector, per field.

    Both sides are span rows; the result has one row per field with the merged
    array, ordered by place.  The sorted spans of both sides are cut wherever
    no earlier span reaches on; only spans of one such stretch can overlap, and
    only they are compared.
    """
    def rows(df: DataFrame, side: int) -> DataFrame:
        return df.select(*keys, F.lit(side).alias("_side"), F.struct(*[F.col(p) for p in _PARTS]).cast(SPAN).alias("s"))

    order = [F.col("s.start"), F.col("s.end"), F.col("s.type"), F.col("_side")]
    line = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("s.end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    both = rows(base, 0).unionByName(rows(extra, 1))
    both = both.withColumn("_opens", F.when(reach.isNull() | (F.col("s.start") >= reach), 1).otherwise(0))
    both = both.withColumn("_stretch", F.sum("_opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))

    def listed(side: int, name: str) -> Column:
        item = F.when(F.col("_side") == side, F.struct("s.start", "s.end", "s.type", "s"))
        return F.array_sort(F.collect_list(item)).alias(name)

    packed = both.groupBy(*keys, "_stretch").agg(listed(0, "_base"), listed(1, "_extra"))
    packed = packed.select(*keys, "_stretch", *[F.expr(f"cast(transform(_{n}, x -> x.s) AS array<{SPAN}>)").alias(n) for n in ("base", "extra")])
    merged = packed.select(*keys, "_stretch", F.expr(_ORDERED).alias("m"))
    stretches = F.array_sort(F.collect_list(F.struct("_stretch", "m")))
    return merged.groupBy(*keys).agg(F.flatten(F.transform(stretches, lambda x: x["m"])).alias("spans"))


def span_density(spans: DataFrame, by: tuple[str, ...] = ("type", "method")) -> DataFrame:
    return spans.groupBy(*by).agg(F.count("*").alias("n_spans"))


def spans_on_lines(spans: DataFrame, lines: DataFrame, key: str = "image_id") -> DataFrame:
    """Spans with every text line they cross: equal image, overlapping offsets."""
    return overlap_join(spans, lines, [key], ("start", "end"), ("line_start", "line_end"))
