"""Cleaning and parsing of raw model text into typed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUM4 = r"(\d+),\s*(\d+),\s*(\d+),\s*(\d+)"
# --- fixed values: notations of a box (top, left, bottom, right) in 0..1000 ---
BOX_FORMS = (
    rf"<\|box_start\|>\({_NUM4}\)<\|box_end\|>",
    rf"\[{_NUM4}\]",
    rf"\({_NUM4}\)",
)
FIRST_OBJECT = r"(?s)\{.*?\}"


def _whole(value: Column) -> Column:
    return value.cast("int")


def _scaled(value: Column, extent: Column) -> Column:
    """0..1000 to pixels, truncated."""
    return _whole(value.cast("double") / 1000.0 * extent)


def _result(cx: Column, cy: Column, x: Column, y: Column, w: Column, h: Column, conf: float) -> Column:
    return F.struct(_whole(cx).alias("cx"), _whole(cy).alias("cy"), _whole(x).alias("x"),
                    _whole(y).alias("y"), _whole(w).alias("w"), _whole(h).alias("h"),
                    F.lit(conf).alias("confidence"))


def _from_edges(top: Column, left: Column, bottom: Column, right: Column,
                width: Column, height: Column) -> Column:
    x1, x2 = _scaled(left, width), _scaled(right, width)
    y1, y2 = _scaled(top, height), _scaled(bottom, height)
    return _result(F.floor((x1 + x2) / 2), F.floor((y1 + y2) / 2), x1, y1,
                   F.greatest(F.lit(1), x2 - x1), F.greatest(F.lit(1), y2 - y1), 0.95)


def grounding(text: Column, width: Column, height: Column) -> Column:
    """Centre and box named in a model's answer; confidence 0 if there is none."""
    out = None
    for form in BOX_FORMS:
        edges = [F.regexp_extract(text, form, i) for i in range(1, 5)]
        found = _from_edges(*[F.when(e != "", e) for e in edges], width, height)
        hit = F.regexp_like(text, F.lit(form))
        out = F.when(hit, found) if out is None else out.when(hit, found)
    obj = F.regexp_extract(text, FIRST_OBJECT, 0)
    point = F.from_json(F.get_json_object(obj, "$.point"), "array<double>")
    px, py = point[0], point[1]
    scale = (px <= 1000) & (py <= 1000) & ((width > 1000) | (height > 1000))
    sx = F.when(scale, _scaled(px, width)).otherwise(px)
    sy = F.when(scale, _scaled(py, height)).otherwise(py)
    at_point = _result(sx, sy, F.greatest(F.lit(0), sx - 15), F.greatest(F.lit(0), sy - 15),
                       F.lit(30), F.lit(30), 0.90)
    edges4 = F.from_json(F.get_json_object(obj, "$.bbox"), "array<double>")
    in_box = _from_edges(edges4[0], edges4[1], edges4[2], edges4[3], width, height)
    none = F.lit(None).cast("int")
    return (out.when(F.size(point) == 2, at_point).when(F.size(edges4) == 4, in_box)
            .otherwise(_result(none, none, none, none, none, none, 0.0)))


def vision_answer(text: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Screen type, confidence and layout flags of a model's answer, with defaults.

    The whole outermost object is read, as layout and regions are nested.  With
    a screen size, ``detected_regions`` holds its boxes (x, y, w, h) in pixels.
    """
    obj = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    got = F.from_json(obj, "screen_type string, confidence double, layout struct<visual_density:string,"
                           "has_active_modal:boolean,has_sticky_footer:boolean,canvas_heavy:boolean>, "
                           "detected_regions array<struct<type:string,label:string,bbox_1000:array<double>,bbox:array<double>>>")
    bad = F.try_parse_json(obj).isNull()
    layout = got["layout"]

    def region(r: Column) -> Column:
        b = F.coalesce(F.when(F.size(r["bbox_1000"]) > 0, r["bbox_1000"]), r["bbox"])
        x, y = _scaled(b[1], width), _scaled(b[0], height)
        box = F.array(x, y, F.greatest(F.lit(1), _scaled(b[3], width) - x), F.greatest(F.lit(1), _scaled(b[2], height) - y))
        return F.struct(F.coalesce(r["type"], F.lit("element")).alias("type"), F.when(F.size(b) == 4, box).alias("bbox"),
                        F.coalesce(r["label"], F.lit("")).alias("label"))

    regions = []
    if width is not None and height is not None:
        placed = F.filter(F.transform(got["detected_regions"], region), lambda r: r["bbox"].isNotNull())
        regions = [F.when(bad | placed.isNull(), F.filter(placed, lambda r: F.lit(False))).otherwise(placed).alias("detected_regions")]
    return F.struct(
        *regions,
        F.when(bad, "unknown").otherwise(F.coalesce(got["screen_type"], F.lit("unknown"))).alias("screen_type"),
        F.when(bad, 0.5).otherwise(F.coalesce(got["confidence"], F.lit(0.85))).alias("confidence"),
        F.coalesce(layout["visual_density"], F.lit("medium")).alias("visual_density"),
        F.coalesce(layout["has_active_modal"], F.lit(False)).alias("has_active_modal"),
        F.coalesce(layout["has_sticky_footer"], F.lit(False)).alias("has_sticky_footer"),
        F.coalesce(layout["canvas_heavy"], F.lit(False)).alias("canvas_heavy"))


def obstacle_answer(text: Column, width: Column, height: Column) -> Column:
    obj = F.regexp_extract(text, FIRST_OBJECT, 0)
    got = F.from_json(obj, "has_obstacle boolean, obstacle_type string, confidence double, "
                           "description string, suggested_action string, "
                           "dismiss_button_coords array<double>")
    bad = F.try_parse_json(obj).isNull()
    c = got["dismiss_button_coords"]
    full = F.size(c) == 4
    return F.struct(
        F.coalesce(got["has_obstacle"], F.lit(False)).alias("has_obstacle"),
        F.coalesce(got["obstacle_type"], F.lit("none")).alias("obstacle_type"),
        F.when(bad, 0.5).otherwise(F.coalesce(got["confidence"], F.lit(0.9))).alias("confidence"),
        F.when(bad, F.left(text, F.lit(150))).otherwise(
            F.coalesce(got["description"], F.lit(""))).alias("description"),
        F.coalesce(got["suggested_action"], F.lit("NONE")).alias("suggested_action"),
        F.when(full, _scaled((c[1] + c[3]) / 2, width)).alias("dismiss_x"),
        F.when(full, _scaled((c[0] + c[2]) / 2, height)).alias("dismiss_y"))


def verify_answer(text: Column) -> Column:
    obj = F.regexp_extract(text, FIRST_OBJECT, 0)
    got = F.from_json(obj, "verified boolean, change_detected boolean, confidence double, reasoning string")
    bad = F.try_parse_json(obj).isNull()
    return F.struct(
        F.coalesce(got["verified"], F.lit(True)).alias("verified"),
        F.coalesce(got["change_detected"], F.lit(True)).alias("change_detected"),
        F.when(bad, 0.6).otherwise(F.coalesce(got["confidence"], F.lit(0.9))).alias("confidence"),
        F.when(bad, F.left(text, F.lit(200))).otherwise(F.coalesce(got["reasoning"], F.lit(""))).alias("reasoning"))


def clean_model_text(text: Column) -> Column:
    """Drop thinking parts and a code fence; keep the outermost braces."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    t = F.trim(F.regexp_replace(t, r"(?s)<think>.*", ""))
    fence = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"
    t = F.when(F.regexp_like(t, F.lit(fence)), F.trim(F.regexp_extract(t, fence, 1))).otherwise(t)
    outer = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(outer != "", outer).otherwise(t)


def repair_json(text: Column) -> Column:
    """Fix trailing commas, line comments, missing commas and control characters."""
    t = F.regexp_replace(text, r",\s*([}\]])", "$1")
    t = F.regexp_replace(t, r"//[^\n]*", "")
    t = F.regexp_replace(t, r"\}\s*\{", "}, {")
    t = F.regexp_replace(t, r"\]\s*\[", "], [")
    t = F.regexp_replace(t, r"[\x00-\x1f\x7f]", " ")
    t = F.regexp_replace(t, r"  +", " ")
    upto = F.regexp_extract(t, r"(?s)^.*\}", 0)
    return F.when(upto != "", upto).otherwise(t)


def parsed_model_json(text: Column) -> Column:
    """Cleaned text that parses, repaired if need be; null when it cannot be."""
    clean = clean_model_text(text)
    fixed = repair_json(clean)
    return F.when(F.try_parse_json(clean).isNotNull(), clean).when(
        F.try_parse_json(fixed).isNotNull(), fixed)


def image_bytes(encoded: Column) -> Column:
    """Bytes of a base64 string or data URL."""
    return F.unbase64(F.substring_index(encoded, ",", -1))
