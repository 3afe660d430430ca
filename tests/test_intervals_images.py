"""Joins by blocks and the image source against plain Python."""

import random
import struct

import pytest

from cloakframe.operators import ner, spans
from cloakframe.operators.intervals import overlap_join, points_in_boxes
from cloakframe.operators.targets import resolve_targets
from cloakframe.sources.images import header, read_images


@pytest.mark.parametrize("width", [1, 7, 1024])
def test_overlaps_equal_all_pairs(spark, width):
    rng = random.Random(width)
    def rows(n, longest):
        return [(rng.choice("ab"), i, s, s + rng.choice([0, 1, rng.randint(0, longest)])) for i in range(n) for s in [rng.randint(0, 60)]]
    left, right = rows(80, 12), rows(60, 40)
    l = spark.createDataFrame(left, "k string, i int, a int, b int")
    r = spark.createDataFrame(right, "k string, j int, c int, d int")
    got = sorted((x.i, x.j) for x in overlap_join(l, r, ["k"], ("a", "b"), ("c", "d"), width).collect())
    assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < y[3] and x[3] > y[2])


def test_points_equal_all_pairs(spark):
    rng = random.Random(5)
    boxes = [(rng.choice("ab"), i, rng.uniform(-50, 900), rng.uniform(-50, 900), rng.choice([0.0, 3.0, 64.0, 800.0, 5000.0, -2.0]), rng.choice([0.0, 64.0, 1e5])) for i in range(120)]
    points = [(rng.choice("ab"), i, *rng.choice([(rng.uniform(0, 1000), rng.uniform(0, 1000)), boxes[i][2:4], (None, 3.0)])) for i in range(80)]
    b = spark.createDataFrame(boxes, "k string, i int, x double, y double, w double, h double")
    p = spark.createDataFrame(points, "k string, j int, px double, py double")
    got = sorted((r.j, r.i) for r in points_in_boxes(p, b, ["k"], ("px", "py"), ("x", "y", "w", "h")).collect())
    assert got == sorted((q[1], c[1]) for q in points for c in boxes if q[0] == c[0] and q[2] is not None
                         and c[2] <= q[2] <= c[2] + c[4] and c[3] <= q[3] <= c[3] + c[5])


def test_targets_by_selector_text_and_point(spark):
    e = spark.createDataFrame(
        [("s", 0, 0, "e0", "#a", "Buy now", None, [0.0, 0.0, 100.0, 50.0]), ("s", 0, 1, "e1", "#b", " Buy later ", "v", [0.0, 0.0, 40.0, 20.0]),
         ("s", 0, 2, "e2", "#b", None, None, None), ("t", 0, 0, "f0", "#a", "Buy", None, [0.0, 0.0, 1.0, 1.0])],
        "session_id string, step_no bigint, element_pos int, element_id string, selector string, text string, value string, coordinates array<double>")
    steps = spark.createDataFrame(
        [("s", 0, 1, "#b", "Buy now", 1.0, 1.0), ("s", 0, 2, "#x", "uy", 1.0, 1.0), ("s", 0, 3, "#x", "none", 10.0, 10.0), ("s", 0, 4, "#x", "", 90.0, 40.0),
         ("s", 0, 5, "#x", "", 101.0, 0.0), ("t", 0, 6, "#x", "later", None, None)],
        "session_id string, step_no bigint, step_id int, target_selector string, target_text string, target_x double, target_y double")
    got = {r.step_id: (r.element_id, r.matched_by) for r in resolve_targets(steps, e).collect()}
    assert got == {1: ("e1", 1), 2: ("e0", 2), 3: ("e1", 3), 4: ("e0", 3), 5: (None, None), 6: (None, None)}


def test_dedupe_equals_one_fold(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), s, s + rng.randint(0, 12), rng.choice("NA"), f"v{i}", rng.choice([0.5, 0.7, 0.9])) for i in range(300) for s in [rng.randint(0, 150)]]
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, type string, value string, confidence double")
    want = []
    for doc in range(3):
        last = None
        for x in sorted(r[1:] for r in rows if r[0] == doc):
            if last is not None and x[0] >= last[0] and x[1] <= last[1] + 5 and x[2] == last[2]:
                last = x if x[4] > last[4] else last
                continue
            want += [(doc, *last)] if last else []
            last = x
        want.append((doc, *last))
    assert sorted(tuple(r) for r in ner.dedupe_spans(df).collect()) == sorted(want)


def test_merge_equals_one_fold(spark):
    rng = random.Random(7)
    def rows(n, conf):
        return [(rng.randrange(4), "text", "T", f"v{i}", s, s + rng.randint(1, 9), rng.choice(conf), "M") for i in range(n) for s in [rng.randint(0, 120)]]
    base, extra = rows(60, [0.8]), rows(80, [0.5, 0.8, 0.9])
    schema = "doc_id int, field string, type string, value string, start int, end int, confidence double, method string"
    got = {r.doc_id: [(s.start, s.end, s.value) for s in r.spans] for r in spans.merge_span_tables(
        spark.createDataFrame(base, schema), spark.createDataFrame(extra, schema), ("doc_id", "field")).collect()}
    order = lambda r: (r[4], r[5], r[2], r[1], r[2], r[3])
    for doc in range(4):
        kept = sorted((r for r in base if r[0] == doc), key=order)
        for x in sorted((r for r in extra if r[0] == doc), key=order):
            over = [i for i, k in enumerate(kept) if x[4] < k[5] and x[5] > k[4]]
            if not over:
                kept.append(x)
            elif x[6] > kept[over[0]][6]:
                kept[over[0]] = x
        assert sorted(got[doc]) == sorted((k[4], k[5], k[3]) for k in kept) and [g[:2] for g in got[doc]] == sorted(g[:2] for g in got[doc])


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
JPEG = b"\xff\xd8\xff\xe0\0\x10" + b"J" * 14 + b"\xff\xc4\0\x04ab\xff\xc2\0\x11\x08" + struct.pack(">HH", 33, 44) + b"\x03"
IMAGES = {
    "a.png": (PNG, ("png", 640, 480)), "b.jpg": (JPEG, ("jpeg", 44, 33)), "c.gif": (b"GIF89a" + struct.pack("<HH", 7, 9), ("gif", 7, 9)),
    "d.bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 12, -13), ("bmp", 12, 13)), "e.webp": (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + b"\x0f\0\0\x1f\0\0", ("webp", 16, 32)),
    "f.bin": (b"?", (None, None, None)), "g.png": (PNG[:20], (None, None, None)), "h.jpg": (b"\xff\xd8\xff\xda\0\0", ("jpeg", None, None)),
}


def test_image_headers(spark, tmp_path):
    for name, (data, _) in IMAGES.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.width, r.height, r.length) for r in read_images(spark, str(tmp_path)).collect()}
    want = {name: (*found, len(data)) for name, (data, found) in IMAGES.items()}
    want["h.jpg"] = (None, None, None, len(IMAGES["h.jpg"][0]))
    assert got == want and header(None) == header(b"") == (None, None, None)
    assert read_images(spark, str(tmp_path), "*.gif").count() == 1
