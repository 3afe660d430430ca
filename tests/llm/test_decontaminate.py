import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cloakframe.llm import decontaminate as dc


def words(t):
    return [w for w in (x.lower().strip(dc.MARKS) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")) if w]


def nearest(item, text):
    """Edit distance of the item to the best run of words of the text."""
    last = [0] * (len(text) + 1)
    for k, w in enumerate(item, 1):
        now = [k]
        for j, v in enumerate(text, 1):
            now.append(min(last[j - 1] + (v != w), last[j] + 1, now[-1] + 1))
        last = now
    return min(last)


def edited(r, item, edits, fresh):
    out = list(item)
    for _ in range(edits):
        at = r.randrange(len(out))
        kind = r.randrange(3)
        out[at : at + (kind != 1)] = [fresh()] if kind < 2 else []
    return out


def fixture(seed=3):
    r = random.Random(seed)
    fresh = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    common = [fresh() for _ in range(40)]
    prose = lambda n: [r.choice(common) if r.random() < 0.6 else fresh() for _ in range(n)]
    items = [prose(r.randint(10, 50)) for _ in range(25)]
    docs = []
    for k in range(300):
        body, item = prose(r.randint(0, 300)), items[k % 25]
        if k % 3:
            put = edited(r, item, r.randint(0, math.floor(0.2 * len(item)) + 2), fresh)
            at = r.randint(0, len(body))
            body[at:at] = put
        docs.append(" ".join(body))
    return docs, [" ".join(i) for i in items]


def test_against_brute_force(spark, frame):
    docs, items = fixture()
    texts = [*docs, None, "", "  ", items[0].upper() + "!", items[1] + " " + items[1], f"«{items[2]}»"]
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*items, None, "", "too short", items[3]])], "item_id long, text string, doc_id string")
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate([*items, None, "", "too short", items[3]]):
            item = words(x)
            if item and words(t):
                e = nearest(item, words(t))
                if e <= math.floor(0.2 * len(item)):
                    want[d, i] = e
    got = {(r.doc_id, r.item_id): r.edits for r in dc.contaminations(frame(texts), bench, items=9).collect()}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and len(want) > 150
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got)
    exact = {k for k, e in want.items() if e == 0}
    assert exact <= set(got)


def test_stage_keeps_clean_rows(spark, frame):
    docs, items = fixture()
    bench = spark.createDataFrame([(0, items[0])], "item_id long, text string")
    rows = frame([(1, items[0]), (2, "clean text"), (None, items[0]), (None, "clean"), (None, None), (3, None), (2, "clean text")])
    out = dc.drop_contaminated(rows, bench)
    assert out.columns == rows.columns
    assert sorted(map(str, (r.text for r in out.collect()))) == ["None", "None", "clean", "clean text", "clean text"]
    assert dc.contaminations(rows.limit(0), bench).count() == 0
    assert dc.contaminations(rows, bench.limit(0)).count() == 0


def test_substring_edits():
    item = np.array([1, 2, 3, 4], np.uint64)
    rows = np.array([[9, 1, 2, 3, 4, 9], [1, 2, 9, 3, 4, 9], [9, 9, 1, 3, 4, 9], [9] * 6], np.uint64)
    assert dc.substring_edits(item, rows).tolist() == [0, 1, 1, 4]


def recall(n, plant, seed=11, items=150):
    """Share of the planted copies of items of ``n`` words that the search finds, each between foreign words."""
    r = random.Random(seed + n)
    fresh = lambda: "w" + str(r.getrandbits(60))
    bench = [[fresh() for _ in range(n)] for _ in range(items)]
    texts = [" ".join([*(fresh() for _ in range(30)), *plant(r, item, fresh), *(fresh() for _ in range(30))]) for item in bench]
    ready = dc.prepare(list(range(items)), [" ".join(b) for b in bench], 0.2, 1, dc.RECALL)
    found = dc.search(ready, pa.array(texts))
    assert all(t == i and e <= math.floor(0.2 * n) for t, i, e, _ in found)
    return len(found) / items


LENGTHS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 18, 19, 25, 40, 60, 80]


@pytest.mark.parametrize("n", LENGTHS)
def test_recall_of_the_search_by_length(n):
    most = math.floor(0.2 * n)
    assert recall(n, lambda r, item, fresh: item) == 1
    assert recall(n, lambda r, item, fresh: edited(r, item, most, fresh)) >= 0.97
    if most:
        first = lambda r, item, fresh: [fresh(), *edited(r, item[1:], most - 1, fresh)]
        assert recall(n, first) >= 0.95


def test_at_least_three_places_are_sampled():
    r = random.Random(2)
    items = [" ".join("w" + str(r.getrandbits(60)) for _ in range(n)) for n in LENGTHS]
    ready = dc.prepare(list(range(len(items))), items, 0.2, 1, dc.RECALL)
    assert {n for _, _, ns in ready.groups for n in ns} == set(LENGTHS)
    assert all(k >= min(3, low) for (low, _, _), (k, *_) in zip(ready.groups, ready.tables, strict=True))


def test_short_items_long_texts_and_clashing_columns(spark, frame):
    bench = spark.createDataFrame([(1, "a brown fox", "p"), (2, "yes", "q"), (3, "one two three four five", "r")], "item_id long, text string, edits string")
    long = "word " * 200_000 + "a brown fox " + "word " * 200_000
    texts = [long, "a brown", "brown a fox", "Yes!", "one two six four five", "one two six seven five"]
    rows = frame(texts).selectExpr("doc_id", "text", "'x' AS item_id", "1 AS edits", "2 AS word_start")
    got = {(r.doc_id, r.item_id, r.edits, r.word_start) for r in dc.contaminations(rows, bench).collect()}
    assert {g[:3] for g in got} == {(0, 1, 0), (3, 2, 0), (4, 3, 1)} and (0, 1, 0, 200_000) in got
    kept = dc.drop_contaminated(rows, bench)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5}
    assert dc.drop_contaminated(rows.limit(0), bench).count() == 0
    assert dc.drop_contaminated(rows, bench.limit(0)).count() == len(texts)
