import hashlib
import math
import random
import re

import pytest

from cloakframe.llm.mixing import knots, mix, mixed_documents, source_targets, training_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """documents with clashing columns; rows are (doc_id, text, source)."""
    schema = "doc_id long, text string, source string, lang string, size long, target string, row int, _range int, taken string"
    return spark.createDataFrame([(*r, "en", -1, "x", 7, 3, "y") for r in rows], schema).repartition(3)


def filled(sizes, weights, most=3.0):
    """Targets by repeated resharing."""
    whole, capped = sum(sizes.values()), set()
    while True:
        left = whole - sum(most * sizes[s] for s in capped)
        free = sum(weights[s] for s in sizes if s not in capped)
        out = {s: most * sizes[s] if s in capped else weights[s] * left / free for s in sizes}
        over = {s for s in sizes if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def brute(rows):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    target = filled(total, weights) if sum(size) else dict.fromkeys(names, 0.0)
    digest = [hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest() for d, t, _ in rows]
    out = []
    for s in names:
        at, quota = 0, math.floor(target[s] + 0.5)
        for i in sorted((i for i in range(len(rows)) if rows[i][2] == s), key=lambda i: (digest[i], rows[i][0] or -1)):
            taken = sum(min(size[i], max(0, quota - at - p * total[s])) for p in range(3))
            out.append((rows[i][0], size[i], total[s], round(target[s], 6), taken))
            at += size[i]
    return sorted(out, key=str)


def rows_of(seed):
    r = random.Random(seed)
    rows = [(i, " ".join("ab" for _ in range(r.choice([0, 1, 3, 30]))), r.choice(["a", "b", "é", "Z", None, "hot", "hot", "hot"])) for i in range(150)]
    rows += [(200, "x " * 5000, "b"), (201, None, "a"), (202, "", None), (203, " \t\n", "hot"), (None, "a b c", "a"), (None, None, None)]
    return rows + [(204, "one two", "tiny"), (204, "one two", "tiny"), (205, "again", "a"), (205, "other", "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_resharing_and_streams(spark, seed):
    rows = rows_of(seed)
    got = mixed_documents(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute(rows)
    assert all(r.taken <= 3 * r["size"] for r in got)
    again = mixed_documents(table(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_order_follows_the_schedule(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(2000)]
    wave = spark.createDataFrame([("a", [(0.0, 2.0), (0.5, 2.0), (1.0, 0.0)]), ("b", [(0.0, 0.0), (1.0, 3.0)]), ("none", [(0.0, 1.0), (1.0, 1.0)])],
                                 "source string, schedule array<struct<t: double, w: double>>")
    mixed = mix(table(spark, rows), wave)
    order = training_order(mixed).orderBy("place").collect()
    assert [r.place for r in order] == list(range(len(order)))
    assert all(x.time <= y.time for x, y in zip(order, order[1:]))
    taken = {s: sum(r.words for r in order if r.source == s) for s in "ab"}
    assert taken == {"a": 10000, "b": 10000}
    done = {"a": lambda t: (2 * t if t <= 0.5 else 1 + (t - 0.5) * 2 - 2 * (t - 0.5) ** 2) / 1.5, "b": lambda t: t * t}
    for t in (0.1, 0.4, 0.6, 0.9):
        for s in "ab":
            share = sum(r.words for r in order if r.source == s and r.time < t) / taken[s]
            assert abs(share - done[s](t)) < 0.01


def test_targets_of_capped_sources(spark):
    sizes = {"a": 1000, "b": 10, "c": 0, "d": 5, "e": 700, "f": 30}
    table_ = spark.createDataFrame([(False, s, n) for s, n in sizes.items()], "_none boolean, _source string, source_size long")
    got = {r["_source"]: r.target for r in source_targets(table_).collect()}
    want = filled(sizes, {s: i % 3 + 1 for i, s in enumerate(sizes)})
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1745)
    flat = source_targets(table_, lambda rank: knots((0, 0.0), (1, 0.0)))
    assert {r.target for r in flat.collect()} == {0.0}


def test_nothing(spark):
    assert mixed_documents(table(spark, [(1, "a", "b")]).limit(0)).count() == 0
    got = mixed_documents(table(spark, [(1, None, None), (2, "", "b")])).collect()
    assert {(r.doc_id, r.target, r.taken, r.first_place) for r in got} == {(1, 0.0, 0, None), (2, 0.0, 0, None)}


def test_main_path_has_no_python(spark):
    plan = mix(table(spark, rows_of(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
