import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from cloakframe.llm.conversations import SYMBOLS, Solver, classes, damage, repair_report, repaired_conversations

STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def cheapest(rows):
    """(cost, audit, repaired rows) by trying all edits; rows are (role, text, must go, truncated)."""

    @lru_cache(None)
    def go(i, g, inserted):
        out = [(0, "", ())] if i == len(rows) and g in (0, 3) else []
        for name in ("user", "assistant"):
            if inserted < 4 and g in STEPS[name[0]]:
                c, a, made = go(i, STEPS[name[0]][g], inserted + 1)
                out.append((3 + c, "I" + a, (f"{name}:", *made)))
        if i < len(rows):
            role, text, must, late = rows[i]
            c, a, made = go(i + 1, g, 0)
            out.append((4 + c, "D" + a, made))
            for edit, name, price in [] if must else [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                if g in STEPS.get(name[:1], {}):
                    c, a, made = go(i + 1, STEPS[name[:1]][g], 0)
                    out.append((price + 3 * late + c, edit + a, (f"{name}:{text}", *made)))
        return min(out) if out else (10**6, "~", ())

    return go(0, 0, 0)


def expected(rows, damaged=True):
    """The report of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
            if draw == 0:
                continue
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            mine += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, counts, marked = set(), [0, 0, 0], []
        for _, role, text in mine:
            sound = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not sound else 1 if (role, text) in seen else 2 if sound[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            marked.append((role, text, fault < 2, fault == 2))
        turns = {r[0] for r in mine if r[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, made = cheapest(tuple(marked))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def table(spark, rows):
    schema = "conv_id long, turn long, role string, text string, kind string, audit int, piece long, n string"
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], schema).repartition(3)


def report(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def noisy(seed, convs=150):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Hm", "", " \t\n", "Tell me more?", "So it is. ", None, "naïve — 日本。", "ends.\u0085", "a.b"]
    rows = []
    for conv in range(convs):
        for turn in range(r.choice([0, 1, 2, 5, 9])):
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, 1, None]), r.choice(["user", "assistant", "system", "tool", "", None, "admin"]), r.choice(texts)))
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, "user", "c"), (900, 4, "user", "x" * 100000 + "."), (901, None, None, None)]
    return rows + rows[:20]


@pytest.mark.parametrize("seed,limit", [(1, 4096), (2, 3), (3, 1)])
def test_equals_all_edits(spark, seed, limit):
    rows = noisy(seed)
    df = table(spark, rows)
    assert report(repair_report(damage(df), df, limit)) == expected(rows)


def test_long_conversation_in_pieces(spark):
    r = random.Random(5)
    rows = [(7, t // 3, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "No", "", f"{t}."])) for t in range(900)]
    whole, cut = report(repair_report(table(spark, rows))), report(repair_report(table(spark, rows), limit=17))
    assert whole == cut and len(whole[7][6]) >= 900
    many = [(1, 1, "user", "same.")] * 300 + [(1, 2, "assistant", "other.")]
    assert report(repair_report(table(spark, many), limit=64))[1][:7] == (0, 0, 299, 0, 299, 299 * 4, "K" + "D" * 299 + "K")


def test_repaired_rows_have_the_digest(spark):
    df = table(spark, noisy(4, 60))
    made = {}
    for r in repaired_conversations(damage(df)).orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.place == len(made[r.conv_id]) - 1
    for conv, row in report(repair_report(damage(df), df)).items():
        assert row[-1] == hashlib.sha256("\n".join(made.get(conv, [])).encode()).hexdigest()


def test_nothing(spark):
    none = table(spark, [(1, 1, "user", "a.")]).limit(0)
    assert report(repair_report(damage(none), none)) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = table(spark, [(dropped, 0, "user", "a.")])
    assert report(repair_report(damage(df), df)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_nodes_are_shared():
    signatures = sorted({"".join(p) for n in range(5) for p in itertools.product(SYMBOLS, repeat=n)}, key=lambda s: s[::-1])
    solver = Solver()
    for s in signatures:
        rows = tuple(({"x": "tool", "s": "system", "u": "user", "a": "assistant", "o": "tool"}[k.lower()], "", k == "x", k.isupper()) for k in s)
        assert solver.solve(s, 0, 0, True) == cheapest(rows)[:2]
    assert solver.visited == len(signatures) - 1  # every suffix but the empty one, once
    assert len(classes().nodes) < 100
