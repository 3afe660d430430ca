import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cloakframe.llm import neardup, queries
from cloakframe.llm.components import components

DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((top(i), top(j)))
                    label[b] = a
    return {i: (len(sets[i]), top(i)) for i in range(len(texts))}


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    out = [None, "", " \n\t", "one", "One", "one two", "ONE  two", "same text here again", "same text here again", "x é Y", "x É y"]
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(r.choice((5, 30, 150, 600)))]
        for _ in range(r.randint(1, 14)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    for _ in range(70):  # many documents around one passage, near the threshold but not over it
        out.append(" ".join([*(word() for _ in range(r.randint(4, 30))), *passage]))
    for _ in range(60):  # a group larger than a short list
        copy = list(passage) * 1 + [f"w{k}" for k in range(120)]
        for _ in range(3):
            copy[r.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_against_all_pairs(frame, width, percent):
    texts = corpus()
    want = brute(texts, width, percent)
    rows = neardup.near_duplicates(frame(texts), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chain_component_and_stars(spark):
    n = 200
    links = [(k, k + 1) for k in range(n)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {1000 + k: 1000 for k in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimate_is_close_and_exact_for_small_sets():
    r = np.random.default_rng(0)
    pool = r.permutation(np.unique(r.integers(0, 2**63, 3000, dtype=np.uint64)))
    a, b = np.sort(pool[:2500]), np.sort(pool[200:2700])
    hit, of = neardup.estimate(a[:96], b[:96], 96)
    assert of == 96 and abs(hit / of - 2300 / 2700) < 0.2
    assert neardup.estimate(a[:50], a[10:60], 96) == (40, 60)


def test_odd_tables(spark, frame):
    empty = frame(["a"]).limit(0)
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).columns == empty.columns
    docs = frame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A b c d e f"), (11, None)])
    rows = sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())))
    assert rows == sorted(map(str, [(None, None, True)] * 2 + [(7, 7, True)] * 2 + [(9, 7, False), (11, 11, True)]))
    assert sorted(str(r.doc_id) for r in neardup.drop_near_duplicates(docs).collect()) == ["11", "7", "None", "None"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    names = "doc_id, n_shingles, component_id, kept"
    want = con.execute(f"select {names} from ({queries.SQL['op3_near_duplicates']})").fetchall()
    got = [tuple(r) for r in queries.op3_near_duplicates(spark, DIR).select(*names.split(", ")).collect()]
    assert sorted(got) == sorted(want) and any(not k for *_, k in want)


def test_edited_copies_of_one_text_are_joined_without_all_pairs(frame, monkeypatch):
    """The text links to all its copies, which do not link to each other."""
    rng, made = random.Random(12), []
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for c in range(400):
        words = list(base)
        for at in rng.sample(range(0, 120, 6), 3):
            words[at] = f"e{c}x{at}"
        texts.append(" ".join(words))
    proposals = neardup._proposals

    def counted(*args):
        pairs = proposals(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(neardup, "_proposals", counted)
    got = neardup.near_duplicates(frame(texts), width=3, percent=85).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert sum(made) < 40 * len(texts), made  # all pairs are 200 a text


def test_edited_copies_without_their_source_are_not_paired(frame, monkeypatch):
    """Hardly a copy links to another, each is near all: exact bounds end their pairs."""
    rng, made = random.Random(5), []
    texts = []
    for c in range(400):
        words = [f"w{i}" for i in range(120)]
        for at in rng.sample(range(3, 117, 6), 3):
            words[at] = f"e{c}x{at}"
        texts.append(" ".join(words))
    texts += [" ".join([*texts[0].split()[:-1], "end"]), texts[1]]
    proposals = neardup._proposals

    def counted(*args):
        pairs = proposals(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(neardup, "_proposals", counted)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(texts), width=3, percent=85).collect()}
    assert got == {i: top for i, (_, top) in brute(texts, 3, 85).items()}
    assert sum(made[1:]) < 20 * len(texts), made  # all pairs are 200 a text


def test_parities_never_exceed_the_difference():
    r = np.random.default_rng(4)
    for n, cut in ((50, 9), (700, 150), (5000, 0)):
        pool = np.unique(r.integers(0, 2**63, n + 2 * cut, dtype=np.uint64))
        a, b = np.delete(pool, range(cut)), pool[: len(pool) - cut]
        x, y = (np.unpackbits(np.frombuffer(neardup.parities(s), np.uint8)) for s in (a, b))
        assert (x != y).sum() <= len(np.setxor1d(a, b)) and (cut or not (x != y).any())
