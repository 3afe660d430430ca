import random
import re
from collections import Counter

import numpy as np
import pytest

from cloakframe.llm import phrases
from cloakframe.llm.phrases import addresses, cells, collocations, counted, frequent_phrases, squeeze, tiles_of, unsqueeze

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, most, top, covered=100):
    """rows are (lang, text); the contract by plain counting."""
    f, n = {}, Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            lang = lang or "und"
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, seen in f.items():
        often = {p: a for p, a in seen.items() if a >= least}
        hidden = set()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= covered * often[p[i : i + k]]:
                        hidden.add(p[i : i + k])
        best = []
        for p, a in often.items():
            if len(p) > 1 and p not in hidden:
                score, _, l, r = min((1000 * a * n[lang] // (often[p[:k]] * often[p[k:]]), k, often[p[:k]], often[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def table(spark, rows):
    schema = "doc_id long, lang string, text string, block string, tile int, kind string, phrase int, n double"
    return spark.createDataFrame([(i, lang, text, "x", 1, "y", 2, 0.5) for i, (lang, text) in enumerate(rows)], schema).repartition(5)


def noisy(seed, n=250):
    r = random.Random(seed)
    words = ["the", "The", "of", "naïve", "日本", "a-b", "x", "New", "York", "\u0085q"] + [f"w{i}" for i in range(40)]
    weight = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(n):
        text = ""
        for w in r.choices(words, weight, k=r.choice([0, 1, 5, 60])):
            text += w + r.choice([" "] * 8 + ["\t", "  ", ". ", ", ", "\n", "\x0b", " \r\n ", "; and so on it goes "])
        rows.append((r.choice(["en", "en", "de", None]), text))
    return rows + [("en", None), (None, ""), ("fr", " .,;"), ("de", "New York of the naïve " * 4000)] + rows[:30] * 2


@pytest.mark.parametrize("seed,least", [(1, 5), (2, 20)])
def test_equals_plain_counts(spark, monkeypatch, seed, least):
    monkeypatch.setattr(phrases, "BLOCK", 3000)
    rows = noisy(seed)
    got = sorted(tuple(r) for r in collocations(table(spark, rows), least, top=50).collect())
    assert got == brute(rows, least, 5, 50) and len(got) > 20


def test_shorter_phrases_and_shares(spark):
    rows = noisy(4, 80)
    for most, covered in ((2, 100), (4, 60)):
        got = sorted(tuple(r) for r in collocations(table(spark, rows), 4, most, None, covered).collect())
        assert got == brute(rows, 4, most, None, covered)


def test_big_counts_are_exact(spark, monkeypatch):
    rows = [("en", "a b " * 3000), ("en", "a b c"), ("en", "c a")]
    phrases_of = {r.phrase: (r.f, r.n_words) for r in frequent_phrases(table(spark, rows), 2)[0].collect()}
    assert phrases_of["a b"] == (3001, 2) and phrases_of["b a b a b"] == (2998, 5) and "a b c" not in phrases_of


def test_nothing(spark):
    assert collocations(table(spark, [("en", "a b")]).limit(0)).count() == 0
    assert collocations(table(spark, [("en", "a b"), (None, None)])).count() == 0
    assert collocations(table(spark, [("en", "a. b. a. b."), ("en", "a, b")]), 2).count() == 0


def test_cells_round_trip():
    r = np.random.default_rng(1)
    for top in (600, 5000, 1 << 27):
        p, w = r.integers(0, top, 5000), r.integers(0, min(top, 1 << 27), 5000)
        tile = tiles_of(p, w)
        for t in np.unique(tile):
            m = tile == t
            address = addresses(int(t), p[m], w[m])
            back = cells(int(t), address)
            assert (back[0] == p[m]).all() and (back[1] == w[m]).all() and address.min() >= 0
            used, n = counted(int(t), address)
            assert dict(zip(used.tolist(), n.tolist())) == Counter(address.tolist())
    for v in ([], [0], [5, 5, 900], [3, 2**40, 2**50]):
        assert unsqueeze(squeeze(np.array(v), True)).tolist() == v == unsqueeze(squeeze(np.array(v))).tolist()
