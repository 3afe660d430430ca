import random
import re

import numpy as np

from cloakframe.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, least):
    """Word positions that stand in a window of ``least`` words found in another document."""
    seen = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), set()).add(d)
    out = set()
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i : i + least])]) > 1:
                out |= {(d, i + k) for k in range(least)}
    return out


def corpus(seed=4):
    r = random.Random(seed)
    fresh = lambda n: ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 60, 75, 200, 400)]
    out = [None, "", "short text", " ".join(["ther"] * 300), " ".join(passages[5]), " ".join(passages[5]).upper(), " ".join(passages[5])]
    for k in range(120):
        body = fresh(r.randint(0, 150))
        for p in r.sample(passages, r.randint(0, 2)):
            body += p + fresh(r.randint(0, 40))
        out.append(" ".join(body))
    out += [" ".join(fresh(30) + passages[3][:55] + fresh(20)) for _ in range(40)]
    return list(enumerate(out)) + [(900, " ".join(fresh(200)))] * 2 + [(None, " ".join(passages[5]))]


def covered(rows):
    return {(r.doc_id, i) for r in rows for i in range(r.start_word, r.end_word)}


def test_spans_against_all_windows(frame):
    rows = corpus()
    want = brute([(d, t) for d, t in rows if d is not None], 50)
    got = repeats.repeated_passages(frame(rows)).collect()
    assert covered(got) == want
    assert all(r.n_words == r.end_word - r.start_word >= 50 and r.other_doc_id != r.doc_id for r in got)
    assert repeats.repeated_passages(frame(["a"]).limit(0)).count() == 0


def test_every_window_holds_a_retained_position():
    r = np.random.default_rng(0)
    code = r.integers(0, 2**63, 3000, dtype=np.uint64)
    at, grams = repeats.retained(code, np.array([0, 40, 3000]), 10, 50)
    assert at.min() >= 40 and np.diff(np.concatenate([[39], at, [2991]])).max() <= 41
    assert len(at) < 0.1 * len(code)
    again, _ = repeats.retained(np.concatenate([code[:7], code[500:600]]), np.array([0, 7, 107]), 10, 50)
    assert set(again - 7 + 500) & set(at.tolist())


def test_common_footer_hides_no_partner(frame):
    """45 words stand in very many documents; a few of them also share the words before, in pairs."""
    r = random.Random(7)
    fresh = lambda n: ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(n)]
    footer = fresh(45)
    lead = [fresh(10) for _ in range(20)]
    rows = [(k, " ".join(fresh(20) + (lead[k % 20] if k < 40 else fresh(10)) + footer)) for k in range(600)]
    r.shuffle(rows)
    want = brute(rows, 50)
    assert {d for d, _ in want} == set(range(40))
    assert covered(repeats.repeated_passages(frame(rows)).collect()) == want


def test_copies_in_one_document_hide_no_partner(frame):
    """One document holds a passage 40 times, another one once; so with a text of one word."""
    r = random.Random(8)
    fresh = lambda n: ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(n)]
    passage, often = fresh(60), []
    for _ in range(40):
        often += passage + fresh(5)
    rows = [(1, " ".join(often)), (2, " ".join(fresh(30) + passage + fresh(30))), (3, " ".join(["ther"] * 300)), (4, " ".join(["ther"] * 80 + fresh(30)))]
    assert covered(repeats.repeated_passages(frame(rows)).collect()) == brute(rows, 50)


def test_texts_with_one_id_are_each_searched(frame):
    """Document 5 is a spare copy by one text and shares a passage with document 9 by the other."""
    r = random.Random(9)
    fresh = lambda n: ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(n)]
    copied, passage = fresh(80), fresh(60)
    rows = [(1, " ".join(copied)), (5, " ".join(copied)), (5, " ".join(fresh(7) + passage + fresh(3))), (9, " ".join(fresh(20) + passage))]
    got = repeats.repeated_passages(frame(rows)).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.other_doc_id) for r in got) == [(1, 0, 80, 5), (5, 0, 80, 1), (5, 7, 67, 9), (9, 20, 80, 5)]
    assert len({r.text_id for r in got}) == 3


def test_window_hashes_depend_on_the_words_alone():
    r = np.random.default_rng(1)
    code = r.integers(0, 2**63, 400, dtype=np.uint64)
    code[200:260] = code[20:80]
    for least in (1, 2, 10, 47, 50, 64):
        for salt in (0, 1):
            h = repeats.window_hashes(code, least, salt)
            assert len(h) == 400 - least + 1 and len(np.unique(h)) == len(h) - max(0, 61 - least)
            assert (h[200 : 261 - least] == h[20 : 81 - least]).all()
