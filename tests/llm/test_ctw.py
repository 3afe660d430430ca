import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import pytest

from cloakframe.llm import ctw

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def brute(rows, depth):
    """Context-tree weighting straight from its definition."""
    counts = Counter()
    train = [lower(t).encode() for d, t in rows if not held(d)]

    def predictions(body):
        line = b"\xff" * depth + body + b"\xff"
        for p in range(depth, len(line)):
            for i in range(8):
                yield line[p - depth : p], (1 << i) | (line[p] >> (8 - i)), (line[p] >> (7 - i)) & 1

    for body in train:
        for ctx, node, bit in predictions(body):
            for d in range(depth + 1):
                counts[ctx[depth - d :], node, bit] += 1
    longer = {}
    for ctx, node, _ in list(counts):
        if ctx:
            longer.setdefault((ctx[1:], node), set()).add(ctx)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    @cache
    def node_log(ctx, node):
        a, b = counts[ctx, node, 0], counts[ctx, node, 1]
        own = kt(a, b) if a + b else 0.0
        if len(ctx) == depth:
            return own, 0.0, own
        rest = sum(node_log(c, node)[2] for c in longer.get((ctx, node), ()))
        hi = max(own, rest)
        return own, rest, hi + math.log(math.exp(own - hi) + math.exp(rest - hi)) - math.log(2)

    def p_one(ctx, node, d=0):
        s = ctx[depth - d :]
        a, b = counts[s, node, 0], counts[s, node, 1]
        mine = (b + 0.5) / (a + b + 1)
        if d == depth:
            return mine
        own, rest, _ = node_log(s, node)
        w = 1 / (1 + math.exp(min(700, rest - own)))
        return w * mine + (1 - w) * p_one(ctx, node, d + 1)

    words = Counter(w for d, t in rows if not held(d) for w in WORD.findall(lower(t)))
    n = sum(words.values()) + len(train)
    v = len(words) + bool(train)
    out = []
    for d, t in rows:
        toks = WORD.findall(lower(t))
        cs = [words[w] for w in toks] + [len(train)]
        score = sum(math.log10(p if bit else 1 - p) for ctx, node, bit in predictions(lower(t).encode()) for p in [p_one(ctx, node)])
        out.append((d, held(d), len(cs), sum(c > 0 for c in cs), n, sum(math.log10((c + 1) / (n + v + 1)) for c in cs), score))
    return out


def texts():
    r = random.Random(8)
    words = ["the", "The", "cat", "sat", "äß", "x" * 40, "a", "日本"]
    return [None, "", " \n"] + [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(60)]


@pytest.mark.parametrize("depth,block", [(2, 500), (4, 1 << 20)])
def test_scores_against_definition(frame, depth, block):
    rows = list(enumerate(texts())) + [(None, "the cat"), (5, "the cat"), (5, "the cat")]
    want = brute(rows, depth)
    got = [tuple(r)[:7] for r in ctw.model_scores(frame(rows), depth, block_bytes=block).collect()]
    by = lambda r: (r[0] is None, r[0] or 0, round(r[5], 6))
    for g, w in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], rel=1e-6, abs=1e-6)


def test_nothing_and_no_training_rows(frame):
    assert ctw.model_scores(frame(["a"]).limit(0)).count() == 0
    doc = next(k for k in range(100) if held(k))
    (r,) = ctw.model_scores(frame([(doc, "ab")])).collect()
    assert (r.n_known, r.train_tokens) == (0, 0) and r.score == pytest.approx(-24 * math.log10(2))
