import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cloakframe.llm import queries, secrets, toxicity

DIR = "/root/testdata/sf0.01"
OPAQUE = "aB3" * 14
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(KINDS.items()) for m in p.finditer(text or "") if ok(m)]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


def odd_texts():
    r = random.Random(2)
    bits = ["password", "TOKEN", "api_key", "=", ": ", '"', " ", "\n", "é", "AKIA", "ABCDEFGH0123", "abcdef0123456789" * 2, "user=bob", OPAQUE, "\n\n", "ſecret=", "https://h.x/y", "x" * 9]
    return [None, ""] + ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(400)] + ["AKIA" * 30_000, "user=abcd " * 20_000]


def test_base_spans_against_brute_force(frame):
    texts = odd_texts()
    rows = secrets.secret_spans(frame(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in KINDS]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in KINDS] == want
    assert secrets.secret_spans(frame(["a"]).limit(0)).count() == 0


def test_weak_parts_need_each_other():
    said = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.scan([t])[0]]
    assert said("user=bob and nothing") == [] and said(f"only {OPAQUE} here:") == []
    assert said(f"user=bob {OPAQUE}") == ["ident", "opaque"]
    assert said(f"user=bob {'x ' * 2000}{OPAQUE}") == ["ident", "opaque"] and said(f"user=bob\n\n{OPAQUE}") == []
    assert said(f"https://db.example/x user: bob1 {OPAQUE}") == ["endpoint", "ident", "opaque"]
    assert said("https://db.example/x user: bob1") == []


def test_interval_join_against_all_pairs():
    r = np.random.default_rng(4)
    for n in (0, 1, 60, 60, 60):
        scope, kind = r.integers(0, 25, n), r.integers(0, 6, n)
        hit = lambda i, ks: any(kind[j] in ks and scope[j] == scope[i] for j in range(n) if j != i)
        want = [kind[i] < 3 or (kind[i] == 3 and hit(i, (0, 2, 4))) or (kind[i] == 4 and (hit(i, (1, 3)) or hit(i, (5,))))
                or (kind[i] == 5 and hit(i, (1, 3)) and hit(i, (0, 2, 4))) for i in range(n)]
        assert secrets.linked(scope, kind).tolist() == want


def test_many_linked_parts_in_one_text_stay_linear():
    import time

    def seconds(lines):
        text = "\n".join(f"user=bob{i} {OPAQUE}{i}" for i in range(lines))
        start = time.perf_counter()
        assert len(secrets.scan([text])[0]) == 2 * lines
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 6 * seconds(4_000) + 0.5


def test_redaction_keeps_rows_and_columns(frame):
    docs = frame(["clean", None, "", f"token = {'ab' * 20} tail", "clean"])
    got = {r.doc_id: r for r in secrets.redact_secrets(docs).collect()}
    assert got[3].text == "[SECRET] tail" and got[3].n_chars == 13 and got[1].text is None and got[0].text == "clean"
    assert secrets.redact_secrets(docs).columns == docs.columns and len(got) == 5


def test_pooling_equals_plain_convolution():
    r = np.random.default_rng(0)
    m = toxicity.Model()
    m.table[:-1] = r.normal(size=(toxicity.BUCKETS, toxicity.DIM))
    m.filters = [r.normal(size=f.shape).astype(np.float32) for f in m.filters]
    texts = ["", "a", "A b.", " ".join(f"w{k}" for k in range(300)), "é x\ny"]
    index, first, rows, _ = toxicity.coded(pa.array(texts))
    got = toxicity.pooled(m, index, first, rows)
    for k in range(len(texts)):
        e = np.concatenate([sum(m.table[c] for c in rows[index[first[k] : first[k + 1]]].T), np.zeros((toxicity.PAD, toxicity.DIM))])
        want = [max(sum(e[p + j] @ f[j] for j in range(len(f)))[c] for p in range(len(e) - toxicity.PAD + 1)) for f in m.filters for c in range(toxicity.FILTERS)]
        assert np.allclose(got[k], np.maximum(want, 0), atol=1e-4)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_toxicity_on_held_out_rows(spark):
    truth = {r.doc_id: r.toxic for r in queries.table(spark, DIR, "labels").collect()}
    got = queries.op4_toxicity(spark, DIR).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p == y for p, y in held]) > 0.9


def test_scores_of_odd_texts(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity_scores(frame([None, "", "a"]), labels).collect()] == [pytest.approx(0, abs=1e-9)] * 3
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    texts = ["you idiot fool" if i % 2 else "a fine day" for i in range(38)] + [None, ""]
    rows = toxicity.toxicity_scores(frame(texts), labels).collect()
    assert len(rows) == 40 and all(0 <= r.score <= 1 for r in rows)
