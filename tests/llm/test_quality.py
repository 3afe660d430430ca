import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import quality, queries, rules
from cloakframe.llm.stats import FEATURES

DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(grams)
    at = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(at) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at), failed)


def odd_texts():
    r = random.Random(5)
    out = [None, "", " \t\n", "a", "\x0b\x0c", "x\xa0y   z", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "a " * 40, "l\nl\n l\nl\n\n", "#*$%&|<>"]
    out += ["".join(r.choice("ab c\nd|# é\t") for _ in range(r.randint(1, 400))) for _ in range(150)]
    return out + [" ".join(r.choice("abc") for _ in range(20_000)), " ".join(str(r.random()) for _ in range(20_000))]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts_against_brute_force(spark, frame):
    texts = odd_texts()
    docs = frame(texts).withColumnsRenamed({"ids": "n_words", "shard": "kept"})
    got = rules.quality_rules(docs.drop("n_words", "kept"), labels(spark, [])).collect()
    for r in got:
        want = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[-1])
    assert len(got) == len(texts)
    kept = rules.keep_good(docs, labels(spark, []))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert rules.quality_rules(docs.drop("n_words", "kept").limit(0), labels(spark, [])).count() == 0


def test_own_columns_stay(spark, frame):
    docs = frame(["a b " * 30, None]).selectExpr("doc_id", "text", "'mine' AS stats", "'one' AS n_words", "'two' AS Kept", "'three' AS _n_words")
    got = rules.quality_rules(docs, labels(spark, [])).orderBy("doc_id").collect()
    assert [(r.n_words, r.kept) for r in got] == [(60, False), (0, False)]
    assert {(r["stats"], r["__n_words"], r["_Kept"], r["_n_words"]) for r in got} == {("mine", "one", "two", "three")}
    docs = docs.withColumn("text", F.expr("repeat('the quick brown fox jumps over a lazy dog by night ', 1 + doc_id) || array_join(sequence(1, 40), ' ')"))
    kept = rules.keep_good(docs, labels(spark, []))
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {("mine", "one", "two", "three")}
    assert rules.keep_good(docs.limit(0), labels(spark, [])).columns == docs.columns
    assert rules.keep_good(docs.limit(0), labels(spark, [])).count() == 0


def test_decision_list_finds_planted_conjunction():
    r = np.random.default_rng(0)
    x = r.random((4000, len(FEATURES)))
    bad = (x[:, 1] > 0.7) & (x[:, 3] <= 0.4)
    found = rules.learn(x, bad)
    marked = np.logical_or.reduce([rules.covered(q, x) for q in found])
    assert found and (marked == bad).mean() > 0.97
    assert rules.learn(x, np.zeros(len(x), bool)) == []


def test_rule_ensemble_learns_and_is_sparse():
    r = np.random.default_rng(1)
    x = r.random((3000, len(FEATURES)))
    y = (((x[:, 0] > 0.5) & (x[:, 2] > 0.3)) | (x[:, 5] > 0.9)).astype(float)
    model = quality.fit(x, y, np.ones(len(y)))
    z = model[1] + sum(w * rules.covered(q, x) for q, w in model[0])
    assert ((z > 0) == (y > 0)).mean() > 0.95
    assert len(model[0]) < len(quality.candidate_rules(x, y, np.ones(len(y))))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in queries.table(spark, DIR, "labels").collect()}
    got = [r for r in queries.op8_quality_score(spark, DIR).collect()]
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    kept = {r.doc_id: r.kept for r in queries.op6_quality_rules(spark, DIR).collect()}
    assert np.mean([kept[d] for d, q in truth.items() if q == 1]) > 0.9


def test_scores_of_odd_texts_without_labels(spark, frame):
    rows = quality.quality_scores(frame([None, "", "a b"]), labels(spark, [])).collect()
    assert len(rows) == 3 and all(r.score == 0.5 for r in rows)
    rows = quality.quality_scores(frame([None, "", "a b", "$$$ ###"] * 5), labels(spark, [(i, i % 2, 0) for i in range(20)])).collect()
    assert len(rows) == 20 and all(0 <= r.score <= 1 for r in rows)


def test_score_sees_passages_that_repeat(spark, frame):
    """Every text holds each word six times; in the odd ones a passage of two rounds stands three times."""
    r = random.Random(3)
    vocabulary = [f"w{i:02d}" for i in range(60)]
    rounds = lambda n: [w for _ in range(n) for w in r.sample(vocabulary, 60)]
    texts = [" ".join(rounds(2) * 3 if i % 2 else rounds(6)) for i in range(200)]
    got = quality.quality_scores(frame(texts), labels(spark, [(i, 1 - i % 2, 0) for i in range(200)])).collect()
    assert max(x.score for x in got if x.doc_id % 2) < 0.3 < 0.7 < min(x.score for x in got if x.doc_id % 2 == 0)
