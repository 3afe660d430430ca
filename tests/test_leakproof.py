"""The search of secrets in texts, dealt out by size."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cloakframe.operators import audit
from cloakframe.operators.leakproof import Index, _bytes_of, occurrences

from test_tokens_audit import elements_of


def test_index_equals_plain_search():
    rng = random.Random(3)
    for letters in ("ab", "aé日", "abcdefgh@.\x00"):
        values = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(300)] + ["", "a" * 40]
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(100)] + ["a" * 45, "a" * 39, ""]
        found = Index([v.encode() for v in values]).find(*_bytes_of(pa.array(texts)))
        assert found == {(i, k) for i, t in enumerate(texts) for k, v in enumerate(values) if v and v in t}


def test_a_run_border_hides_nothing(monkeypatch):
    monkeypatch.setattr("cloakframe.operators.leakproof.RUN", 16)
    texts = ["x" * k + "secret value 99" + "y" * 20 for k in range(40)]
    assert Index([b"secret value 99", b"t v"]).find(*_bytes_of(pa.array(texts))) == {(i, k) for i in range(40) for k in (0, 1)}


def test_shared_beginnings_cost_one_lookup_each():
    index = Index([f"https://host/{i:07d}".encode() for i in range(20_000)])
    texts = ["https://host/x " * 2000]
    assert index.find(*_bytes_of(pa.array(texts))) == set()
    assert len(index.places(np.frombuffer(texts[0].encode(), np.uint8))) == 2000


def test_parts_and_salts_change_nothing(spark):
    rng = random.Random(8)
    words = [f"v{i}é{i * i}" for i in range(400)]
    texts = [(rng.choice(["hot", "hot", "s1", "s2", None]), i, " ".join(rng.choice(words) for _ in range(30)) * rng.choice([1, 1, 20])) for i in range(200)]
    secrets = [(rng.choice(["hot", "s1", "s3"]), w, f"[T_{i}]") for i, w in enumerate(words)] + [("hot", words[0], "[AGAIN]")]
    t = spark.createDataFrame(texts, "_scope string, id long, _out string").repartition(4)
    s = spark.createDataFrame(secrets, "_scope string, _value string, token string").repartition(4)
    brute = sorted((i, token) for scope, i, text in texts for at, v, token in secrets if at == scope and v in text)
    for part, share in ((1 << 18, 64 << 20), (7, 3000), (1, 64 << 20)):
        assert sorted(tuple(r) for r in occurrences(t, s, ["id"], ["token"], part, share).collect()) == brute
    none = t.limit(0)
    assert occurrences(none, s, ["id"], ["token"]).count() == 0 and occurrences(t, s.limit(0), ["id"], ["token"]).count() == 0


def test_more_than_a_million_values(spark):
    """One session with 1.2 M values, nearly all with one beginning; texts hold some of them and many near misses."""
    vault = spark.range(1_200_000).select(
        F.lit("s").alias("session_id"), F.concat(F.lit("[ID_"), F.col("id"), F.lit("]")).alias("token"),
        F.concat(F.lit("customer-"), F.lpad(F.col("id").cast("string"), 7, "0"), F.lit("@x")).alias("value"))
    kept = [f"customer-{i:07d}@x" for i in range(0, 1_200_000, 60_000)]
    rows = [("s", i, 0, f"see {v}, customer-{i:07d}@y and customer-9999999@x") for i, v in enumerate(kept)]
    rows += [("s", 1000 + i, 0, "customer-12 " * 50) for i in range(50)] + [("t", 5000, 0, kept[0])]
    found = audit.leaks(elements_of(spark, rows), vault).collect()
    assert sorted((r.step_no, r.token) for r in found) == [(i, f"[ID_{i * 60_000}]") for i in range(len(kept))]
