"""Many small scopes cost no index each, and pages made of a small table are parsed on all cores."""

import random

import pyarrow as pa

from cloakframe.operators import leakproof


def test_small_scopes_go_out_together_and_equal_brute_force(monkeypatch):
    rng, rows = random.Random(3), []
    word = lambda: rng.choice(["part 1", "part 12", "é part", "", "x"])
    for scope in range(300):
        rows += [(f"s{scope}", 0, 0, 0, word(), None, f"t{scope}-{k}") for k in range(rng.randint(0, 3))]
        rows += [(f"s{scope}", 0, 0, 1, rng.choice([word() + " and " + word(), None]), scope * 10 + k, None) for k in range(rng.randint(0, 4))]
    names = ["_scope", "_part", "_salt", "_kind", "_body", "_pos", "_tag"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
    want = sorted((t[5], v[6]) for v in rows if v[3] == 0 and v[4] for t in rows if t[3] == 1 and t[0] == v[0] and t[4] and v[4] in t[4])

    def found(batches):
        out = list(leakproof._searching(1, 1)(batches))
        return len(out), sorted((r["_pos"], r["_tag"]) for b in out for r in b.to_pylist())

    assert found([batch]) == (1, want) and len(want) > 100
    cut = [batch.slice(k, 3) for k in range(0, batch.num_rows, 3)]  # groups that go on in the next batch
    assert found(cut)[1] == want
    monkeypatch.setattr(leakproof, "FEW", 0)
    assert found([batch])[1] == want


def test_form_pages_are_spread(spark, tmp_path):
    from cloakframe.plans.registry import _pages_with_forms

    rows = spark.range(40).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "'A' AS c_mktsegment")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    pages = _pages_with_forms(spark, str(tmp_path))
    assert pages.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and pages.count() == 40
