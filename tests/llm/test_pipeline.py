import os

import pytest

from cloakframe.llm import decontaminate, neardup, rules, secrets
from cloakframe.llm.common import table

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_stages_take_effect_one_after_the_other(spark):
    import __spark_entry__

    docs = table(spark, DIR, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, DIR)
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        seen.append((name, before, after))
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    (_, b0, a0), (_, b1, a1), (_, b2, a2), (_, b3, a3) = seen
    kept = {r.doc_id for r in rules.quality_rules(spark.createDataFrame(list(b0.values())), table(spark, DIR, "labels")).where("kept").collect()}
    assert set(a0) == kept and 0 < len(a0) < len(b0)
    marks = neardup.near_duplicates(spark.createDataFrame(list(b1.values())), 5, 80).collect()
    assert set(a1) == {r.doc_id for r in marks if r.kept} and {r.component_id for r in marks} == set(a1)
    bad = {r.doc_id for r in decontaminate.contaminations(spark.createDataFrame(list(b2.values())), table(spark, DIR, "benchmark")).collect()}
    assert set(a2) == set(b2) - bad
    assert set(a3) == set(b3)
    for d, r in b3.items():
        spans = secrets.scan([r.text or ""])[0]
        assert a3[d].text == (secrets.redacted(r.text, spans, "[SECRET]") if spans else r.text)
    assert a1 and all(a1[d] == b1[d] for d in a1)
    pieces = __spark_entry__.queries()["pipeline"](spark, DIR).collect()
    assert {p.doc_id for p in pieces} == set(a3)
