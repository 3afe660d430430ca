"""Entities and spans where they lie: the forms without a shuffle of tokens give what the row by row forms give."""

import random

from pyspark.sql import functions as F

from cloakframe.operators import ner
from cloakframe.session import dealt

TOKEN = "struct<word:string,entity:string,score:double,start:int,`end`:int>"


def test_token_lists_equal_token_rows(spark):
    rng, lists = random.Random(5), []
    labels = ["B-PER", "I-PER", "I-LOC", "B-LOC", "I-MISC", "O", None]
    for i in range(60):
        lists.append((i // 3, i % 3, [(rng.choice(["##a", "Bé", "##", "c", None]), rng.choice(labels), rng.choice([0.5, 0.9, None]), 10 * k, 10 * k + 3) for k in range(rng.randint(1, 40))]))
    df = spark.createDataFrame(lists, f"doc_id int, chunk_no int, tokens array<{TOKEN}>").repartition(3)
    rows = df.select("doc_id", "chunk_no", F.posexplode("tokens").alias("pos", "t")).select("doc_id", "chunk_no", "pos", "t.*")
    columns = ["doc_id", "chunk_no", "entity_no", "word", "entity", "score", "start", "end", "n_tokens"]
    want, got = ner.merge_tokens(rows).select(columns), ner.merge_token_lists(df).select(columns)
    assert got.count() == want.count() > 500 and got.exceptAll(want).count() == 0
    plan = ner.merge_token_lists(df.select("*"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
    none = spark.createDataFrame([(1, 0, None), (2, 0, [])], f"doc_id int, chunk_no int, tokens array<{TOKEN}>")
    assert ner.merge_token_lists(none).count() == 0


def test_spans_of_dealt_texts_are_not_shuffled_and_batches_are_joined(spark):
    rng = random.Random(6)
    rows = [(d, rng.choice("AB"), f"v{k}", 6 * k, 6 * k + rng.randint(1, 30), rng.choice([0.5, 0.7, 0.9])) for d in range(5) for k in range(300)]
    df = dealt(spark.createDataFrame(rows, "doc_id int, type string, value string, start int, `end` int, confidence double"), "doc_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = ner.dedupe_spans(df, dealt=True)
        assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
        got = sorted((r.doc_id, r.start, r.end, r.type, r.confidence) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for d in range(5):
        kept = []
        for s, e, t, _, c in sorted((r[3], r[4], r[1], r[2], r[5]) for r in rows if r[0] == d):
            if kept and e <= kept[-1][1] + 5 and t == kept[-1][2]:
                if c > kept[-1][3]:
                    kept[-1] = (s, e, t, c)
            else:
                kept.append((s, e, t, c))
        want += [(d, *k) for k in kept]
    assert got == sorted(want)
