"""Cost of row-local operators against the size of one text."""

import time

from pyspark.sql import functions as F

from cloakframe.operators.detect import scan_fields
from cloakframe.operators.ner import chunk_text


def seconds(run):
    best = []
    for _ in range(2):
        start = time.perf_counter()
        run()
        best.append(time.perf_counter() - start)
    return min(best)


def test_findings_of_one_text_cost_in_proportion(spark):
    def scan(n):
        text = " ".join(f"person{k}@mail{k % 7}.example.com" for k in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        got = scan_fields(df, ("text",)).select(F.size("spans").alias("n"), F.expr("element_at(spans, -1)").alias("s")).first()
        assert got.n == n and got.s["end"] == len(text) and text[got.s["start"]:] == got.s["value"]

    scan(100)
    assert seconds(lambda: scan(16_000)) <= 2.5 * seconds(lambda: scan(8_000)) + 0.5


def test_chunks_of_one_text_cost_in_proportion(spark):
    def chunk(n):
        df = spark.createDataFrame([(" ".join("word" for _ in range(n)),)], "text string")
        out = chunk_text(df).orderBy("chunk_no").select("start_offset", "chunk_text").collect()
        assert all(r.start_offset == 5 * (r.start_offset // 5) and r.chunk_text.startswith("word") for r in out)
        return out

    assert [r.start_offset for r in chunk(2_000)] == sorted({r.start_offset for r in chunk(2_000)})
    assert seconds(lambda: chunk(160_000)) <= 2.5 * seconds(lambda: chunk(80_000)) + 0.5
