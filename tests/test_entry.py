"""The registered queries against their SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# One query per operator family; CHECK_ALL=1 runs every one.
SAMPLE = ["spans_greedy", "det_dob", "att_name", "tok_redact", "tok_inputs", "egress_raw", "telemetry", "inc_spans", "mem_context",
          "session_table", "msg_parse", "goal_asof", "step_fold", "debounce", "risk_levels", "step_wire", "resolve_target", "html_link_elements",
          "ner_filter", "ocr_regions", "ground_parse", "json_repair", "ner_dedupe", "spans_merge", "extra_spans", "telemetry_leaks", "html_elements",
          "image_source", "snapshot_stream", "stream_turns", "stream_scans", "stream_cleanup", "stream_debounce"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("CHECK_ALL") else SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    pick = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in pick) for r in cur.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
