"""Streams give what the batch operators give."""

import datetime as dt

from pyspark.sql import functions as F

from cloakframe.operators import steps, tokens
from cloakframe.plans import privacy
from cloakframe.sources import snapshots
from cloakframe.streaming.messages import fan_out, settled_bursts
from cloakframe.streaming.redaction import RedactionStream
from cloakframe.streaming.steps import track_steps

from test_ordered import T0, fold, step_rows
from test_tokens_audit import elements_of


def test_redaction_stream_equals_batch(spark, tmp_path):
    """Three steps, one micro-batch each: same tokens and texts as one batch over all."""
    rows = [(f"s{i % 3}", step, i, f"u{(i * 7 + step * (i % 2)) % 11}@m.example and 203.45.67.{(i + step) % 9 + 1}")
            for step in range(3) for i in range(12)]
    e = elements_of(spark, rows)
    src = f"{tmp_path}/in"
    for step in range(3):
        e.where(F.col("step_no") == step).coalesce(1).write.mode("append").parquet(src)
    flow = RedactionStream(f"{tmp_path}/state")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    flow.writer(stream, f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    z = privacy.sanitize(e)
    cols = ["session_id", "token", "type", "value", "token_no", "first_step"]
    assert flow.vault(spark).select(cols).exceptAll(z.vault.select(cols)).count() == 0
    assert flow.vault(spark).count() == z.vault.count()
    texts = ["session_id", "step_no", "element_id", "text"]
    assert flow.released(spark).select(texts).exceptAll(z.redacted.select(texts)).count() == 0
    assert flow.released(spark).count() == 36 and flow.quarantine(spark).count() == 0
    # a replayed batch changes nothing
    flow.process(e.where("step_no = 2"), 2)
    assert flow.vault(spark).count() == z.vault.count() and flow.released(spark).count() == 36
    flow.compact(spark, 2)
    assert flow.vault(spark).select(cols).exceptAll(z.vault.select(cols)).count() == 0 and flow.vault(spark).count() == z.vault.count()


def test_step_stream_equals_batch(spark, tmp_path):
    rows = step_rows(400, seed=8)
    known = sorted({(s, n) for s, n, *_ in rows if n is not None})
    plan = [(s, n, T0 - dt.timedelta(hours=1), -1, "plan") for s, n in known]
    schema = "session_id string, step_id int, ts timestamp, seq bigint, op string"
    spark.createDataFrame(plan, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = (track_steps(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    last = (out.where("step_id IS NOT NULL").groupBy("session_id", "step_id")
            .agg(F.max_by(F.struct("state", "attempts"), F.struct("ts", "seq")).alias("r")))
    expected = fold(rows)
    got = {(r.session_id, r.step_id): (r.r.state, r.r.attempts) for r in last.collect()}
    # A stop changes a step without an event of its own, so compare what had a later event.
    final = (spark.createDataFrame(rows, schema).withColumn("error", F.lit(None).cast("string"))
             .withColumn("error_code", F.lit(None).cast("string")))
    batch = {(r.session_id, r.step_id): (r.state, r.attempts) for r in steps.run_steps(final).collect()}
    assert {k: v[:2] for k, v in expected.items()} == batch
    stops = {s: i for s, _, _, i, op in rows if op == "stop"}
    lasts = {(s, n): i for s, n, _, i, _ in rows if n is not None}
    for k, v in batch.items():
        if lasts[k] > stops.get(k[0], -1):
            assert got[k] == v, k
    assert out.where("NOT accepted").count() == sum(v[2] for v in expected.values())


def test_closed_session_starts_over(spark, tmp_path):
    rows = [("s", 1, T0, 0, "plan"), ("s", 1, T0, 1, "run"), ("s", None, T0, 2, "close"), ("s", 1, T0, 3, "success")]
    schema = "session_id string, step_id int, ts timestamp, seq bigint, op string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = (track_steps(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream
         .format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.seq: (r.state, r.accepted, r.code) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[1] == ("RUNNING", True, None) and got[3] == ("PENDING", False, "INVALID_TRANSITION")


def test_messages_fan_out(spark, tmp_path):
    lines = ['{"type":"USER_QUERY","session_id":"a","payload":{"query":"q"}}', '{"type":"STOP_AGENT","session_id":"a"}',
             "{broken", '{"type":"NOPE","session_id":"a"}', '{"type":"PLAN","session_id":"a"}', '"text"',
             '{"type":"USER_QUERY","session_id":"a","client_timestamp":"soon"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part.txt").write_text("\n".join(lines))
    seen = {}
    def keep(name):
        return lambda df, _: seen.setdefault(name, []).extend(r.asDict() for r in df.collect())
    fan_out(spark.readStream.text(f"{tmp_path}/in"), {"user_query": keep("user_query"), "stop_agent": keep("stop_agent")},
            keep("dead")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert len(seen["user_query"]) == 1 and seen["user_query"][0]["payload"] == '{"query":"q"}'
    assert len(seen["stop_agent"]) == 1
    assert sorted(r["code"] for r in seen["dead"]) == ["INVALID_ENVELOPE", "INVALID_ENVELOPE", "INVALID_JSON", "INVALID_JSON", "UNKNOWN_TYPE"]


def test_bursts_close_after_quiet(spark, tmp_path):
    times = [0, 100, 250, 900, 1000, 60_000]
    rows = [("s", T0 + dt.timedelta(milliseconds=t)) for t in times]
    spark.createDataFrame(rows, "session_id string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session_id string, ts timestamp").parquet(f"{tmp_path}/in")
    (settled_bursts(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append")
     .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination())
    got = sorted(r.n_events for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [2, 3]


def test_snapshot_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("""{
      "session_id": "s", "step_no": 0, "url": "http://x.example/", "title": "t", "elements_count": 2,
      "elements": [
        {"id": "e_1", "tag": "SPAN", "text": "asha@m.example", "rect": [1, 2, 3, 4], "parentTag": "DIV"},
        {"id": "e_2", "tag": "INPUT", "type": "password", "value": "pw", "nearbyLabels": "Password", "coordinates": [5, 6, 7, 8]}],
      "forms": [{"id": "f", "action": "", "method": "get", "inputs": ["a"], "vault_available": {"a": true}}],
      "viewport": {"width": 1, "height": 2, "scroll_x": 0, "scroll_y": 0}, "context_sufficient": true}""")
    pages = snapshots.read_snapshots(spark, str(tmp_path))
    e = snapshots.explode_elements(pages)
    z = privacy.sanitize(e)
    got = {r.element_id: r for r in z.redacted.collect()}
    assert got["e_1"].text == "[EMAIL_1]" and got["e_1"].coordinates == [1.0, 2.0, 3.0, 4.0]
    assert got["e_2"].value == "[PASSWORD_FIELD]" and got["e_2"].redacted_types == ["PASSWORD_FIELD"]
    assert tokens.manifest_elements(z.redacted).count() == 2
    from cloakframe.operators.ocr import element_regions
    assert {(r.element_id, r.label, r.w) for r in element_regions(z.redacted).collect()} == {("e_1", "EMAIL", 3.0), ("e_2", "PASSWORD_FIELD", 7.0)}


def test_redaction_stream_scans_what_changed_and_obeys_resets(spark, tmp_path):
    """Six batches with compaction after every second one: spans are reused, numbers restart after a reset, old folders go."""
    from cloakframe.operators.detect import scan_elements
    from cloakframe.session import folders

    texts = {0: "a@m.example", 1: "a@m.example", 2: "b@m.example", 3: "b@m.example", 4: "b@m.example and a@m.example", 5: "a@m.example"}
    rows = [(s, step, 0, text) for s in ("s", "t") for step, text in texts.items()]
    e = elements_of(spark, rows).withColumn("control", F.lit(None).cast("string"))
    seen = []

    def scan(df):
        seen.extend((r.session_id.split("\u0001")[0], r.step_no) for r in df.collect())
        return scan_elements(df)

    flow = RedactionStream(f"{tmp_path}/state", scan, compact_every=2)
    reset = spark.createDataFrame([("t", 3, "reset")], "session_id string, step_no bigint, control string")
    for step in range(6):
        batch = e.where(F.col("step_no") == step)
        flow.process(batch.unionByName(reset, allowMissingColumns=True) if step == 3 else batch, step)
    assert sorted(seen) == [("s", 0), ("s", 2), ("s", 4), ("s", 5), ("t", 0), ("t", 2), ("t", 3), ("t", 4), ("t", 5)]
    out = {(r.session_id, r.step_no): (r.epoch, r.text) for r in flow.released(spark).collect()}
    assert out["s", 4] == (0, "[EMAIL_2] and [EMAIL_1]") and out["t", 2] == (0, "[EMAIL_2]")
    assert out["t", 3] == (1, "[EMAIL_1]") and out["t", 4] == (1, "[EMAIL_1] and [EMAIL_2]") and out["t", 5] == (1, "[EMAIL_2]")
    stats = {(r.session_id, r.step_no): (r.new, r.modified, r.unchanged, r.scanned) for r in flow.scans(spark).collect()}
    assert stats["s", 1] == (0, 0, 1, 0) and stats["t", 3] == (1, 0, 0, 1) and all(n + m == k for n, m, _, k in stats.values())
    live = {(r.session_id, r.value): r.token for r in flow.vault(spark).collect()}
    assert live == {("s", "a@m.example"): "[EMAIL_1]", ("s", "b@m.example"): "[EMAIL_2]", ("t", "b@m.example"): "[EMAIL_1]", ("t", "a@m.example"): "[EMAIL_2]"}
    assert folders(spark, f"{tmp_path}/state/vault/base") == ["upto=1", "upto=3"]
    assert "batch_id=0" not in folders(spark, f"{tmp_path}/state/vault") and "batch_id=5" in folders(spark, f"{tmp_path}/state/vault")
    flow.process(e.where("step_no = 5"), 5)  # replayed after the compaction
    assert {(r.session_id, r.value): r.token for r in flow.vault(spark).collect()} == live and flow.released(spark).count() == 12


def test_leaking_scan_is_quarantined(spark, tmp_path):
    """A value that the vault knows stays in a row that the scan missed: the row is held back."""
    from cloakframe.operators.detect import scan_elements
    flow = RedactionStream(f"{tmp_path}/state", lambda df: scan_elements(df.withColumn("text", F.when(F.col("element_pos") == 0, F.col("text")))))
    flow.process(elements_of(spark, [("s", 0, 0, "a@m.example")]), 0)
    flow.process(elements_of(spark, [("s", 1, 1, "see a@m.example"), ("s", 2, 0, "fine")]), 1)
    assert {r.step_no for r in flow.quarantine(spark).collect()} == {1} and {r.step_no for r in flow.released(spark).collect()} == {0, 2}


def _run(df, path, spark):
    (df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _batches(spark, parts, schema, path):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_idle_sessions_expire_by_timer_or_next_event(spark, tmp_path):
    minute = lambda n: T0 + dt.timedelta(minutes=n)
    schema = "session_id string, step_id int, ts timestamp, seq bigint, op string"
    parts = [[("a", 1, minute(0), 0, "run"), ("b", 1, minute(1), 1, "run")], [("b", 1, minute(100), 2, "success"), ("c", 2, minute(101), 3, "stop")],
             [("c", 2, minute(102), 4, "run"), ("a", 1, minute(200), 5, "success")]]
    out = _run(track_steps(_batches(spark, parts, schema, tmp_path), idle_ms=30 * 60_000), tmp_path, spark).collect()
    got = {r.seq: (r.state, r.accepted) for r in out if r.seq is not None and r.op != "stop"}
    assert got == {0: ("RUNNING", True), 1: ("RUNNING", True), 2: ("PENDING", False), 4: ("CANCELLED", False), 5: ("PENDING", False)}
    gone = sorted((r.session_id, r.ts) for r in out if r.op == "expire")
    assert gone == [("a", minute(30)), ("b", minute(31)), ("b", minute(130)), ("c", minute(132))]


def test_events_are_folded_like_one_by_one():
    import random

    import numpy as np

    from cloakframe.streaming.steps import CLOSE, CLOSE_STOP, OPS, STATES, STOP, Maps, fold_events

    rng, maps = random.Random(2), Maps(2)
    step = np.sort(np.array([rng.randrange(7) for _ in range(500)]))
    step = np.unique(step, return_inverse=True)[1]
    op = np.array([rng.randrange(len(OPS)) for _ in step])
    before = np.array([rng.choice([0] * 12 + [STOP, CLOSE, CLOSE_STOP]) for _ in step])
    start = np.array([maps.width * STATES.index("FAILED") + 2] * 7)
    after, accepted, count = fold_events(step, op, before, start, np.full(7, 5), maps)
    now, n = dict(enumerate(start.tolist())), dict.fromkeys(range(7), 5)
    for i, (s, o, b) in enumerate(zip(step.tolist(), op.tolist(), before.tolist())):
        c = int(maps.between[b, now[s]])
        n[s] = 0 if b >= CLOSE or OPS[o] == "plan" else n[s]
        now[s], ok, ran = maps._event(OPS[o], c, 2)
        n[s] += ran
        assert (after[i], accepted[i], count[i]) == (now[s], ok, n[s]), i


def test_capped_bursts_equal_batch_in_any_order(spark, tmp_path):
    import random

    from cloakframe.operators.activity import settle_windows
    from cloakframe.streaming.messages import settled_bursts

    rng, rows, at = random.Random(4), [], {"a": 0.0, "b": 5.0, "c": 0.0}
    for i in range(240):
        k = rng.choice("abc")
        at[k] += rng.choice([0.0, 0.1, 0.3, 0.2, 0.29, 4.0])
        rows.append((k, T0 + dt.timedelta(seconds=round(at[k], 3)), i))
    rows.sort(key=lambda r: (r[1] + dt.timedelta(seconds=rng.uniform(-1, 1))))
    schema = "session_id string, ts timestamp, event_id bigint"
    end = [("end", T0 + dt.timedelta(days=1), 999)]
    stream = _batches(spark, [rows[:80], rows[80:160], rows[160:], end], schema, tmp_path)
    out = _run(settled_bursts(stream, 0.3, 3.0, "3 seconds"), tmp_path, spark).where("session_id <> 'end'")
    columns = ["session_id", "burst", "piece", "started_at", "last_event_at", "n_events"]
    batch = settle_windows(spark.createDataFrame(rows, schema), 0.3, 3.0)
    assert sorted(out.select(columns).collect()) == sorted(batch.select(columns).collect()) and out.where("piece > 0").count() > 0
