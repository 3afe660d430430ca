"""Segmented windows, the step machine, bursts and state tables against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cloakframe.functions import constants as K
from cloakframe.operators import activity, messages, segments, state_tables, steps

T0 = dt.datetime(2024, 1, 1)


def test_running_sum_and_last_known(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randint(0, 9), rng.choice([None, "x", "y", "z"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, n bigint, v bigint, w string").repartition(5)
    seg = segments.block_of(F.col("n"), 16)
    out = segments.running_sum(df, ["k"], ["n"], seg, F.col("v"), "total")
    out = segments.last_known(out, ["k"], ["n"], seg, F.col("w"), "seen")
    out = segments.last_known(out, ["k"], ["n"], seg, F.col("w"), "before", inclusive=False)
    state = {}
    expected = []
    for k, n, v, w in rows:
        total, last = state.get(k, (0, None))
        expected.append((k, n, total + v, w or last, last))
        state[k] = (total + v, w or last)
    assert sorted((r.k, r.n, r.total, r.seen, r.before) for r in out.collect()) == sorted(expected)


def test_segment_is_fitted_to_the_busiest_key(spark):
    rows = [("hot", T0 + dt.timedelta(seconds=i)) for i in range(100)] + [("cold", T0)]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp")
    def widest(limit):
        seg = segments.fit_segment(df, ["session_id"], limit=limit)
        return df.groupBy("session_id", seg.alias("s")).count().agg(F.max("count")).first()[0]
    assert widest(1000) == 100 and widest(70) == 60 and widest(5) == 1


def fold(events, max_retries=2):
    """The machine one event at a time."""
    out, flags = {}, {}
    for s, step, _, _, op in events:
        if op == "stop":
            flags[s] = True
        if op in ("stop", "pause", "resume"):
            for (sess, _), r in out.items():
                if op == "stop" and sess == s and r["state"] in ("PENDING", "RETRYING"):
                    r["state"] = "CANCELLED"
            continue
        start = "CANCELLED" if flags.get(s) else "PENDING"
        r = out.setdefault((s, step), dict(state=start, attempts=0, rejected=0, fallback=False, granted=False))
        target = {"run": "RUNNING", "success": "SUCCESS", "fail": "FAILED", "block": "BLOCKED_APPROVAL",
                  "fallback": "HYBRID_FALLBACK", "deny": "CANCELLED", "skip": "SKIPPED"}.get(op)
        if op == "retry":
            target = "HYBRID_FALLBACK" if r["attempts"] >= max_retries else "RETRYING"
        if op == "approve":
            target = "RUNNING" if r["state"] == "BLOCKED_APPROVAL" else None
        ok = target in K.STEP_TRANSITIONS[r["state"]]
        r["fallback"] = r["fallback"] or op == "fallback" or (ok and target == "HYBRID_FALLBACK")
        if op == "deny" or (ok and target == "BLOCKED_APPROVAL"):
            r["granted"] = False
        if op == "approve" and ok:
            r["granted"] = True
        if ok:
            r["state"] = target
            r["attempts"] += target == "RUNNING"
        else:
            r["rejected"] += 1
    return {k: tuple(v.values()) for k, v in out.items()}


def step_rows(n=900, seed=4):
    rng = random.Random(seed)
    ops = ["run", "run", "run", "success", "fail", "fail", "retry", "retry", "fallback", "block", "approve", "deny", "skip"]
    rows = []
    for i in range(n):
        op = rng.choice(ops) if rng.random() < 0.97 else rng.choice(["stop", "pause", "resume"])
        rows.append((rng.choice(["a", "b", "c", "d"]), None if op in ("stop", "pause", "resume") else rng.randint(1, 30),
                     T0 + dt.timedelta(minutes=i // 3), i, op))
    return rows


def test_step_machine_equals_event_by_event(spark):
    rows = step_rows()
    df = (spark.createDataFrame(rows, "session_id string, step_id int, ts timestamp, seq bigint, op string")
          .withColumn("error", F.lit("e")).withColumn("error_code", F.lit("c")).repartition(3))
    expected = fold(rows)
    hourly = F.floor(F.unix_seconds("ts") / 3600)
    for limit, seg in ((10_000, None), (0, hourly), (8, hourly)):
        got = {(r.session_id, r.step_id): (r.state, r.attempts, r.rejected, r.fallback_used, r.approved)
               for r in steps.run_steps(df, seg, step_limit=limit).collect()}
        assert got == expected


def test_plan_flags(spark):
    rows = [("done", 1, "SUCCESS", 1), ("done", 2, "SKIPPED", 0), ("spent", 1, "FAILED", 2), ("spent", 2, "SUCCESS", 1),
            ("open", 1, "FAILED", 1), ("wait", 1, "BLOCKED_APPROVAL", 0)]
    df = spark.createDataFrame(rows, "session_id string, step_id int, state string, attempts int")
    plans = spark.createDataFrame([(s,) for s in ("done", "spent", "open", "wait", "empty")], "session_id string")
    got = {r.session_id: (r.is_complete, r.is_failed, r.is_blocked) for r in steps.plan_flags(df, plans).collect()}
    assert got == {"done": (True, False, False), "spent": (False, True, False), "open": (False, False, False),
                   "wait": (False, False, True), "empty": (True, False, False)}


def test_bursts(spark):
    rng = random.Random(9)
    rows, t = [], {"a": T0, "b": T0}
    for i in range(200):
        k = rng.choice("ab")
        t[k] += dt.timedelta(seconds=rng.choice([1, 5, 20, 200]))
        rows.append((k, t[k], i))
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, event_id bigint")
    got = activity.settle_windows(df, 30, 60, segment=F.floor(F.unix_seconds("ts") / 300))
    expected = {}
    last, start, burst = {}, {}, {}
    for k, ts, _ in rows:
        if k not in last or (ts - last[k]).total_seconds() > 30:
            burst[k] = burst.get(k, 0) + 1
            start[k] = ts
        last[k] = ts
        piece = int((ts - start[k]).total_seconds() // 60)
        expected[k, burst[k], piece] = expected.get((k, burst[k], piece), 0) + 1
    assert {(r.session_id, r.burst, r.piece): r.n_events for r in got.collect()} == expected


def test_goal_is_consumed_once(spark):
    rows = [("s", 0, "g1", False), ("s", 1, None, True), ("s", 2, None, True), ("s", 3, "g2", True), ("s", 4, None, True),
            ("t", 0, None, True)]
    df = spark.createDataFrame([(s, T0 + dt.timedelta(hours=30 * n), n, g, t) for s, n, g, t in rows],
                               "session_id string, ts timestamp, seq bigint, goal string, triggers_plan boolean")
    got = {(r.session_id, r.seq): r.goal for r in messages.goal_for_plan(df).collect()}
    assert got == {("s", 1): "g1", ("s", 2): None, ("s", 3): "g2", ("s", 4): None, ("t", 0): None}


def test_session_log(spark):
    rows = [("a", 0, "create", "g0", None), ("a", 1, "update", None, "p1"), ("a", 2, "create", "g2", None), ("a", 3, "update", "g3", None),
            ("b", 0, "create", "x", None), ("b", 1, "delete", None, None), ("c", 0, "create", "y", None), ("c", 1, "archive", None, None),
            ("d", 0, "update", "z", None)]
    df = spark.createDataFrame([(s, T0 + dt.timedelta(hours=n), n, op, g, p) for s, n, op, g, p in rows],
                               "session_id string, ts timestamp, seq bigint, op string, goal string, plan_id string")
    table = state_tables.sessions_table(df)
    got = {r.session_id: (r.goal, r.plan_id, r.archived) for r in table.collect()}
    assert got == {"a": ("g3", None, False), "c": ("y", None, True)}
    assert [r.session_id for r in state_tables.list_sessions(table).collect()] == ["a"]
    asked = spark.createDataFrame([("a",), ("c",), ("q",)], "session_id string")
    assert {r.session_id: r.restored for r in state_tables.restore_session(table, asked).collect()} == {"a": True, "c": False, "q": False}


def test_risk_levels(spark):
    from cloakframe.functions.risk import risk_level, risk_reason
    cases = [("TYPE_FROM_VAULT", "x", "CRITICAL"), ("CLICK", "Buy now", "CRITICAL"), ("CLICK", "draw a border", "CRITICAL"),
             ("CLICK", "fill the form", "CAUTION"), ("CLICK", "view and edit", "SAFE"), ("SCROLL", "down", "SAFE")]
    df = spark.createDataFrame(cases, "action string, description string, expected string").withColumn("level", risk_level())
    df = df.withColumn("reason", risk_reason()).withColumn("banned", risk_level(forbidden=("SCROLL",)))
    for r in df.collect():
        assert r.level == r.expected, r
        assert (r.banned == "FORBIDDEN") == (r.action == "SCROLL")
    assert df.where("description = 'Buy now'").first().reason == "Action involves buy — sensitive operation"
