"""The step state machine over protocol events, in batch.

Events are (session_id, step_id, ts, seq, op, error, error_code).  Ops are
``run success fail block retry fallback approve deny skip`` on a step, and
``pause resume stop`` on a session.  An op that the current state does not
allow changes nothing and is counted as rejected.

A step's events are folded in order.  A step with more events than fit a task
is cut into segments by time: a segment is folded once for every state it could
be entered in, and the small tables that result are chained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import constants as K
from cloakframe.functions.sqltext import in_list, quoted
from cloakframe.operators.detect import let
from cloakframe.operators.segments import fit_segment, last_known
from cloakframe.session import materialize

STATES = tuple(K.STEP_TRANSITIONS)
STEP_OPS = ("run", "success", "fail", "block", "retry", "fallback", "approve", "deny", "skip")
STEP_LIMIT = 10_000
_NEVER = "named_struct('ts', timestamp'1900-01-01', 'seq', -1L)"
_MOVES = [f"{old}>{new}" for old, news in K.STEP_TRANSITIONS.items() for new in news]


def _record(state: str, attempts: str, rejected: str, fallback: str, granted: str, at: str) -> str:
    return (f"named_struct('state', {state}, 'attempts', {attempts}, 'rejected', {rejected}, "
            f"'fallback', {fallback}, 'granted', {granted}, 'at', {at})")


def _after_stop(state: str) -> str:
    """A stop cancels what has not started or waits for a retry."""
    return f"if({state} IN ('PENDING', 'RETRYING'), 'CANCELLED', {state})"


def _apply(max_retries: int) -> str:
    """Next record from record ``a`` and event ``e``, with any stop in between."""
    target = (f"CASE e.op WHEN 'run' THEN 'RUNNING' WHEN 'success' THEN 'SUCCESS' "
              "WHEN 'fail' THEN 'FAILED' WHEN 'block' THEN 'BLOCKED_APPROVAL' "
              f"WHEN 'retry' THEN if(a.attempts >= {max_retries}, 'HYBRID_FALLBACK', 'RETRYING') "
              "WHEN 'fallback' THEN 'HYBRID_FALLBACK' WHEN 'deny' THEN 'CANCELLED' "
              "WHEN 'skip' THEN 'SKIPPED' "
              "WHEN 'approve' THEN if(now = 'BLOCKED_APPROVAL', 'RUNNING', 'NONE') ELSE 'NONE' END")
    allowed = in_list("concat(now, '>', to)", _MOVES)
    moved = _record(
        f"if({allowed}, to, now)",
        f"a.attempts + if({allowed} AND to = 'RUNNING', 1, 0)",
        f"a.rejected + if({allowed}, 0, 1)",
        f"a.fallback OR e.op = 'fallback' OR ({allowed} AND to = 'HYBRID_FALLBACK')",
        f"CASE WHEN e.op = 'deny' OR ({allowed} AND to = 'BLOCKED_APPROVAL') THEN false "
        f"WHEN e.op = 'approve' AND {allowed} THEN true ELSE a.granted END",
        "e.at")
    now = f"if(e.stop_at > a.at, {_after_stop('a.state')}, a.state)"
    return let("now", now, let("to", target, moved))


def _segment_table(max_retries: int) -> str:
    """Fold one segment from every possible start; entry = state * (max+1) + attempts."""
    width = max_retries + 1
    states = "array(" + ", ".join(quoted(s) for s in STATES) + ")"
    # Stops before the first event are applied when segments are chained.
    start = _record(f"element_at({states}, cast(floor(k / {width}) AS int) + 1)", f"k % {width}", "0",
                    "false", "cast(NULL AS boolean)", "events[0].stop_at")
    return (f"transform(sequence(0, {len(STATES) * width - 1}), k -> "
            f"aggregate(events, {start}, (a, e) -> {_apply(max_retries)}, "
            f"a -> named_struct('state', a.state, 'added', a.attempts - k % {width}, "
            "'rejected', a.rejected, 'fallback', a.fallback, 'granted', a.granted, 'at', a.at)))")


def _whole(max_retries: int) -> str:
    """Fold all events of a step from its start."""
    start = _record("'PENDING'", "0", "0", "false", "false", _NEVER)
    return f"aggregate(array_sort(collect_list(event)), {start}, (a, e) -> {_apply(max_retries)})"


def _chain(max_retries: int) -> str:
    index = (f"cast((array_position(array({', '.join(quoted(s) for s in STATES)}), now) - 1) "
             f"* {max_retries + 1} + least(a.attempts, {max_retries}) AS int)")
    step = _record("r.state", "a.attempts + r.added", "a.rejected + r.rejected",
                   "a.fallback OR r.fallback", "coalesce(r.granted, a.granted)", "r.at")
    now = f"if(s.first_stop > a.at, {_after_stop('a.state')}, a.state)"
    start = _record("'PENDING'", "0", "0", "false", "false", _NEVER)
    return (f"aggregate(segments, {start}, (a, s) -> "
            + let("now", now, let("r", f"s.outcomes[{index}]", step)) + ")")


def run_steps(events: DataFrame, segment: Column | None = None,
              max_retries: int = K.MAX_RETRIES, step_limit: int = STEP_LIMIT) -> DataFrame:
    """Final record of every step that has events.

    ``segment`` is an expression that never decreases over time within a
    session; by default it is fitted to the busiest session.  Only steps with
    more than ``step_limit`` events are cut.
    """
    events = materialize(events.select("session_id", "step_id", "ts", "seq", "op", "error", "error_code"))
    segment = segment if segment is not None else fit_segment(events, ["session_id"])
    events = events.withColumn("at", F.struct("ts", F.col("seq").cast("bigint").alias("seq")))
    stop_at = F.when(F.col("op") == "stop", F.col("at"))
    stopped = last_known(events, ["session_id"], ["ts", "seq"], segment, stop_at, "stop_at")
    stopped = stopped.withColumn("stop_at", F.coalesce("stop_at", F.expr(_NEVER)))
    own = stopped.where(F.col("op").isin(*STEP_OPS)).withColumn("_seg", segment)
    own = own.withColumn("event", F.struct("at", "op", "stop_at"))
    key = ["session_id", "step_id"]
    busy = (events.where(F.col("op").isin(*STEP_OPS)).groupBy(*key).agg(F.count("*").alias("_n"))
            .where(F.col("_n") > step_limit).select(*key))
    usual = (own.join(busy, key, "left_anti").groupBy(*key)
             .agg(F.expr(_whole(max_retries)).alias("r")))
    parts = (own.join(busy, key, "left_semi").groupBy(*key, "_seg")
             .agg(F.array_sort(F.collect_list("event")).alias("events"))
             .select(*key, "_seg", F.col("events")[0]["stop_at"].alias("first_stop"),
                     F.expr(_segment_table(max_retries)).alias("outcomes")))
    long = (parts.groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct("_seg", "first_stop", "outcomes"))).alias("segments"))
            .select(*key, F.expr(_chain(max_retries)).alias("r")))
    chained = usual.unionByName(long)
    failures = (own.where(F.col("op") == "fail").groupBy("session_id", "step_id")
                .agg(F.max_by(F.struct("error", "error_code"), F.struct("ts", "seq")).alias("e")))
    last_stop = (events.where(F.col("op") == "stop").groupBy("session_id")
                 .agg(F.max("at").alias("_stop")))
    state = F.expr(f"if(_stop > r.at, {_after_stop('r.state')}, r.state)")
    return (chained.join(failures, ["session_id", "step_id"], "left")
            .join(last_stop, "session_id", "left")
            .select("session_id", "step_id", state.alias("state"), "r.attempts", "r.rejected",
                    F.col("r.fallback").alias("fallback_used"), F.col("r.granted").alias("approved"),
                    F.col("e.error").alias("last_error"), F.col("e.error_code").alias("last_error_code")))


def session_controls(events: DataFrame) -> DataFrame:
    """Whether each session is paused or stopped after all its events."""
    control = F.col("op").isin("pause", "resume", "stop")
    last = F.max_by("op", F.when(control, F.struct("ts", "seq")))
    return events.groupBy("session_id").agg(
        F.coalesce(last == "pause", F.lit(False)).alias("paused"),
        F.bool_or(F.col("op") == "stop").alias("stopped"))


def state_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("session_id", "state").agg(F.count("*").alias("n_steps"))


def plan_flags(steps: DataFrame, plans: DataFrame | None = None,
               max_retries: int = K.MAX_RETRIES) -> DataFrame:
    """Complete, failed and blocked per session; a plan without steps is complete."""
    done = F.col("state").isin(K.TERMINAL_STATES)
    spent = F.col("state").isin("FAILED", "HYBRID_FALLBACK") & (F.col("attempts") >= max_retries)
    flags = steps.groupBy("session_id").agg(
        F.count("*").alias("total_steps"), F.bool_and(done).alias("is_complete"),
        (F.coalesce(F.bool_and(F.when(~done, spent)), F.lit(False))).alias("is_failed"),
        F.bool_or(F.col("state") == "BLOCKED_APPROVAL").alias("is_blocked"))
    if plans is None:
        return flags
    return plans.select("session_id").distinct().join(flags, "session_id", "left").select(
        "session_id", F.coalesce("total_steps", F.lit(0)).alias("total_steps"),
        F.coalesce("is_complete", F.lit(True)).alias("is_complete"),
        F.coalesce("is_failed", F.lit(False)).alias("is_failed"),
        F.coalesce("is_blocked", F.lit(False)).alias("is_blocked"))


def completed_steps(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("state").isin("SUCCESS", "SKIPPED"))


def steps_in(steps: DataFrame, state: str) -> DataFrame:
    return steps.where(F.col("state") == state)


def next_executable(steps: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """Smallest pending step per session, unless it is paused or stopped."""
    if controls is not None:
        running = controls.where(~F.col("paused") & ~F.col("stopped")).select("session_id")
        steps = steps.join(running, "session_id", "left_semi")
    return (steps.where(F.col("state") == "PENDING").groupBy("session_id")
            .agg(F.min("step_id").alias("next_step_id")))


def next_state(status: Column, error_code: Column, attempts: Column, state: Column,
               max_retries: int = K.MAX_RETRIES) -> Column:
    """State a step should move to after a reported result."""
    retry = F.when(attempts < max_retries, "RETRYING").otherwise("HYBRID_FALLBACK")
    return (F.when(status == "success", "SUCCESS")
            .when(status != "error", state)
            .when(error_code == "SELECTOR_NOT_FOUND", "HYBRID_FALLBACK")
            .when(error_code == "ELEMENT_OBSCURED", "RETRYING")
            .when(error_code.isin("CAPTCHA_TRIGGERED", "AUTH_REQUIRED"), "BLOCKED_APPROVAL")
            .otherwise(retry))


def backoff_ms(attempt: Column) -> Column:
    """Wait before the next attempt: 300 ms doubling up to 2 s."""
    return F.least(F.lit(300) * F.pow(F.lit(2), attempt - 1), F.lit(2000)).cast("int")


def retry_schedule(steps: DataFrame, timeout: str = "timeout_ms") -> DataFrame:
    """Every retry that still fits under a step's timeout, with its start time.

    The wait before attempt n+1 must end before the timeout, so the number of
    attempts follows from the timeout and rows are generated in place.
    """
    # Waits of 300, 600, 1200 and then 2000 ms end at 300 * (2^n - 1), and from the third on 2000 ms apart.
    count = F.expr(f"cast(CASE WHEN {timeout} <= 2100 THEN 3 ELSE 3 + ceil(({timeout} - 2100) / 2000.0) END AS int)")
    attempts = F.explode(F.sequence(F.lit(1), count)).alias("attempt")
    elapsed = F.expr("cast(CASE WHEN attempt <= 3 THEN 300 * (pow(2, attempt) - 1) ELSE 2100 + 2000 * (attempt - 3) END AS int)")
    rows = steps.select(*steps.columns, attempts).withColumn("elapsed_ms", elapsed)
    return rows.where(F.col("elapsed_ms") < F.col(timeout)).select(
        *steps.columns, "attempt", backoff_ms(F.col("attempt")).alias("backoff_ms"), "elapsed_ms")
