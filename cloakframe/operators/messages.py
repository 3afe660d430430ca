"""Protocol messages: validation, routing, goals, plan start and step results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import constants as K
from cloakframe.functions.risk import risk_level, risk_reason
from cloakframe.operators.segments import carry, fit_segment
from cloakframe.schema import PLAN_STEP
from cloakframe.session import materialize


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Envelope fields of raw JSON lines plus a ``code`` for the bad ones.

    ``INVALID_JSON`` marks text that is no JSON object, ``INVALID_ENVELOPE`` an
    unknown type, an empty session, a wrongly typed timestamp or payload.
    """
    carried = [c for c in raw.columns if c != column]
    fields = ("type", "session_id", "client_timestamp", "payload")
    parts = raw.select(*carried, F.try_parse_json(column).alias("_doc")).select(
        *carried, F.schema_of_variant("_doc").alias("_kind"),
        *[F.try_variant_get("_doc", f"$.{n}", "string").alias(f"_{n}") for n in fields],
        *[F.schema_of_variant(F.try_variant_get("_doc", f"$.{n}", "variant")).alias(f"_kind_{n}")
          for n in fields])
    text = {n: F.col(f"_{n}") for n in fields}
    kinds = {n: F.col(f"_kind_{n}") for n in fields}
    known = F.coalesce(text["type"].isin(K.MESSAGE_TYPES) & (kinds["type"] == "STRING"), F.lit(False))
    session_ok = F.coalesce((kinds["session_id"] == "STRING") & (F.length(text["session_id"]) > 0), F.lit(False))
    stamp = text["client_timestamp"].try_cast("double")
    stamp_ok = text["client_timestamp"].isNull() | stamp.isNotNull()
    payload_ok = kinds["payload"].isNull() | F.startswith(kinds["payload"], F.lit("OBJECT"))
    is_object = F.coalesce(F.startswith("_kind", F.lit("OBJECT")), F.lit(False))
    code = (F.when(~is_object, "INVALID_JSON")
            .when(~(known & session_ok & stamp_ok & payload_ok), "INVALID_ENVELOPE"))
    parsed = F.struct(
        text["type"].alias("type"), text["session_id"].alias("session_id"),
        stamp.alias("client_timestamp"), F.coalesce(text["payload"], F.lit("{}")).alias("payload"),
        code.alias("code"))
    # A filter on the code stays above the generator, so it does not parse again.
    return parts.select(*carried, F.explode_outer(F.array(parsed)).alias("_m")).select(*carried, "_m.*")


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid messages, dead letters with their code)."""
    return parsed.where(F.col("code").isNull()).drop("code"), parsed.where(F.col("code").isNotNull())


def route(messages: DataFrame) -> DataFrame:
    """Handler of each message; server-side types have none."""
    table = F.create_map(*[F.lit(x) for kv in K.MESSAGE_ROUTES.items() for x in kv])
    return messages.withColumn("route", F.coalesce(table[F.col("type")], F.lit("unknown_type")))


def goal_for_plan(messages: DataFrame, order: tuple[str, ...] = ("ts", "seq"),
                  segment: Column | None = None) -> DataFrame:
    """Plan-triggering messages with the goal they consume.

    ``messages`` has ``goal`` (set on queries) and ``triggers_plan``.  A goal is
    consumed by the first trigger after it in its session, so a trigger gets
    the last goal only if no other trigger came in between.
    """
    messages = materialize(messages)
    segment = segment if segment is not None else fit_segment(messages, ["session_id"], order[0])
    known = carry(messages, ["session_id"], list(order), segment,
                  last={"_last_goal": F.when(F.col("goal").isNotNull(), F.struct(*order, "goal"))},
                  before={"_last_trigger": F.when(F.col("triggers_plan"), F.struct(*order))})
    goal_at = F.struct(*[F.col(f"_last_goal.{o}") for o in order])
    # A trigger that itself carries a goal stores it first, then consumes it.
    fresh = F.col("_last_trigger").isNull() | (F.col("_last_trigger") < goal_at)
    return (known.where("triggers_plan")
            .withColumn("goal", F.when(F.coalesce(fresh, F.lit(False)), F.col("_last_goal.goal")))
            .drop("_last_goal", "_last_trigger", "triggers_plan"))


def normalize_steps(plans: DataFrame, steps: str = "steps") -> DataFrame:
    """One row per step in nested form, from nested or flat step structs."""
    s = F.explode(F.col(steps).cast(f"array<{PLAN_STEP}>")).alias("s")
    rows = plans.select(*[c for c in plans.columns if c != steps], s)

    def either(flat: str, nested: str | None = None) -> Column:
        return F.coalesce(F.col(f"s.{flat}"), F.col(f"s.target.{nested or flat}"))

    selector, coordinates = either("selector"), either("coordinates")
    mode = F.coalesce(F.when(F.col("s.execution_mode") != "", F.col("s.execution_mode")),
                      F.when(F.coalesce(selector, F.lit("")).eqNullSafe(F.lit(""))
                             & coordinates.isNotNull(), "VISION"), F.lit("DOM"))
    return rows.select(
        *[c for c in plans.columns if c != steps],
        F.coalesce("s.id", "s.step_id", "s.action_id").alias("step_id"), F.col("s.action"),
        F.struct(selector.alias("selector"), either("url").alias("url"),
                 coordinates.alias("coordinates"), either("text").alias("text"),
                 either("tab_id").alias("tab_id"), either("tab_purpose").alias("tab_purpose")).alias("target"),
        "s.value", "s.key", "s.vault_key", mode.alias("execution_mode"),
        F.coalesce("s.protocol_level", "s.risk_level", "s.riskLevel", F.lit("SAFE")).alias("protocol_level"),
        "s.description", "s.verify", "s.fallback", "s.timeout_ms", "s.duration_ms")


def wire_steps(steps: DataFrame) -> Column:
    """A step as wire JSON; an empty target and absent parts are left out."""
    def some(name: str) -> Column:
        return F.when(F.col(f"target.{name}") != "", F.col(f"target.{name}")).alias(name)

    target = F.struct(some("selector"),
                      F.when(F.size("target.coordinates") > 0, F.col("target.coordinates")).alias("coordinates"),
                      some("url"), some("text"), F.col("target.tab_id").alias("tab_id"))
    filled = F.coalesce(*[F.col(f"target.{n}").cast("string") for n in ("tab_id",)],
                        F.when(F.col("target.selector") != "", "x"), F.when(F.col("target.url") != "", "x"),
                        F.when(F.col("target.text") != "", "x"),
                        F.when(F.size("target.coordinates") > 0, "x"))
    return F.to_json(F.struct(
        F.col("step_id").alias("id"), "action", F.when(filled.isNotNull(), target).alias("target"),
        "value", "key", "vault_key", "execution_mode", "protocol_level", "description", "timeout_ms",
        "verify", "duration_ms"))


def classify(steps: DataFrame) -> DataFrame:
    """Steps with their risk level and reason (the level replaces the given one)."""
    return (steps.withColumn("protocol_level", risk_level())
            .withColumn("reason", risk_reason(level="protocol_level")))


def invalid_plan_reason() -> Column:
    """Why a plan step row (step_id, action, total_steps, session_id) is rejected."""
    return (F.when(F.coalesce(F.length("session_id"), F.lit(0)) < 1, "session_id missing")
            .when(F.coalesce("total_steps", F.lit(0)) < 1, "total_steps below 1")
            .when(F.coalesce("step_id", F.lit(0)) < 1, "step id below 1")
            .when(~F.coalesce(F.col("action").isin(K.ACTIONS), F.lit(False)), "unknown action"))


def plan_start(steps: DataFrame) -> DataFrame:
    """First message after a plan: ask approval for its first critical step, or go.

    With any critical step, all of those are blocked and nothing is dispatched.
    """
    critical = F.col("protocol_level") == "CRITICAL"
    step = F.col("step_id")
    return (steps.groupBy("session_id")
            .agg(F.min(F.when(critical, step)).alias("_ask"), F.min(step).alias("_first"),
                 F.count_if(critical).alias("blocked_steps"))
            .select("session_id",
                    F.when(F.col("_ask").isNotNull(), "APPROVAL_REQUIRED").otherwise("NEXT_STEP").alias("message"),
                    F.coalesce("_ask", "_first").alias("step_id"), "blocked_steps"))


def result_response(success: Column, error_code: Column, has_screenshot: Column) -> Column:
    """Kind of message that answers a step result."""
    return (F.when(success, "DISPATCH_NEXT")
            .when((error_code == "SELECTOR_NOT_FOUND") & has_screenshot, "NEXT_STEP_HYBRID")
            .when((error_code == "ELEMENT_OBSCURED") & has_screenshot, "DYNAMIC_OBSTACLE")
            .when(error_code == "CAPTCHA_TRIGGERED", "APPROVAL_REQUIRED_CAPTCHA")
            .when(error_code == "PAGE_TIMEOUT", "NEXT_STEP_WAIT")
            .when(error_code == "AUTH_REQUIRED", "APPROVAL_REQUIRED_AUTH")
            .otherwise("DISPATCH_NEXT"))


def join_results(results: DataFrame, steps: DataFrame) -> DataFrame:
    """Step results with the plan step they belong to."""
    return results.join(steps, ["session_id", "step_id"])


def element_lines(elements: Column) -> Column:
    """Elements as prompt text, one line each."""
    def line(e: Column) -> Column:
        def part(prefix: str, value: Column, suffix: str = "") -> Column:
            return F.when(F.coalesce(value, F.lit("")) != "",
                          F.concat(F.lit(prefix), value, F.lit(suffix)))
        return F.concat_ws(
            " ", F.concat(F.lit("["), F.coalesce(e["id"], F.lit("?")), F.lit("] <"),
                          F.coalesce(e["tag"], F.lit("?")), F.lit(">")),
            part("role=", e["role"]), part('text="', F.left(e["text"], F.lit(40)), '"'),
            part('placeholder="', F.left(e["placeholder"], F.lit(30)), '"'),
            part("sel=", e["selector"]), part("type=", e["type"]),
            F.when(F.size(e["rect"]) > 0, F.concat(
                F.lit("rect=["), F.array_join(e["rect"].cast("array<string>"), ", "), F.lit("]"))))
    lines = F.array_join(F.transform(elements, line), "\n")
    return F.when(F.coalesce(F.size(elements), F.lit(0)) > 0, lines).otherwise("No interactive elements found.")


def goal_context(goal: Column, url: Column, elements: Column, vault: Column,
                 previous: Column | None = None, history: Column | None = None) -> Column:
    """Goal, page and vault flags as one text block; optional parts only if present."""
    flags = F.array_join(F.transform(F.map_entries(vault), lambda kv: F.concat(
        kv["key"], F.lit("="), F.initcap(kv["value"].cast("string")))), ", ")
    parts = [F.concat(F.lit("USER GOAL: "), goal), F.concat(F.lit("CURRENT URL: "), url),
             F.concat(F.lit("DOM SNAPSHOT ("), F.greatest(F.size(elements), F.lit(0)).cast("string"),
                      F.lit(" interactive elements):\n"), element_lines(elements)),
             F.concat(F.lit("VAULT MANIFEST: "),
                      F.coalesce(F.when(flags != "", flags), F.lit("none")))]
    for label, extra in (("PREVIOUS STEPS: ", previous), ("SESSION HISTORY: ", history)):
        if extra is not None:
            parts.append(F.when(extra.isNotNull(), F.concat(F.lit(label), extra)))
    return F.concat_ws("\n\n", *parts)
