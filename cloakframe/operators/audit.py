"""Proof that no vault value leaves, and the statistics around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import constants as K
from cloakframe.functions.text import severity
from cloakframe.operators.leakproof import occurrences
from cloakframe.operators.segments import block_of, running_sum, running_sums
from cloakframe.operators.spans import ELEMENT_KEY
from cloakframe.operators.tokens import password_element

OUTGOING_FIELDS = ("text", "placeholder", "value", "href", "nearby_labels", "selector",
                   "parent_class", "parent_id")
MIN_SECRET = 3             # characters; shorter values are no secrets to the proof


def outgoing_text(df: DataFrame) -> Column:
    """All text of a row that would leave, as one string."""
    fields = [F.col(c) for c in OUTGOING_FIELDS if c in df.columns]
    return F.concat_ws("\u0001", *fields)


def checkable(vault: DataFrame, min_secret: int = MIN_SECRET) -> DataFrame:
    """Vault values long enough to be told apart from ordinary text."""
    return (vault.where((F.length("value") >= min_secret) & (F.col("value") != K.HIDDEN_VALUE))
            .select("session_id", "token", "value"))


def leaks(payload: DataFrame, vault: DataFrame, key: tuple[str, ...] = ELEMENT_KEY,
          min_secret: int = MIN_SECRET) -> DataFrame:
    """Every (row, token) whose raw value still occurs in the row's outgoing text.

    The search is by substring and exact, for vaults of any size; a row meets
    the values of its own session.
    """
    keys = [f"_k_{k}" for k in key]
    texts = payload.select(F.col("session_id").alias("_scope"), outgoing_text(payload).alias("_out"),
                           *[F.col(k).alias(f"_k_{k}") for k in key])
    secrets = checkable(vault, min_secret).select(
        F.col("session_id").alias("_scope"), F.col("value").alias("_value"), "token")
    found = occurrences(texts, secrets, keys, ["token"])
    return found.select(*[F.col(f"_k_{k}").alias(k) for k in key], "token")


def leaks_across_sessions(payload: DataFrame, vault: DataFrame, key: tuple[str, ...] = ELEMENT_KEY,
                          min_secret: int = MIN_SECRET) -> DataFrame:
    """Values of any session that occur in any outgoing text, by the same search.

    Every text is read once for each part of all values.
    """
    keys = [f"_k_{k}" for k in key]
    texts = payload.select(F.lit("").alias("_scope"), outgoing_text(payload).alias("_out"),
                           *[F.col(k).alias(f"_k_{k}") for k in key])
    secrets = checkable(vault, min_secret).select(
        F.lit("").alias("_scope"), F.col("value").alias("_value"), F.col("session_id").alias("owner_session"), "token")
    found = occurrences(texts, secrets, keys, ["owner_session", "token"])
    return found.select(*[F.col(f"_k_{k}").alias(k) for k in key], "owner_session", "token")


def egress_report(payload: DataFrame, vault: DataFrame, min_secret: int = MIN_SECRET) -> DataFrame:
    """Per snapshot: how many tokens leaked, which, and whether it may leave."""
    found = (leaks(payload, vault, min_secret=min_secret)
             .groupBy("session_id", "step_no")
             .agg(F.sort_array(F.collect_set("token")).alias("leaked_tokens")))
    snapshots = payload.select("session_id", "step_no").distinct()
    out = snapshots.join(found, ["session_id", "step_no"], "left")
    count = F.coalesce(F.size("leaked_tokens"), F.lit(0))
    count = F.when(F.col("leaked_tokens").isNull(), 0).otherwise(count)
    return out.select("session_id", "step_no", count.alias("leaked_count"),
                      F.coalesce("leaked_tokens", F.array().cast("array<string>")).alias("leaked_tokens"),
                      (count == 0).alias("safe"))


def split_by_proof(payload: DataFrame, report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(safe, blocked): a snapshot without a passed proof is blocked."""
    passed = report.where("safe").select("session_id", "step_no")
    keys = ["session_id", "step_no"]
    return payload.join(passed, keys, "left_semi"), payload.join(passed, keys, "left_anti")


def pii_breakdown(spans: DataFrame, elements: DataFrame | None = None,
                  by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Spans per report bucket; overwritten password elements count as other."""
    rows = spans.where(F.col("value") != K.HIDDEN_VALUE).select(*by, "type")
    if elements is not None:
        rows = rows.unionByName(elements.where(password_element(elements))
                                .select(*by, F.lit("PASSWORD_FIELD").alias("type")))
    buckets = [F.count_if(F.col("type") == kind).alias(name)
               for kind, name in K.BREAKDOWN_BUCKETS.items()]
    return rows.groupBy(*by).agg(
        *buckets, F.count_if(~F.col("type").isin(list(K.BREAKDOWN_BUCKETS))).alias("other"))


def method_counts(spans: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Spans per detection method; an unknown method counts as regex."""
    known = F.coalesce(F.col("method"), F.lit("REGEX"))
    known = F.when(known.isin(K.DETECTION_METHODS), known).otherwise("REGEX")
    return spans.groupBy(*by).agg(
        *[F.count_if(known == m).alias(m.lower()) for m in K.DETECTION_METHODS])


def masked_counts(redacted: DataFrame, vault: DataFrame) -> DataFrame:
    """Per snapshot: new tokens (each counted once) and changed elements."""
    fields = (redacted.groupBy("session_id", "step_no")
              .agg(F.count("*").alias("n_elements"), F.count_if("is_redacted").alias("fields_masked")))
    new = (vault.groupBy("session_id", F.col("first_step").alias("step_no"))
           .agg(F.count("*").alias("new_tokens")))
    return (fields.join(new, ["session_id", "step_no"], "left")
            .withColumn("new_tokens", F.coalesce("new_tokens", F.lit(0))))


def tokens_so_far(counts: DataFrame) -> DataFrame:
    """Tokens known to a session up to and including each snapshot."""
    return running_sum(counts, ["session_id"], ["step_no"], block_of(F.col("step_no")),
                       F.col("new_tokens"), "session_tokens")


def telemetry(audit: DataFrame, report: DataFrame) -> DataFrame:
    """Per session: new tokens by severity, tokens in use, and the leak totals."""
    tiers = audit.groupBy("session_id").agg(
        F.count_if(F.col("category") == "SPII").alias("spii_count"),
        F.count_if(F.col("category") == "PII").alias("pii_count"),
        F.count_if(F.col("category") == "CONTEXTUAL").alias("contextual_count"),
        F.count_distinct("token").alias("total_masked"))
    proof = report.groupBy("session_id").agg(
        F.sum("leaked_count").alias("leaked_count"), F.bool_and("safe").alias("zero_egress_verified"))
    out = proof.join(tiers, "session_id", "full_outer")
    zero = ["spii_count", "pii_count", "contextual_count", "total_masked", "leaked_count"]
    return out.select(
        "session_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
        F.coalesce("zero_egress_verified", F.lit(False)).alias("zero_egress_verified"))


def session_stats(calls: DataFrame) -> DataFrame:
    """Totals per session over calls (session_id, pii_tokens, faces, time_ms)."""
    return calls.groupBy("session_id").agg(
        F.count("*").alias("total_calls"), F.sum("pii_tokens").alias("total_pii"),
        F.sum("faces").alias("total_faces"), F.avg("time_ms").alias("avg_time_ms"))


def running_stats(calls: DataFrame, segment: Column) -> DataFrame:
    """The same, after each call in order of ``call_no``."""
    out = running_sums(calls, ["session_id"], ["call_no"], segment, {
        "total_calls": F.lit(1), "total_pii": F.col("pii_tokens"), "_time": F.col("time_ms")})
    return out.withColumn("avg_time_ms", F.col("_time") / F.col("total_calls")).drop("_time")


def audit_readout(audit: DataFrame, session_id: str | None = None) -> DataFrame:
    """Audit rows and distinct tokens per session."""
    rows = audit if session_id is None else audit.where(F.col("session_id") == session_id)
    return rows.groupBy("session_id").agg(
        F.count("*").alias("audit_rows"), F.count_distinct("token").alias("token_count"))


def with_severity(spans: DataFrame) -> DataFrame:
    return spans.withColumn("category", severity(F.col("type")))
