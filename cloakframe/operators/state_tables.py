"""Session and memory tables kept as logs of writes.

A table with update semantics is an append-only log; reading it takes the
latest write per key with a hash aggregate (``max_by``), so nothing is sorted
and a key with many writes is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEMORY_VALUES = ("value", "category", "source_session_id")
SESSION_FIELDS = ("goal", "plan_id", "step_ids", "completed_step_ids",
                  "user_preferences", "extracted_entities")


def latest(log: DataFrame, key: str, order: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Latest write per key; ``order`` must be a total order within a key."""
    return (log.groupBy(key)
            .agg(F.max_by(F.struct(*values, *order), F.struct(*order)).alias("w"))
            .select(key, "w.*"))


def memory_table(log: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Current memory entries; a replaced entry starts over, creation time included."""
    rows = latest(log, "key", order, MEMORY_VALUES)
    return rows.withColumn("created_at", F.col(order[0])).withColumn("updated_at", F.col(order[0]))


def retrieve(memory: DataFrame, key: str) -> DataFrame:
    return memory.where(F.col("key") == key)


def delete_keys(memory: DataFrame, keys: DataFrame) -> DataFrame:
    return memory.join(keys.select("key").distinct(), "key", "left_anti")


def search(memory: DataFrame, text: str) -> DataFrame:
    """Entries whose key contains ``text`` in any case, newest first."""
    hit = F.contains(F.lower("key"), F.lit(text.lower()))
    return memory.where(hit).orderBy(F.desc("updated_at"), "key")


def clear_category(memory: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """(remaining table, count of removed entries)."""
    hit = F.col("category") == category
    return memory.where(~hit), memory.agg(F.count_if(hit).alias("deleted"))


def newest(table: DataFrame, by: tuple[str, ...], n: int, ts: str = "updated_at",
           tie: str = "key") -> DataFrame:
    """The ``n`` newest rows per group (Spark limits each partition first)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(ts), F.desc(tie)))
    return table.withColumn("rank", rank).where(F.col("rank") <= n)


def history(memory: DataFrame, limit: int = 50) -> DataFrame:
    return (memory.where(F.col("category") == "history")
            .orderBy(F.desc("updated_at"), F.desc("key")).limit(limit))


def session_context(memory: DataFrame, goals: int = 5) -> DataFrame:
    """Preferences, newest goals and entities of every source session, as rows.

    ``part`` names the section and ``rank`` orders the goals.  The parts stay
    rows, so a session with any number of entries is never gathered in one place.
    """
    def part(category: str, name: str) -> DataFrame:
        return memory.where(F.col("category") == category).select(
            "source_session_id", F.lit(name).alias("part"), "key", "value",
            F.lit(None).cast("int").alias("rank"))

    recent = newest(memory.where(F.col("category") == "goals"), ("source_session_id",), goals)
    return (part("preferences", "user_preferences")
            .unionByName(recent.select("source_session_id", F.lit("recent_goals").alias("part"),
                                       "key", "value", "rank"))
            .unionByName(part("entities", "known_entities")))


def sessions_table(log: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Current sessions from a log of create, update, archive and delete writes.

    ``create`` starts a session over, ``update`` sets only the fields it
    carries, ``archive`` hides it and ``delete`` removes it.  Updates before
    the last create or delete do not count.
    """
    when = F.struct(*order)
    is_new = F.col("op") == "create"
    resets = log.groupBy("session_id").agg(
        F.max(F.when(is_new, when)).alias("_created"),
        F.max(F.when(F.col("op") == "delete", when)).alias("_deleted"))
    alive = resets.where(F.col("_created").isNotNull()
                         & (F.col("_deleted").isNull() | (F.col("_deleted") < F.col("_created"))))
    rows = log.join(alive, "session_id").where(when >= F.col("_created"))
    fields = [f for f in SESSION_FIELDS if f in log.columns]
    latest_value = [F.max_by(f, F.when(F.col(f).isNotNull(), when)).alias(f) for f in fields]
    return rows.groupBy("session_id").agg(
        *latest_value, F.min(F.when(is_new, F.col(order[0]))).alias("created_at"),
        F.max(order[0]).alias("updated_at"),
        F.bool_or(F.col("op") == "archive").alias("archived"))


def partial_update(log: DataFrame, key: str, order: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Latest non-null value of every field on its own."""
    when = F.struct(*order)
    return log.groupBy(key).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), when)).alias(f) for f in fields],
        F.max(order[0]).alias("updated_at"))


def restore_session(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Saved plan of each requested session, unless it is unknown or archived."""
    live = sessions.where(~F.col("archived")).withColumn("_found", F.lit(True))
    return (requests.join(live, "session_id", "left")
            .withColumn("restored", F.coalesce("_found", F.lit(False))).drop("_found", "archived"))


def list_sessions(sessions: DataFrame, include_archived: bool = False) -> DataFrame:
    rows = sessions if include_archived else sessions.where(~F.col("archived"))
    return (rows.select("session_id", "goal", "created_at", "updated_at", "archived")
            .orderBy(F.desc("created_at"), "session_id"))
