"""Page snapshots, messages and state tables as Spark sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.text import first_filled
from cloakframe.schema import MEMORY_TABLE, SESSION_TABLE, SNAPSHOT


def read_snapshots(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Snapshot files, read with a fixed schema: one JSON document each, or one per line."""
    return spark.read.schema(SNAPSHOT).option("multiLine", not lines).json(path)


def stream_snapshots(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same as a stream: one JSON document per line."""
    reader = spark.readStream.schema(SNAPSHOT)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def explode_elements(snapshots: DataFrame) -> DataFrame:
    """Elements of snapshots as rows, in document order, with canonical names."""
    keys = [c for c in ("session_id", "step_no") if c in snapshots.columns]
    return (snapshots.select(*keys, F.posexplode("elements").alias("element_pos", "e"))
            .select(*keys, "element_pos", F.col("e.id").alias("element_id"), "e.tag", "e.selector",
                    "e.text", "e.placeholder", "e.value", "e.href", "e.type", "e.autocomplete",
                    "e.role", F.coalesce("e.interactive", F.lit(False)).alias("interactive"),
                    F.coalesce("e.coordinates", "e.rect").alias("coordinates"),
                    F.col("e.parentTag").alias("parent_tag"), F.col("e.parentClass").alias("parent_class"),
                    F.col("e.parentId").alias("parent_id"),
                    F.col("e.nearbyLabels").alias("nearby_labels")))


def with_defaults(elements: DataFrame) -> DataFrame:
    """Elements with empty strings for absent text and labels from the placeholder."""
    named = ("text", "placeholder", "value", "tag", "type", "parent_tag", "parent_class", "parent_id",
             "autocomplete", "selector", "role")
    out = elements
    for name in named:
        if name in elements.columns:
            out = out.withColumn(name, F.coalesce(name, F.lit("")))
    return out.withColumn("nearby_labels", first_filled(F.col("nearby_labels"), F.col("placeholder")))


def context_columns(elements: DataFrame) -> DataFrame:
    """Container tag and label of an element after falling back to tag and placeholder."""
    return elements.withColumn("context_tag", first_filled(F.col("parent_tag"), F.col("tag"))).withColumn(
        "context_label", first_filled(F.col("nearby_labels"), F.col("placeholder")))


def element_ids(types: Column, position: Column) -> Column:
    """``e_n`` in document order; search inputs are marked."""
    number = (position + 1).cast("string")
    return F.when(F.lower(types) == "search", F.concat(F.lit("e_search_"), number)).otherwise(
        F.concat(F.lit("e_"), number))


def context_sufficient(elements: Column) -> Column:
    return F.coalesce(F.size(elements), F.lit(0)) > 0


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session table with its JSON columns decoded."""
    raw = spark.read.schema(SESSION_TABLE).parquet(path)
    return (raw.withColumn("step_ids", F.from_json("step_ids", "array<int>"))
            .withColumn("completed_step_ids", F.from_json("completed_step_ids", "array<int>"))
            .withColumn("user_preferences", F.from_json("user_preferences", "map<string,string>"))
            .withColumn("extracted_entities", F.from_json("extracted_entities", "map<string,string>"))
            .withColumn("created_at", F.timestamp_seconds("created_at"))
            .withColumn("updated_at", F.timestamp_seconds("updated_at"))
            .withColumn("archived", F.col("archived") == 1))


def write_sessions(sessions: DataFrame, path: str) -> None:
    """Write the session table, JSON columns encoded; archived rows apart."""
    def stamp(name: str) -> Column:
        return (F.unix_micros(name) / 1e6).alias(name)
    (sessions.select(
        "session_id", "goal", "plan_id", F.to_json("step_ids").alias("step_ids"),
        F.to_json("completed_step_ids").alias("completed_step_ids"),
        F.to_json("user_preferences").alias("user_preferences"),
        F.to_json("extracted_entities").alias("extracted_entities"),
        stamp("created_at"), stamp("updated_at"), F.col("archived").cast("int").alias("archived"))
     .write.mode("overwrite").partitionBy("archived").parquet(path))


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEMORY_TABLE).parquet(path)


def write_memory(memory: DataFrame, path: str) -> None:
    memory.write.mode("overwrite").partitionBy("category").parquet(path)


def save_snapshot(data: DataFrame, path: str) -> None:
    """Memory snapshots as JSON files, one folder per session."""
    data.write.mode("overwrite").partitionBy("session_id").json(path)


def load_snapshot(spark: SparkSession, path: str, session_id: str, schema: str) -> DataFrame:
    """One session's snapshot; only its folder is read."""
    return (spark.read.schema(f"{schema}, session_id string").json(path)
            .where(F.col("session_id") == session_id))


def guarded_write(redacted: DataFrame, vault: DataFrame, path: str, quarantine: str) -> None:
    """Prove and write: only proven rows go to ``path``, the rest to quarantine.

    The rows are stored before the proof, so what is proven is what is written.
    """
    from cloakframe.operators.audit import egress_report, split_by_proof
    from cloakframe.session import materialize

    stored = materialize(redacted)
    safe, blocked = split_by_proof(stored, materialize(egress_report(stored, vault)))
    safe.write.mode("append").parquet(path)
    blocked.write.mode("append").parquet(quarantine)


def merge_maps(base: Column, later: Column) -> Column:
    """Union of two maps; the later one wins (needs the LAST_WIN key policy)."""
    return F.map_concat(F.coalesce(base, F.create_map().cast("map<string,string>")),
                        F.coalesce(later, F.create_map().cast("map<string,string>")))


def iso_time(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
