"""Every operator as a named query over the base tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.functions import constants as K
from cloakframe.functions import geometry as G
from cloakframe.functions import parsing as P
from cloakframe.functions import sqlfuncs
from cloakframe.functions import text as T
from cloakframe.functions.risk import risk_level, risk_reason
from cloakframe.operators import (activity, audit, detect, incremental, messages, ner, ocr, segments,
                                  spans, state_tables, steps, targets, tokens)
from cloakframe.plans import privacy, synth
from cloakframe.session import checkpoint_dir, configure, dealt, materialize, spread
from cloakframe.sources import html, snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(fn(configure(spark), sf_dir))
    QUERIES[fn.__name__] = run
    return fn


def flat(df: DataFrame) -> DataFrame:
    """Comparable output: integers as bigint, arrays joined, times in seconds."""
    out = []
    for f in df.schema.fields:
        kind, col = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif kind == "float":
            col = col.cast("double")
        elif kind.startswith("array"):
            col = F.array_join(col.cast("array<string>"), ",")
        elif kind == "timestamp":
            col = F.unix_micros(col)
        out.append(col.alias(f.name))
    return df.select(*out)


# --- inputs --------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; its zone-less times are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def document_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.as_elements(documents(spark, sf_dir), "source", "doc_id")


def derived(spark: SparkSession, sf_dir: str, base: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, base).selectExpr(*synth.select_list(columns))


def labelled_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).selectExpr(*synth.select_list(synth.ELEMENTS))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).selectExpr(*synth.select_list(synth.INPUTS))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as snapshots: two turns make a step, shown twice; each role is an element."""
    rows = table(spark, sf_dir, "conversations").withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(
        F.col("conv_id").cast("string").alias("session_id"), F.expr(synth.TURN_STEP).alias("step_no"),
        (F.col("turn") % 2).cast("int").alias("element_pos"),
        F.col("role").alias("element_id"),
        F.expr(synth.TURN_TEXT).alias("text"))


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "events", synth.STEP_EVENTS)


def finished_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.run_steps(step_events(spark, sf_dir))


def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "part", synth.PLAN_STEPS)


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_tables.memory_table(derived(spark, sf_dir, "events", synth.MEMORY_LOG))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_tables.sessions_table(derived(spark, sf_dir, "events", synth.SESSION_LOG))


def token_lists(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, chunk_no, tokens): the words of the documents as the token lists of a model, one per chunk."""
    per, words = synth.NER_WORDS_PER_GROUP * 10, F.split("text", r"[ \n]+")
    pieces = F.expr(f"transform(sequence(0, (size(_w) - 1) div {per}), c -> slice(_w, c * {per} + 1, {per}))")
    chunks = docs.withColumn("_w", words).select("doc_id", F.posexplode_outer(pieces).alias("chunk_no", "_w"))
    # The formulas of synth as lookups: a lambda is interpreted, and a chain of conditions would be walked for every word.
    at = "cast((doc_id + pos) % 7 AS INT)"
    labels = "array('B-PER', 'I-PER', 'I-PER', 'B-LOC', 'I-PER', 'B-ORG', 'I-MISC')"
    scores = f"array({', '.join(f'{70 + k}D / 100' for k in range(30))})"
    token = (f"named_struct('word', if({at} = 2, concat('##', raw_word), raw_word), 'entity', coalesce(get({labels}, {at}), 'I-MISC'), "
             f"'score', get({scores}, cast((doc_id * 31 + pos * 17) % 30 AS INT)), 'start', pos * 10, 'end', pos * 10 + length(raw_word))")
    places = f"sequence(chunk_no * {per}, chunk_no * {per} + size(_w) - 1)"
    none = "array(cast(NULL AS STRING)), array(cast(NULL AS INT))"
    tokens = F.expr(f"if(_w IS NULL, zip_with({none}, (raw_word, pos) -> {token}), zip_with(_w, {places}, (raw_word, pos) -> {token}))")
    return chunks.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), tokens.alias("tokens"))


def entity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lists(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents laid out as an image, 8 by 16 pixels a letter."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("doc_id").alias("image_id"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "text"))
    return rows.select("image_id", "line_no", "text", F.lit(10).alias("x"),
                       (F.col("line_no") * 20).alias("y"), (F.length("text") * 8).alias("w"),
                       F.lit(16).alias("h"))


def text_words(lines: DataFrame) -> DataFrame:
    rows = lines.select("image_id", "line_no", "y", F.posexplode_outer(F.split("text", " ")).alias("word_no", "word"))
    confidence = (F.col("image_id") * 7 + F.col("line_no") * 3 + F.col("word_no") * 13) % 101
    return rows.select("image_id", "line_no", "word_no", F.col("word").alias("text"),
                       confidence.alias("confidence"), (F.col("word_no") * 50 + 10).alias("x"), "y",
                       (F.length("word") * 8).alias("w"), F.lit(16).alias("h"))


def span_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "field", "type", "value", F.col("start").alias("start_pos"),
                     F.col("end").alias("end_pos"), "confidence", "method")


def span_rows(scanned: DataFrame, *keys: str) -> DataFrame:
    return spans.explode_spans(scanned, keys).drop("span_ord", "field_ord")


# --- detectors -----------------------------------------------------------------

def _document_spans(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    found = detect.scan_text(documents(spark, sf_dir).select("doc_id", "text"))
    rows = span_rows(found, "doc_id")
    return span_columns(rows if kind is None else rows.where(F.col("type") == kind), "doc_id")


def _labelled_spans(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = detect.scan_fields(labelled_elements(spark, sf_dir), ("text",))
    rows = span_rows(found, "element_id")
    return span_columns(rows.where(F.col("type") == kind), "element_id")


@query
def spans_greedy(spark, sf_dir):
    return _document_spans(spark, sf_dir)


@query
def det_email(spark, sf_dir):
    return _document_spans(spark, sf_dir, "EMAIL")


@query
def det_ip(spark, sf_dir):
    return _document_spans(spark, sf_dir, "IP")


@query
def det_card_luhn(spark, sf_dir):
    return _document_spans(spark, sf_dir, "CARD")


@query
def det_phone_intl(spark, sf_dir):
    """International numbers: made from the orders, as documents hold none that match."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS doc_id",
        "concat(CASE o_orderkey % 3 WHEN 0 THEN '+44 ' WHEN 1 THEN '+91 ' ELSE '+1-' END, "
        "lpad(CAST(o_orderkey AS STRING), 9, '2'), ' ext') AS text")
    return span_columns(span_rows(detect.scan_text(rows), "doc_id"), "doc_id")


def _register_labelled() -> None:
    kinds = {"upi": "UPI", "email_context": "EMAIL", "card_labelled": "CARD", "bank_account": "BANK_ACCOUNT",
             "epfo_uan": "EPFO_UAN", "aadhaar": "AADHAAR", "pan": "PAN", "phone_in": "PHONE", "ifsc": "IFSC",
             "dob": "DOB", "passport": "PASSPORT", "otp": "OTP", "voter_id": "VOTER_ID", "dl": "DL",
             "vehicle_rc": "VEHICLE_RC"}
    for name, kind in kinds.items():
        def run(spark, sf_dir, kind=kind):
            return _labelled_spans(spark, sf_dir, kind)
        run.__name__ = f"det_{name}"
        query(run)


_register_labelled()


@query
def luhn_valid(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.luhn_valid(F.concat(F.lit("4"), F.lpad(F.col("o_orderkey").cast("string"), 15, "0"))).alias("ok"))


@query
def span_counts(spark, sf_dir):
    found = detect.scan_text(documents(spark, sf_dir))
    return spans.span_density(span_rows(found, "doc_id"), ("doc_id", "type", "method"))


@query
def pii_by_quality(spark, sf_dir):
    found = detect.scan_text(documents(spark, sf_dir)).select("doc_id", F.size("spans").alias("n"))
    return (found.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic")
            .agg(F.count("*").alias("n_docs"), F.count_if(F.col("n") > 0).alias("with_pii"),
                 F.sum("n").alias("n_spans")))


def _attribute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.scan_elements(inputs(spark, sf_dir))
    rows = span_rows(found, "element_id")
    return span_columns(rows, "element_id")


def _register_attributes() -> None:
    kinds = {"password": "PASSWORD_FIELD", "card": "CARD", "name": "NAME", "address": "ADDRESS", "avatar": "AVATAR",
             "bank_account": "BANK_ACCOUNT", "dl": "DL", "voter_id": "VOTER_ID", "epfo_uan": "EPFO_UAN",
             "vehicle_rc": "VEHICLE_RC"}
    for name, kind in kinds.items():
        def run(spark, sf_dir, kind=kind):
            return _attribute_rows(spark, sf_dir).where(F.col("type") == kind)
        run.__name__ = f"att_{name}"
        query(run)


_register_attributes()


@query
def ctx_flags(spark, sf_dir):
    elements = labelled_elements(spark, sf_dir)
    flags = detect.context_flags(elements)
    return elements.withColumn("c", F.expr(flags)).select("element_id", "c.*")


@query
def label_normalize(spark, sf_dir):
    return (labelled_elements(spark, sf_dir)
            .select("element_id", T.normalize_label(F.concat(F.lit(" #"), "nearby_labels", F.lit("! "))).alias("label")))


@query
def context_build(spark, sf_dir):
    rows = snapshots.context_columns(snapshots.with_defaults(inputs(spark, sf_dir)))
    return rows.select("element_id", "context_tag", "context_label", "text", "value", "nearby_labels")


@query
def digit_functions(spark, sf_dir):
    text = F.concat(F.lit("No. "), F.repeat((F.col("o_orderkey") % 13).cast("string"), 3))
    digits = T.digits_only(text)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", digits.alias("digits"), T.all_same_digit(digits).alias("same"), T.clip(text, 5).alias("clipped"))


@query
def email_parts(spark, sf_dir):
    rows = labelled_elements(spark, sf_dir).where(F.contains("text", F.lit("@")))
    return rows.select("element_id", T.mailbox(F.col("text")).alias("mailbox"),
                       T.mail_provider(F.col("text")).alias("provider"))


@query
def number_guards(spark, sf_dir):
    k = F.col("o_orderkey")
    tail = F.when(k % 5 == 0, "-12 34").when(k % 5 == 1, "-1x34").when(k % 5 == 2, ":34").when(k % 5 == 3, "--34").otherwise("z 34")
    text = F.concat(F.when(k % 3 == 0, "A").when(k % 3 == 1, " ").otherwise("7-"), k.cast("string"), tail)
    width = F.length("t")
    return (table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
            .select("o_orderkey",
                    T.part_of_longer_number(F.col("t"), width - 2, width).alias("tail_in_number"),
                    T.part_of_longer_number(F.col("t"), F.lit(1), F.lit(2)).alias("head_in_number"),
                    T.touches_alphanumeric(F.col("t"), width - 2, width).alias("tail_touches"),
                    T.touches_alphanumeric(F.col("t"), F.lit(1), F.lit(2)).alias("head_touches")))


# --- tokens --------------------------------------------------------------------

def _sanitized(spark: SparkSession, sf_dir: str) -> privacy.Sanitized:
    return privacy.sanitize(document_elements(spark, sf_dir))


def _vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.build_vault(privacy.scan(document_elements(spark, sf_dir)))


@query
def tok_number(spark, sf_dir):
    return _vault(spark, sf_dir).select("session_id", "token", "type", "value", "token_no", "first_step")


@query
def tok_redact(spark, sf_dir):
    return _sanitized(spark, sf_dir).redacted.select(
        "session_id", "step_no", "text", "is_redacted", "redacted_types", "redacted_tokens")


@query
def tok_inputs(spark, sf_dir):
    """Fields of form inputs after redaction, passwords overwritten."""
    z = privacy.sanitize(inputs(spark, sf_dir))
    return z.redacted.select("session_id", "element_id", "text", "value", "is_redacted",
                             "redacted_types", "redacted_tokens")


@query
def tok_manifest(spark, sf_dir):
    return _sanitized(spark, sf_dir).manifest


@query
def tok_snapshot_manifest(spark, sf_dir):
    rows = tokens.snapshot_manifest(_sanitized(spark, sf_dir).redacted)
    return rows.withColumn("token_types", F.to_json("token_types"))


@query
def tok_elements(spark, sf_dir):
    return tokens.manifest_elements(_sanitized(spark, sf_dir).redacted).drop("element_pos")


@query
def tok_audit(spark, sf_dir):
    e = inputs(spark, sf_dir)
    return tokens.audit_rows(tokens.build_vault(privacy.scan(e)), e)


@query
def tok_category(spark, sf_dir):
    return (_vault(spark, sf_dir).groupBy("category", "type").agg(F.count("*").alias("n_tokens")))


@query
def tok_restore(spark, sf_dir):
    z = _sanitized(spark, sf_dir)
    return tokens.restore(z.redacted, z.vault).select("session_id", "step_no", "text")


@query
def tok_resolve(spark, sf_dir):
    """Every token asked for by its own session, by another one, and one unknown token."""
    v = _vault(spark, sf_dir)
    own = v.select("session_id", "token", F.col("session_id").alias("caller_session"))
    foreign = v.select("session_id", "token", F.lit("src0").alias("caller_session"))
    unknown = v.select("session_id", F.concat("token", F.lit("x")).alias("token"),
                       F.col("session_id").alias("caller_session"))
    return tokens.resolve_tokens(own.unionByName(foreign).unionByName(unknown), v)


@query
def structure_check(spark, sf_dir):
    """Elements against a redaction that lost every seventh one and renamed some."""
    z = _sanitized(spark, sf_dir)
    damaged = z.redacted.where(F.col("step_no") % 7 != 0).withColumn(
        "element_id", F.when(F.col("step_no") % 5 == 1, F.concat("element_id", F.lit("x"))).otherwise(F.col("element_id")))
    return tokens.structure_check(z.elements, damaged)


@query
def vault_encryption(spark, sf_dir):
    """Values after encrypting and decrypting, and whether the stored form hides them."""
    key = F.lit("0123456789abcdef0123456789abcdef")
    v = _vault(spark, sf_dir)
    stored = tokens.encrypt_vault(v, key).withColumn("cipher", F.col("value"))
    back = tokens.decrypt_vault(stored, key)
    return back.select("session_id", "token", "value", F.contains("cipher", F.col("value")).alias("visible"))


@query
def vault_flags(spark, sf_dir):
    """Availability flags of a credential table derived from the events."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("event_type") == "view", "Email").when(F.col("event_id") % 90 == 0, "PAN")
        .when(F.col("event_type") == "click", "phone").otherwise("other").alias("field"),
        (F.col("user_id") % 4 == 0).alias("locked"))
    return tokens.availability(rows)


@query
def vault_fields(spark, sf_dir):
    return tokens.available_fields(_sanitized(spark, sf_dir).manifest)


@query
def vault_reset(spark, sf_dir):
    return tokens.reset_session(_vault(spark, sf_dir), "src0").groupBy("session_id").agg(
        F.count("*").alias("n_tokens"))


# --- proof and statistics --------------------------------------------------------

@query
def egress_report(spark, sf_dir):
    return _sanitized(spark, sf_dir).report


@query
def egress_raw(spark, sf_dir):
    """The proof against the unredacted documents: every finding has to show up."""
    e = document_elements(spark, sf_dir)
    return audit.egress_report(e, tokens.build_vault(privacy.scan(e)))


@query
def egress_cross_session(spark, sf_dir):
    e = document_elements(spark, sf_dir)
    return audit.leaks_across_sessions(e, materialize(tokens.build_vault(privacy.scan(e)))).drop("element_pos")


@query
def egress_split(spark, sf_dir):
    """Rows released and blocked when every third document skips redaction."""
    z = _sanitized(spark, sf_dir).staged()
    mixed = z.redacted.select("session_id", "step_no", "element_pos", "text").where(F.col("step_no") % 3 != 0)
    mixed = mixed.unionByName(z.elements.select("session_id", "step_no", "element_pos", "text")
                              .where(F.col("step_no") % 3 == 0))
    safe, blocked = audit.split_by_proof(mixed, audit.egress_report(mixed, z.vault))
    return (safe.select("session_id", F.lit("released").alias("outcome"))
            .unionByName(blocked.select("session_id", F.lit("blocked").alias("outcome")))
            .groupBy("session_id", "outcome").agg(F.count("*").alias("n_rows")))


@query
def telemetry_leaks(spark, sf_dir):
    """Session totals when every third document skips redaction."""
    z = _sanitized(spark, sf_dir).staged()
    columns = ["session_id", "step_no", "element_pos", "text"]
    mixed = z.redacted.select(*columns).where(F.col("step_no") % 3 != 0).unionByName(
        z.elements.select(*columns).where(F.col("step_no") % 3 == 0))
    return audit.telemetry(z.audit, audit.egress_report(mixed, z.vault))


@query
def extra_spans(spark, sf_dir):
    """The vault with spans of another detector: the first four characters of every second document as a name."""
    rows = documents(spark, sf_dir).where((F.col("doc_id") % 2 == 0) & (F.length("text") >= 4))
    extra = privacy.as_elements(rows, "source", "doc_id").select(
        "session_id", "step_no", "element_pos", "element_id", F.lit("text").alias("field"), F.lit("NAME").alias("type"), F.left("text", F.lit(4)).alias("value"),
        F.lit(0).alias("start"), F.lit(4).alias("end"), F.when(F.col("step_no") % 4 == 0, 1.5).otherwise(0.9).alias("confidence"), F.lit("NER").alias("method"))
    z = privacy.sanitize(document_elements(spark, sf_dir), extra)
    return z.vault.select("session_id", "token", "type", "value", "token_no", "first_step", "method", "confidence")


@query
def telemetry(spark, sf_dir):
    return _sanitized(spark, sf_dir).telemetry


@query
def pii_breakdown(spark, sf_dir):
    return audit.pii_breakdown(privacy.scan(document_elements(spark, sf_dir)))


@query
def input_breakdown(spark, sf_dir):
    e = inputs(spark, sf_dir)
    return audit.pii_breakdown(privacy.scan(e), e)


@query
def method_counts(spark, sf_dir):
    return audit.method_counts(privacy.scan(inputs(spark, sf_dir)))


@query
def masked_counts(spark, sf_dir):
    z = _sanitized(spark, sf_dir)
    return audit.tokens_so_far(audit.masked_counts(z.redacted, z.vault))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("call_no"),
        (F.col("event_id") % 7).alias("pii_tokens"), (F.col("event_id") % 3).alias("faces"),
        F.floor("value").alias("time_ms"))


@query
def session_stats(spark, sf_dir):
    out = audit.session_stats(_calls(spark, sf_dir))
    return out.withColumn("avg_time_ms", F.round("avg_time_ms", 6))


@query
def running_stats(spark, sf_dir):
    out = audit.running_stats(_calls(spark, sf_dir), segments.block_of(F.col("call_no")))
    return out.select("session_id", "call_no", "total_calls", "total_pii", F.round("avg_time_ms", 6).alias("avg_time_ms"))


@query
def audit_readout(spark, sf_dir):
    e = inputs(spark, sf_dir)
    return audit.audit_readout(tokens.audit_rows(tokens.build_vault(privacy.scan(e)), e))


# --- incremental -----------------------------------------------------------------

@query
def inc_diff(spark, sf_dir):
    return incremental.diff_snapshots(turns(spark, sf_dir)).select("session_id", "step_no", "element_id", "change")


@query
def inc_stats(spark, sf_dir):
    return incremental.diff_stats(incremental.diff_snapshots(turns(spark, sf_dir)))


@query
def inc_spans(spark, sf_dir):
    found = incremental.incremental_spans(turns(spark, sf_dir))
    return span_columns(found, "session_id", "step_no", "element_id")


# --- span algebra ------------------------------------------------------------------

@query
def spans_merge(spark, sf_dir):
    """Pattern spans of the documents merged with word spans from another detector."""
    base = materialize(span_rows(detect.scan_text(documents(spark, sf_dir)), "doc_id"))
    extra = base.select(
        "doc_id", "field", F.lit("NAME").alias("type"), F.col("value"),
        F.when(F.col("start") % 2 == 0, F.col("start") - 3).otherwise(F.col("end") + 5).alias("start"),
        F.when(F.col("start") % 2 == 0, F.col("start") + 1).otherwise(F.col("end") + 9).alias("end"),
        F.when(F.col("start") % 4 == 0, 1.5).otherwise(0.8).alias("confidence"), F.lit("NER").alias("method"))
    merged = spans.merge_span_tables(base, extra, ("doc_id", "field"))
    return span_columns(span_rows(merged, "doc_id"), "doc_id")


@query
def span_lines(spark, sf_dir):
    found = span_rows(detect.scan_text(documents(spark, sf_dir)), "doc_id").withColumnRenamed("doc_id", "image_id")
    placed = ocr.line_offsets(text_lines(spark, sf_dir)).select("image_id", "line_no", "line_start", "line_end")
    out = spans.spans_on_lines(found, placed)
    return out.select("image_id", "type", F.col("start").alias("start_pos"), "line_no", "line_start", "line_end")


# --- session and memory tables -------------------------------------------------------

@query
def mem_upsert(spark, sf_dir):
    return memory(spark, sf_dir).drop("ts", "seq")


@query
def mem_search(spark, sf_dir):
    return state_tables.search(memory(spark, sf_dir), "1_VIEW").drop("ts", "seq")


@query
def mem_delete(spark, sf_dir):
    m = memory(spark, sf_dir)
    return state_tables.delete_keys(m, m.where(F.col("seq") % 2 == 0)).select("key", "value")


@query
def mem_clear(spark, sf_dir):
    rest, removed = state_tables.clear_category(memory(spark, sf_dir), "goals")
    return rest.agg(F.count("*").alias("remaining")).join(removed)


@query
def mem_context(spark, sf_dir):
    return state_tables.session_context(memory(spark, sf_dir))


@query
def top_history(spark, sf_dir):
    return state_tables.history(memory(spark, sf_dir)).select("key", "value", "updated_at")


@query
def top_goals(spark, sf_dir):
    goals = memory(spark, sf_dir).where(F.col("category") == "goals")
    return state_tables.newest(goals, ("source_session_id",), 5).select("source_session_id", "key", "rank")


@query
def session_table(spark, sf_dir):
    return sessions(spark, sf_dir)


@query
def session_partial_update(spark, sf_dir):
    log = derived(spark, sf_dir, "events", synth.SESSION_LOG)
    return state_tables.partial_update(log, "session_id", ("ts", "seq"), ("goal", "plan_id"))


@query
def session_list(spark, sf_dir):
    return state_tables.list_sessions(sessions(spark, sf_dir))


@query
def session_restore(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id")).distinct()
    return state_tables.restore_session(sessions(spark, sf_dir), asked).select("session_id", "plan_id", "restored")


@query
def session_files(spark, sf_dir):
    """The session table written with its JSON columns and read back."""
    rows = sessions(spark, sf_dir).select(
        "session_id", "goal", "plan_id", F.array(F.lit(1), F.length("session_id")).alias("step_ids"),
        F.array().cast("array<int>").alias("completed_step_ids"),
        F.create_map(F.lit("lang"), "session_id").alias("user_preferences"),
        F.create_map().cast("map<string,string>").alias("extracted_entities"),
        "created_at", "updated_at", "archived")
    path = f"{checkpoint_dir(spark)}/sessions-{uuid.uuid4().hex}"
    snapshots.write_sessions(rows, path)
    back = snapshots.read_sessions(spark, path)
    return back.select("session_id", "goal", "plan_id", "step_ids", F.size("completed_step_ids").alias("n_completed"),
                       F.col("user_preferences")["lang"].alias("lang"), "archived")


@query
def memory_files(spark, sf_dir):
    """Memory snapshots written per session; one session read back from its folder."""
    m = memory(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/memory-{uuid.uuid4().hex}"
    snapshots.save_snapshot(m.select(F.col("source_session_id").alias("session_id"), "key", "value"), path)
    return snapshots.load_snapshot(spark, path, "7", "key string, value string")


# --- messages --------------------------------------------------------------------------

def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.parse_messages(derived(spark, sf_dir, "events", synth.MESSAGES))


@query
def msg_validate(spark, sf_dir):
    return _parsed(spark, sf_dir).select("event_id", "code")


@query
def msg_parse(spark, sf_dir):
    valid, _ = messages.split_valid(_parsed(spark, sf_dir))
    return valid


@query
def msg_dead_letters(spark, sf_dir):
    _, bad = messages.split_valid(_parsed(spark, sf_dir))
    return bad.groupBy("code").agg(F.count("*").alias("n_messages"))


@query
def msg_route(spark, sf_dir):
    valid, _ = messages.split_valid(_parsed(spark, sf_dir))
    return messages.route(valid).select("event_id", "session_id", "route")


@query
def goal_asof(spark, sf_dir):
    rows = derived(spark, sf_dir, "events", synth.GOALS)
    return messages.goal_for_plan(rows).drop("ts")


@query
def step_fold(spark, sf_dir):
    return finished_steps(spark, sf_dir)


@query
def step_state_counts(spark, sf_dir):
    return steps.state_counts(finished_steps(spark, sf_dir))


@query
def step_controls(spark, sf_dir):
    return steps.session_controls(step_events(spark, sf_dir))


@query
def plan_flags(spark, sf_dir):
    plans = step_events(spark, sf_dir).select("session_id").distinct()
    return steps.plan_flags(finished_steps(spark, sf_dir), plans)


@query
def step_lists(spark, sf_dir):
    done = finished_steps(spark, sf_dir)
    return (steps.completed_steps(done).select("session_id", "step_id", F.lit("completed").alias("list"))
            .unionByName(steps.steps_in(done, "FAILED").select("session_id", "step_id", F.lit("failed").alias("list")))
            .unionByName(steps.steps_in(done, "BLOCKED_APPROVAL")
                         .select("session_id", "step_id", F.lit("blocked").alias("list"))))


@query
def next_step(spark, sf_dir):
    """Next step of every session, counting steps without an event as pending."""
    events = step_events(spark, sf_dir)
    planned = events.select("session_id").distinct().withColumn("step_id", F.explode(F.sequence(F.lit(1), F.lit(8))))
    known = finished_steps(spark, sf_dir).select("session_id", "step_id", "state")
    rows = planned.join(known, ["session_id", "step_id"], "left").withColumn("state", F.coalesce("state", F.lit("PENDING")))
    return steps.next_executable(rows, steps.session_controls(events))


@query
def step_results(spark, sf_dir):
    """Failed results joined to their step, with the next state and the answer to send."""
    done = finished_steps(spark, sf_dir)
    results = step_events(spark, sf_dir).where(F.col("op").isin("success", "fail")).select(
        "session_id", "step_id", "seq", F.when(F.col("op") == "success", "success").otherwise("error").alias("status"),
        F.col("error_code").alias("code"), (F.col("seq") % 2 == 0).alias("screenshot"))
    joined = messages.join_results(results, done)
    code = F.coalesce("code", F.lit(""))
    return joined.select(
        "session_id", "step_id", "seq",
        steps.next_state(F.col("status"), code, F.col("attempts"), F.col("state")).alias("next_state"),
        messages.result_response(F.col("status") == "success", code, F.col("screenshot")).alias("response"))


@query
def risk_levels(spark, sf_dir):
    rows = plan_steps(spark, sf_dir).withColumn("level", risk_level())
    return rows.select("session_id", "step_id", "level", risk_reason().alias("reason"))


@query
def critical_steps(spark, sf_dir):
    rows = messages.classify(plan_steps(spark, sf_dir))
    return rows.groupBy("session_id").agg(
        F.bool_or(F.col("protocol_level") == "CRITICAL").alias("has_critical"),
        F.count_if(F.col("protocol_level") == "CRITICAL").alias("n_critical"))


@query
def plan_validate(spark, sf_dir):
    return plan_steps(spark, sf_dir).select("session_id", "step_id", messages.invalid_plan_reason().alias("reason"))


@query
def plan_start(spark, sf_dir):
    return messages.plan_start(messages.classify(plan_steps(spark, sf_dir)))


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step plans in both shapes: even orders flat, odd orders nested."""
    k = F.col("o_orderkey")
    flat_step = (k % 2) == 0
    text = F.concat(F.lit("item "), k.cast("string"))
    none = F.lit(None)
    def when(cond, value):
        return F.when(cond, value)
    xy = F.array((k % 100).cast("double"), (k % 50).cast("double"))
    target = F.struct(
        when(k % 3 == 0, F.concat(F.lit("#b"), k.cast("string"))).alias("selector"),
        none.cast("string").alias("url"), when(k % 3 == 1, xy).alias("coordinates"),
        when(k % 5 == 0, text).alias("text"), none.cast("int").alias("tab_id"),
        none.cast("string").alias("tab_purpose"))
    step = F.struct(
        when(~flat_step, (k % 9 + 1).cast("int")).alias("id"), when(flat_step, (k % 9 + 1).cast("int")).alias("step_id"),
        none.cast("int").alias("action_id"), F.lit("CLICK").alias("action"), when(~flat_step, target).alias("target"),
        when(flat_step & (k % 4 == 0), F.concat(F.lit("#f"), k.cast("string"))).alias("selector"),
        none.cast("string").alias("url"), when(flat_step & (k % 4 == 2), xy).alias("coordinates"),
        none.cast("string").alias("text"), none.cast("int").alias("tab_id"), none.cast("string").alias("tab_purpose"),
        none.cast("string").alias("value"), none.cast("string").alias("key"), none.cast("string").alias("vault_key"),
        none.cast("string").alias("execution_mode"),
        none.cast("string").alias("protocol_level"), when(flat_step, F.lit("CAUTION")).alias("risk_level"),
        none.cast("string").alias("riskLevel"), text.alias("description"),
        none.cast("struct<method:string,condition:string>").alias("verify"),
        none.cast("struct<action:string,reason:string>").alias("fallback"),
        F.lit(5000).alias("timeout_ms"), none.cast("int").alias("duration_ms"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array(step).alias("steps"))


@query
def step_normalize(spark, sf_dir):
    rows = messages.normalize_steps(_plans(spark, sf_dir))
    return rows.select("o_orderkey", "step_id", "target.selector", "target.coordinates", "target.text",
                       "execution_mode", "protocol_level", "description")


@query
def step_wire(spark, sf_dir):
    rows = messages.normalize_steps(_plans(spark, sf_dir))
    return rows.select("o_orderkey", messages.wire_steps(rows).alias("wire"))


@query
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", steps.backoff_ms(F.col("l_linenumber")).alias("backoff_ms"))


@query
def retry_schedule(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 12000).cast("int").alias("timeout_ms"))
    return steps.retry_schedule(rows)


@query
def debounce(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts", "event_id")
    return activity.settle_windows(rows, quiet_s=6 * 3600, cap_s=24 * 3600)


# --- pages ---------------------------------------------------------------------------------

def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


@query
def html_links(spark, sf_dir):
    return html.page_links(pages(spark, sf_dir))


@query
def html_elements(spark, sf_dir):
    return html.page_elements(pages(spark, sf_dir))


@query
def html_link_elements(spark, sf_dir):
    """Parsed links only: number per page and address, to compare with the pattern."""
    rows = html.page_elements(pages(spark, sf_dir)).where(F.col("tag") == "A")
    return rows.select("page_id", "id", "role", F.col("href"), "parent_tag")


def _pages_with_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as contact forms."""
    body = F.concat(
        F.lit('<div id="main"><form action="/save/'), (F.col("c_custkey") % 3).cast("string"),
        F.when(F.col("c_custkey") % 2 == 0, '" method="POST">').otherwise('">'), F.lit('<label for="n">Full name</label>'
              '<input id="n" name="name" value="'), F.col("c_name"),
        F.lit('"><label>Phone <input name="phone" placeholder="98xxx"></label><p>Seg<p>'
              '<select name="seg"><option>A<option selected>'), F.col("c_mktsegment"),
        F.lit('</select><input type="hidden" name="csrf" value="1"><input type="search" class="q big">'
              '<textarea name="note">n'), F.col("c_custkey").cast("string"),
        F.lit('</textarea><button style="display:none">x</button><button>Save</button></form></div>'))
    return spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("page_id"), F.lit("http://crm.example.com/").alias("url"), body.alias("html"))


@query
def form_elements(spark, sf_dir):
    return html.page_elements(_pages_with_forms(spark, sf_dir)).drop("interactive", "error")


@query
def html_forms(spark, sf_dir):
    return html.page_forms(_pages_with_forms(spark, sf_dir))


@query
def page_snapshots(spark, sf_dir):
    return html.page_snapshots(pages(spark, sf_dir)).select(
        "page_id", "url", "elements_count", "context_sufficient")


@query
def role_infer(spark, sf_dir):
    rows = inputs(spark, sf_dir)
    tag = F.when(F.col("element_pos") % 6 == 0, "A").when(F.col("element_pos") % 6 == 1, "SELECT").when(
        F.col("element_pos") % 6 == 2, "DIV").otherwise(F.col("tag"))
    given = F.when(F.col("element_pos") % 7 == 0, F.col("role"))
    return rows.select("element_id", html.infer_role(tag, F.col("type"), given).alias("role"),
                       snapshots.element_ids(F.col("type"), F.col("element_pos")).alias("assigned_id"))


@query
def screen_types(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", T.screen_type(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.col("url"), F.col("html")).alias("screen_type"))


def _page_elements_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('(?i)<a\\s+[^>]*?href="([^"]*)"'), F.lit(1))
    none = F.lit(None).cast("string")
    elements = F.transform(links, lambda h, i: F.struct(
        F.concat(F.lit("e_"), (i + 1).cast("string")).alias("id"), F.lit("A").alias("tag"),
        F.lit("link").alias("role"), h.alias("text"), none.alias("placeholder"), none.alias("selector"),
        none.alias("type"), F.lit(None).cast("array<double>").alias("rect")))
    return table(spark, sf_dir, "pages").select("page_id", "url", elements.alias("elements"))


@query
def prompt_lines(spark, sf_dir):
    return _page_elements_array(spark, sf_dir).select(
        "page_id", messages.element_lines(F.col("elements")).alias("lines"),
        snapshots.context_sufficient(F.col("elements")).alias("sufficient"))


@query
def goal_context(spark, sf_dir):
    vault = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("email"), F.lit(True), F.lit("card"), F.lit(False)))
    vault = F.coalesce(vault, F.create_map().cast("map<string,boolean>"))
    history = F.when(F.col("page_id") % 3 == 0, F.lit('[{"id": 1}]'))
    return _page_elements_array(spark, sf_dir).select("page_id", messages.goal_context(
        F.concat(F.lit("open page "), F.col("page_id").cast("string")), F.col("url"), F.col("elements"), vault,
        previous=history).alias("context"))


# --- targets ---------------------------------------------------------------------------------

def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as elements of a page per order, stacked in a column."""
    n = F.col("l_linenumber")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("session_id"), F.lit(0).cast("bigint").alias("step_no"),
        (pos - 1).alias("element_pos"), F.concat(F.lit("e_"), pos.cast("string")).alias("element_id"),
        F.lit("LI").alias("tag"), F.concat(F.lit("#line"), n.cast("string")).alias("selector"),
        F.concat(F.lit(" part "), F.col("l_partkey").cast("string"), F.lit(" ")).alias("text"),
        F.when(n % 2 == 0, F.col("l_returnflag")).alias("value"),
        F.array(F.lit(0.0), ((pos - 1) * 10).cast("double"), F.lit(100.0), F.lit(15.0)).alias("coordinates"))


def _aims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("session_id"), F.lit(0).cast("bigint").alias("step_no"), F.lit(1).alias("step_id"),
        F.when(k % 3 == 0, F.concat(F.lit("#line"), (k % 8).cast("string"))).alias("target_selector"),
        F.when(k % 3 != 2, "part 1").otherwise("").alias("target_text"),
        F.when(k % 2 == 0, 50.0).alias("target_x"), (k % 60).cast("double").alias("target_y"))


@query
def resolve_target(spark, sf_dir):
    out = targets.resolve_targets(_aims(spark, sf_dir), _boxed(spark, sf_dir))
    return out.select("session_id", "element_id", "matched_by",
                      targets.extracted(F.col("element_value"), F.col("element_text")).alias("data"))


@query
def verify_condition(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    checks = orders.select(
        k.cast("string").alias("session_id"), F.lit(0).cast("bigint").alias("step_no"), F.lit(1).alias("step_id"),
        F.when(k % 5 == 0, "URL_CHECK").when(k % 5 == 4, "SCREENSHOT").otherwise("DOM_CHECK").alias("method"),
        F.when(k % 5 == 0, F.when(k % 2 == 0, "http://shop").otherwise("http://other"))
        .when(k % 5 == 1, F.concat(F.lit("exists:#line"), (k % 8).cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("text:part "), (k % 10).cast("string")))
        .otherwise("always_true").alias("condition"))
    pages_ = orders.select(k.cast("string").alias("session_id"), F.lit(0).cast("bigint").alias("step_no"),
                           F.lit("http://shop.example.com/").alias("url"))
    return targets.verify_steps(checks, pages_, _boxed(spark, sf_dir)).select("session_id", "checked", "passed")


# --- named entities ----------------------------------------------------------------------------

@query
def ner_chunks(spark, sf_dir):
    return ner.chunk_text(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def ner_merge(spark, sf_dir):
    return ner.merge_token_lists(entity_tokens(spark, sf_dir)).select(
        "doc_id", "chunk_no", "entity_no", "word", "entity", "score", F.col("start").alias("start_pos"),
        F.col("end").alias("end_pos"), "n_tokens")


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = entity_tokens(spark, sf_dir)
    area = F.when(F.col("doc_id") % 4 == 0, "profile-card").when(F.col("doc_id") % 4 == 1, "main nav").when(
        F.col("doc_id") % 4 == 2, "company_info").otherwise("")
    return ner.merge_token_lists(chunks.withColumn("context", ner.context_words(area, F.lit(None).cast("string"), F.lit("DIV"), F.lit(""))))


@query
def ner_context(spark, sf_dir):
    return _context(spark, sf_dir).groupBy("doc_id").agg(F.max(F.array_join(F.array_sort("context"), ",")).alias("words"))


@query
def ner_filter(spark, sf_dir):
    rows = _context(spark, sf_dir)
    kept = rows.where(ner.keep_entity(F.col("word"), F.col("entity"), F.col("score"), F.col("context")))
    return ner.as_spans(kept, F.col("chunk_no") * 3).select(
        "doc_id", "chunk_no", "entity_no", "type", "value", F.col("start").alias("start_pos"),
        F.col("end").alias("end_pos"), "confidence", "method", "ner_label")


@query
def ner_dedupe(spark, sf_dir):
    # Texts are dealt by document, so the line of a document's spans is sorted where it lies and no span is shuffled.
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = ner.as_spans(ner.merge_token_lists(token_lists(docs)))
    # The same entity again, seen by a neighbouring chunk with other edges.
    seen = F.struct("start", "end", "confidence")
    again = F.struct((F.col("start") + 1).alias("start"), (F.col("end") + 3).alias("end"),
                     F.when(F.col("start") % 3 == 0, 0.99).otherwise(0.5).alias("confidence"))
    both = rows.select("doc_id", "type", "value", F.explode(F.array(seen, again)).alias("s")).select("doc_id", "type", "value", "s.*")
    out = ner.dedupe_spans(both, dealt=True)
    return out.select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "type", "value", "confidence")


# --- images --------------------------------------------------------------------------------------

@query
def ocr_lines(spark, sf_dir):
    return ocr.line_offsets(text_lines(spark, sf_dir)).select("image_id", "line_no", "line_start", "line_end")


@query
def ocr_words(spark, sf_dir):
    words = ocr.usable_words(text_words(text_lines(spark, sf_dir)))
    return words.groupBy("image_id").agg(F.count("*").alias("n_words"), F.sum("w").alias("width"))


@query
def ocr_regions(spark, sf_dir):
    lines = text_lines(spark, sf_dir)
    found = span_rows(detect.scan_text(documents(spark, sf_dir)), "doc_id").withColumnRenamed("doc_id", "image_id")
    out = ocr.pii_regions(found, lines, ocr.usable_words(text_words(lines)))
    return out.select("image_id", F.col("start").alias("start_pos"), "type", "x", "y", "w", "h")


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised face outputs made of embedding values, on 1280 by 720 images."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.abs(v[0]).alias("top"), F.abs(v[1]).alias("left"),
        (F.abs(v[0]) + F.abs(v[2])).alias("bottom"), (F.abs(v[1]) + F.abs(v[3])).alias("right"))


def _face_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.face_from_output(F.col("top"), F.col("left"), F.col("bottom"), F.col("right"), F.lit(1280), F.lit(720))
    return _faces(spark, sf_dir).withColumn("b", found).where(F.col("b").isNotNull()).select("image_id", "b.*")


@query
def face_boxes(spark, sf_dir):
    rows = _face_boxes(spark, sf_dir)
    padded = G.face_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1280), F.lit(720))
    return rows.select("image_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")], padded.alias("p")).select(
        "image_id", "x", "y", "w", "h", *[F.col(f"p.{c}").cast("bigint").alias(f"pad_{c}") for c in ("x", "y", "w", "h")])


@query
def text_boxes(spark, sf_dir):
    lines = text_lines(spark, sf_dir)
    padded = G.text_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1280), F.lit(720))
    return lines.select("image_id", "line_no", padded.alias("p")).select(
        "image_id", "line_no", *[F.col(f"p.{c}").cast("bigint").alias(c) for c in ("x", "y", "w", "h")])


@query
def merged_boxes(spark, sf_dir):
    return (text_lines(spark, sf_dir).groupBy("image_id")
            .agg(G.merged_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("b"))
            .select("image_id", "b.*"))


@query
def reading_regions(spark, sf_dir):
    faces = _face_boxes(spark, sf_dir)
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("auth_card", "banner", "form_area", "profile_section")]),
                         (F.col("image_id") % 4 + 1).cast("int"))
    regions = faces.select("image_id", kinds.alias("type"), "x", "y", "w", "h")
    screens = faces.select("image_id", (F.col("image_id") % 10 == 0).alias("canvas_heavy"))
    out = ocr.reading_regions(faces, regions, screens)
    return out.select("image_id", "label", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


@query
def reading_needed(spark, sf_dir):
    n = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        n.alias("image_id"), ocr.needs_reading(n % 2 == 0, n % 5 == 0, F.when(n % 3 == 0, n % 6 == 0), n % 7).alias("needed"))


@query
def all_regions(spark, sf_dir):
    """Boxes to cover: faces, and redacted form inputs with a complete box."""
    e = inputs(spark, sf_dir).withColumn("coordinates", F.when(
        F.col("element_pos") % 5 != 0, F.array(*[F.lit(float(v)) for v in (1, 2, 30, 10)])).otherwise(
        F.array(F.lit(1.0), F.lit(2.0))))
    z = privacy.sanitize(e)
    found = ocr.element_regions(z.redacted).select(F.col("element_id").alias("image_id"), "label", "x", "y", "w", "h")
    faces = _face_boxes(spark, sf_dir).withColumn("image_id", F.col("image_id").cast("string"))
    out = ocr.all_regions(found, faces, ("image_id",))
    return out.select("image_id", "type", "label", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


@query
def softmax_argmax(spark, sf_dir):
    p = G.softmax(F.col("embedding"))
    return (table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))
            .select("vec_id", G.argmax(F.col("p")).alias("predicted_class"),
                    F.round(F.array_max("p"), 6).alias("confidence")))


# --- model text ------------------------------------------------------------------------------------

def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, b, c, d = [(k * m % 1001).cast("string") for m in (3, 7, 11, 13)]
    nums = F.concat_ws(", ", a, b, c, d)
    text = (F.when(k % 6 == 0, F.concat(F.lit("at <|box_start|>("), nums, F.lit(")<|box_end|> ok")))
            .when(k % 6 == 1, F.concat(F.lit("box ["), nums, F.lit("]")))
            .when(k % 6 == 2, F.concat(F.lit("box ("), nums, F.lit(")")))
            .when(k % 6 == 3, F.concat(F.lit('{"point": ['), a, F.lit(", "), b, F.lit("]}")))
            .when(k % 6 == 4, F.concat(F.lit('{"bbox": ['), F.concat_ws(".5, ", a, b, c, d), F.lit("]}")))
            .otherwise("nothing there"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("answer"))


@query
def ground_parse(spark, sf_dir):
    got = P.grounding(F.col("answer"), F.lit(1280), F.lit(720))
    return _answers(spark, sf_dir).select("o_orderkey", got.alias("g")).select("o_orderkey", "g.*")


def _model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = k.cast("string")
    text = (F.when(k % 7 == 0, F.concat(F.lit('<think>hm {"a": 0}</think>\n```json\n{"id": '), s, F.lit("}\n```")))
            .when(k % 7 == 1, F.concat(F.lit('Sure! {"id": '), s, F.lit(', "x": [1, 2,],} done')))
            .when(k % 7 == 2, F.concat(F.lit('{"id": '), s, F.lit(' // the order\n}')))
            .when(k % 7 == 3, F.concat(F.lit('{"steps": [{"id": '), s, F.lit('} {"id": 2}]}')))
            .when(k % 7 == 4, F.concat(F.lit('{"id": '), s, F.lit(", broken")))
            .when(k % 7 == 5, F.concat(F.lit('{"note": "a\tb", "id": '), s, F.lit("}")))
            .otherwise(F.concat(F.lit("<think>never closed {"), s, F.lit("}"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("raw"))


@query
def json_clean(spark, sf_dir):
    return _model_text(spark, sf_dir).select("o_orderkey", P.clean_model_text(F.col("raw")).alias("clean"))


@query
def json_repair(spark, sf_dir):
    clean = P.clean_model_text(F.col("raw"))
    return _model_text(spark, sf_dir).select("o_orderkey", P.repair_json(clean).alias("repaired"),
                                             P.parsed_model_json(F.col("raw")).isNotNull().alias("parses"))


@query
def vision_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    box = F.concat((k % 500).cast("string"), F.lit(", "), (k % 300).cast("string"), F.lit(", "), (k % 500 + 100).cast("string"), F.lit(", "), (k % 300 + 50).cast("string"))
    text = (F.when(k % 3 == 0, F.concat(F.lit('ok {"screen_type": "s'), k.cast("string"), F.lit('", "confidence": 0.5, "layout": {"canvas_heavy": true}, "detected_regions": '
                                        '[{"type": "header", "label": "h", "bbox_1000": ['), box, F.lit(']}, {"bbox": [1, 2]}]}')))
            .when(k % 3 == 1, F.lit('{"confidence": 0.25}')).otherwise("no json"))
    got = P.vision_answer(F.col("t"), F.lit(1280), F.lit(720))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", got.alias("g")).select("o_orderkey", "g.*")
    first = F.get("detected_regions", F.lit(0))
    return rows.select("o_orderkey", "screen_type", "confidence", "visual_density", "has_active_modal", "has_sticky_footer", "canvas_heavy",
                       F.size(F.coalesce("detected_regions", F.array())).cast("long").alias("n_regions"), first["type"].alias("region_type"),
                       *[first["bbox"][i].cast("long").alias(n) for i, n in enumerate(("x", "y", "w", "h"))])


@query
def obstacle_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    text = (F.when(k % 3 == 0, F.concat(F.lit('{"has_obstacle": true, "obstacle_type": "cookie_banner", "dismiss_button_coords": ['), (k % 1000).cast("string"), F.lit(", 10, 500, 20]}")))
            .when(k % 3 == 1, F.lit('{"confidence": 0.25}')).otherwise("no json"))
    got = P.obstacle_answer(F.col("t"), F.lit(1280), F.lit(720))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", got.alias("g")).select("o_orderkey", "g.*")


@query
def verify_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    text = (F.when(k % 3 == 0, F.lit('{"verified": false, "confidence": 0.5, "reasoning": "r"}'))
            .when(k % 3 == 1, F.lit('{"change_detected": false}')).otherwise(F.concat(F.lit("no json "), F.repeat(k.cast("string"), F.lit(60)))))
    got = P.verify_answer(F.col("t"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", got.alias("g")).select("o_orderkey", "g.*")


@query
def image_decode(spark, sf_dir):
    data = F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("c_name").cast("binary")))
    return table(spark, sf_dir, "customer").select("c_custkey", P.image_bytes(data).cast("string").alias("body"))


@query
def image_source(spark, sf_dir):
    """Image files, one per nation of the customers and sized by them, read back as binary files."""
    from cloakframe.sources.images import read_images

    path = f"{checkpoint_dir(spark)}/images-{uuid.uuid4().hex}"
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        (F.count("*") % 120 + 1).alias("low"), (F.max("c_custkey") % 120 + 1).alias("high"))
    one = lambda c: F.char(F.col(c) if isinstance(c, str) else c)
    data = F.concat(F.lit("GIF89a"), one("low"), one(F.col("nation") % 100 + 1), one("high"), one(F.col("nation") % 50 + 1))
    sizes.select("nation", data.alias("value")).repartition("nation").write.partitionBy("nation").text(path)
    return read_images(spark, path).select("nation", "format", "width", "height", "length")


@query
def epoch_time(spark, sf_dir):
    seconds = F.unix_seconds("ts")
    return table(spark, sf_dir, "events").select("event_id", seconds.alias("epoch"), snapshots.iso_time(seconds).alias("iso"))


@query
def json_columns(spark, sf_dir):
    got = F.from_json("props", "map<string,bigint>")
    return table(spark, sf_dir, "events").select("event_id", got["k"].alias("k"), F.to_json(got).alias("again"))


@query
def map_merge(spark, sf_dir):
    base = F.create_map(F.lit("k"), F.lit("old"), F.lit("id"), F.col("event_id").cast("string"))
    later = F.create_map(F.lit("k"), F.col("event_type"))
    merged = snapshots.merge_maps(base, later)
    return table(spark, sf_dir, "events").select("event_id", merged["k"].alias("k"), merged["id"].alias("id"), F.size(merged).alias("n"))


# --- streams -----------------------------------------------------------------------------------------

def _stream_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


_FILES = 4  # files of a batch


def _in_batches(df: DataFrame, batch: Column, n: int, root: str) -> DataFrame:
    """A stream that brings the rows of ``df`` in ``n`` batches, one after the other."""
    spark = df.sparkSession
    numbered = df.withColumn("_batch", batch)  # computed for each batch: reading the table again costs no storage
    for i in range(n):
        part = numbered.where(F.col("_batch") == i).drop("_batch")
        part.repartition(_FILES).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", _FILES).parquet(f"{root}/in")


def _thirds(df: DataFrame, column: str) -> Column:
    """0, 1 or 2 by where a number lies between the least and the greatest of its column."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return F.least(F.floor((F.col(column) - (low or 0)) * 3 / F.lit(max(1, (high or 0) - (low or 0) + 1))), F.lit(2))


def _stateful(spark: SparkSession) -> None:
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _played(df: DataFrame, root: str) -> DataFrame:
    """The output of a stream that runs until its input is used up."""
    query_ = (df.writeStream.format("parquet").option("path", f"{root}/out")
              .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query_.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/out")


@query
def stream_redact(spark, sf_dir):
    """Documents through the redaction stream in three batches: what it released."""
    from cloakframe.streaming.redaction import RedactionStream

    root = _stream_folder(spark)
    flow = RedactionStream(f"{root}/state")
    # The batches are dealt to files anyway, so the scan is not spread before that.
    elements = privacy.as_elements(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "source", "doc_id")
    stream = _in_batches(elements, _thirds(elements, "step_no"), 3, root)
    flow.writer(stream, f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return flow.released(spark).select("session_id", "step_no", "text")


def _turn_stream(spark: SparkSession, sf_dir: str):
    """Turns in four batches of two steps; every fourth conversation is reset at its step 3, in the middle of a batch."""
    from cloakframe.streaming.redaction import RedactionStream

    root = _stream_folder(spark)
    rows = turns(spark, sf_dir).withColumn("control", F.lit(None).cast("string"))
    ids = rows.select("session_id").distinct().where(F.col("session_id").cast("long") % 4 == 0)
    resets = ids.select("session_id", F.lit(3).cast("long").alias("step_no"), F.lit("reset").alias("control"))
    rows = rows.unionByName(resets, allowMissingColumns=True)
    flow = RedactionStream(f"{root}/state", compact_every=2)
    stream = _in_batches(rows, F.least(F.floor(F.col("step_no") / 2), F.lit(3)), 4, root)
    flow.writer(stream, f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return flow


@query
def stream_turns(spark, sf_dir):
    """Conversations through the redaction stream, with cached spans, resets and compaction between batches."""
    return _turn_stream(spark, sf_dir).released(spark).select("session_id", "step_no", "element_id", "element_pos", "text")


@query
def stream_scans(spark, sf_dir):
    """What that stream scanned: the new and modified elements of each snapshot, and no others."""
    return _turn_stream(spark, sf_dir).scans(spark).select("session_id", "step_no", "total", "new", "modified", "unchanged", "scanned")


@query
def stream_vault(spark, sf_dir):
    """The vault of the sessions' present epochs, read back over a compacted base and later batches."""
    return _turn_stream(spark, sf_dir).vault(spark).select("session_id", "token", "type", "value", "token_no", "first_step")


def _live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step events of which some close their session."""
    raw = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events = raw.selectExpr(*synth.select_list(synth.STEP_EVENTS)).select("session_id", "step_id", "ts", "seq", "op")
    return events.withColumn("op", F.when(F.expr(synth.CLOSES), "close").otherwise(F.col("op")))


def _step_outcomes(spark: SparkSession, sf_dir: str, idle_ms: int | None) -> DataFrame:
    from cloakframe.streaming.steps import track_steps

    _stateful(spark)
    root = _stream_folder(spark)
    events = _live_events(spark, sf_dir)
    moment = events.withColumn("_at", F.unix_seconds("ts"))
    stream = _in_batches(moment, _thirds(moment, "_at"), 3, root).drop("_at")
    out = _played(track_steps(stream, idle_ms=idle_ms), root)
    return out.where("step_id IS NOT NULL").select("session_id", "step_id", "seq", "op", "state", "attempts", "accepted", "code")


@query
def stream_steps(spark, sf_dir):
    """Step events, some of which close their session, through the stateful stream: the outcome of every event."""
    return _step_outcomes(spark, sf_dir, None)


@query
def stream_cleanup(spark, sf_dir):
    """The same with sessions dropped when nothing comes for a day: their steps start over."""
    return _step_outcomes(spark, sf_dir, 24 * 3600 * 1000)


@query
def stream_debounce(spark, sf_dir):
    """Bursts of the event stream, closed by a quiet period and cut at a limit; a last event far ahead settles them all."""
    from cloakframe.streaming.messages import settled_bursts

    _stateful(spark)
    root = _stream_folder(spark)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts")
    rows = rows.withColumn("_at", F.unix_seconds("ts"))
    batch = _thirds(rows, "_at")
    last = rows.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select(
        F.lit("\u0001end").alias("session_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(None).cast("long").alias("_at"))
    rows = rows.unionByName(last).unionByName(last).unionByName(last).unionByName(last)
    stream = _in_batches(rows, F.when(F.col("_at").isNull(), 3).otherwise(batch), 4, root).drop("_at")
    out = _played(settled_bursts(stream, 6 * 3600, 24 * 3600, "1 hour"), root)
    return out.where(F.col("session_id") != "\u0001end").select("session_id", "burst", "piece", "started_at", "last_event_at", "n_events")


# --- extension points ----------------------------------------------------------------------------


@query
def sql_functions(spark, sf_dir):
    """The registered SQL functions, called from SQL."""
    sqlfuncs.register(spark)
    plan_steps(spark, sf_dir).createOrReplaceTempView("_plan_steps")
    return spark.sql("""
        SELECT session_id, step_id, risk_level(action, description) AS level,
               pii_category(CASE step_id % 3 WHEN 0 THEN 'CARD' WHEN 1 THEN 'EMAIL' ELSE 'NAME' END) AS category,
               token_type(concat('[', action, '_', step_id, ']')) AS kind,
               luhn_valid(concat('411111111111111', step_id)) AS luhn
        FROM _plan_steps""")


@query
def custom_detector(spark, sf_dir):
    """A detector of the user's own over the documents: long hex values."""
    own = detect.Detector(1, "HEX", "[0-9A-Fa-f]{32,}")
    found = detect.scan_fields(documents(spark, sf_dir), ("text",), detectors=(own,))
    return found.select("doc_id", F.size("spans").cast("long").alias("n"), F.get("spans", F.lit(0))["start"].cast("long").alias("first_start"),
                        F.get("spans", F.lit(0))["value"].alias("first_value")).where("n > 0")


@query
def snapshot_source(spark, sf_dir):
    """Snapshots written as JSON and read back by the source, then exploded to elements."""
    rows = turns(spark, sf_dir).groupBy("session_id", "step_no").agg(
        F.sort_array(F.collect_list(F.struct("element_pos", F.col("element_id").alias("id"), "text"))).alias("elements"))
    path = f"{checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    rows.write.json(path)
    back = snapshots.read_snapshots(spark, path, lines=True)
    return snapshots.explode_elements(back).select("session_id", "step_no", "element_id", "text")


@query
def snapshot_stream(spark, sf_dir):
    """The same snapshots read as a stream, in three batches of files."""
    rows = turns(spark, sf_dir).groupBy("session_id", "step_no").agg(
        F.sort_array(F.collect_list(F.struct("element_pos", F.col("element_id").alias("id"), "text"))).alias("elements"))
    root = _stream_folder(spark)
    rows.repartition(12).write.json(f"{root}/in")
    stream = snapshots.stream_snapshots(spark, f"{root}/in", files_per_batch=4)
    return _played(snapshots.explode_elements(stream).select("session_id", "step_no", "element_id", "text"), root)
