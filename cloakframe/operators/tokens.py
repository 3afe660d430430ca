"""Tokens, the vault, redaction and restoring.

A value gets one token per session, numbered per type in first-seen order.
``spans`` below is the materialized span table: the scan is by far the most
expensive step, so it runs once and everything here reads its small result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import constants as K
from cloakframe.functions.sqltext import SOH, STX, quoted
from cloakframe.functions.text import severity, token_type
from cloakframe.operators.segments import GROUP_LIMIT, number_rows
from cloakframe.operators.spans import ELEMENT_KEY
from cloakframe.session import materialize

_FIRST_SEEN = ("step_no", "element_pos", "neg_length", "start", "field_ord", "span_ord")
REDACTED_FIELDS = ("text", "value", "placeholder", "href")


def secret_spans(spans: DataFrame) -> DataFrame:
    """Spans that carry a real value (hidden and empty ones get no token)."""
    return spans.where((F.col("value") != "") & (F.col("value") != K.HIDDEN_VALUE))


def build_vault(spans: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The session vault: one row per distinct value with its token.

    The first span of a value, in page order and longest first, fixes its type.
    Values are reduced to their first span with a hash aggregate, so repeated
    values never travel; numbering handles sessions of any size.
    """
    ranked = secret_spans(spans).withColumn("neg_length", -F.length("value"))
    first = F.min(F.struct(*_FIRST_SEEN, "type", "method", "confidence", "element_id"))
    firsts = materialize(ranked.groupBy("session_id", "value").agg(first.alias("f"))
                         .select("session_id", "value", "f.*"))
    numbered = number_rows(firsts, ["session_id", "type"],
                           [F.col(c) for c in (*_FIRST_SEEN, "value")], "token_no", group_limit)
    return (numbered
            .withColumn("token", F.format_string("[%s_%d]", "type", "token_no"))
            .withColumn("category", severity(F.col("type")))
            .withColumnRenamed("step_no", "first_step")
            .select("session_id", "token", "type", "value", "token_no", "category", "method",
                    "confidence", "first_step", "element_pos", "element_id"))


def password_element(df: DataFrame) -> Column:
    """Password inputs, also those known by their autocomplete attribute only."""
    hit = F.lit(False)
    if "type" in df.columns:
        hit = hit | (F.coalesce("type", F.lit("")) == "password")
    if "autocomplete" in df.columns:
        hit = hit | F.contains(F.coalesce("autocomplete", F.lit("")), F.lit("password"))
    return hit


def element_pairs(spans: DataFrame, vault: DataFrame) -> DataFrame:
    """Per element the (value, token, type) pairs to replace, longest value first."""
    tokens = vault.select("session_id", "value", "token")
    # SQL: an array of structs sorts by its leading fields
    pair = F.struct((-F.length("value")).alias("neg_length"), "start", "field_ord", "span_ord",
                    "value", "token", "type")
    return (secret_spans(spans).join(tokens, ["session_id", "value"])
            .groupBy(*ELEMENT_KEY).agg(F.array_sort(F.collect_list(pair)).alias("pairs")))


def _replace(field: str) -> str:
    """Replace all pairs in one field, literally, noting which ones occurred."""
    return f"""aggregate(pairs,
        named_struct('body', `{field}`, 'tokens', cast(array() AS array<string>),
                     'types', cast(array() AS array<string>)),
        (a, p) -> if(contains(a.body, p.value),
            named_struct('body', replace(a.body, p.value, p.token),
                         'tokens', concat(a.tokens, array(p.token)),
                         'types', concat(a.types, array(p.type))), a))"""


def redact(elements: DataFrame, spans: DataFrame, vault: DataFrame) -> DataFrame:
    """Elements with every value replaced by its token.

    Adds ``is_redacted``, ``redacted_types`` and ``redacted_tokens``; row count,
    keys and all columns that hold no text are left as they were.
    """
    columns = elements.columns
    fields = [f for f in REDACTED_FIELDS if f in columns]
    out = elements.join(element_pairs(spans, vault), list(ELEMENT_KEY), "left")
    out = out.withColumn("_password", password_element(elements))
    for field in fields:
        out = out.withColumn(f"_r_{field}", F.when(F.col("pairs").isNotNull(), F.expr(_replace(field))))
    gathered = {
        what: "array_distinct(concat(" + ", ".join(
            [f"coalesce(_r_{f}.{what}, array())" for f in fields]
            + [f"if(_password, array({quoted(extra)}), array())"]) + "))"
        for what, extra in (("types", "PASSWORD_FIELD"), ("tokens", K.PASSWORD_TOKEN))}
    out = (out.withColumn("redacted_types", F.expr(gathered["types"]))
           .withColumn("redacted_tokens", F.expr(gathered["tokens"])))
    shown = []
    for name in columns:
        if name not in fields:
            shown.append(F.col(name))
            continue
        body = F.coalesce(F.col(f"_r_{name}.body"), F.col(name))
        if name in ("text", "value"):
            body = F.when(F.col("_password"), K.PASSWORD_TOKEN).otherwise(body)
        shown.append(body.alias(name))
    return out.select(*shown, (F.size("redacted_tokens") > 0).alias("is_redacted"),
                      "redacted_types", "redacted_tokens")


def structure_check(raw: DataFrame, redacted: DataFrame) -> DataFrame:
    """Count elements whose key or non-text columns differ after redaction."""
    kept = [c for c in raw.columns if c not in REDACTED_FIELDS and c not in ELEMENT_KEY]
    left = raw.select(*ELEMENT_KEY, F.struct(*kept).alias("a") if kept else F.lit(1).alias("a"),
                      F.lit(1).alias("in_raw"))
    right = redacted.select(*ELEMENT_KEY, F.struct(*kept).alias("b") if kept else F.lit(1).alias("b"),
                            F.lit(1).alias("in_redacted"))
    both = left.join(right, list(ELEMENT_KEY), "full_outer")
    return both.agg(
        F.count("in_raw").alias("n_raw"), F.count("in_redacted").alias("n_redacted"),
        F.count_if(F.col("in_raw").isNull() | F.col("in_redacted").isNull()).alias("n_unmatched"),
        F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed"))


def manifest_elements(redacted: DataFrame) -> DataFrame:
    """Summary rows of the redacted elements."""
    extra = [c for c in ("element_id", "tag", "selector") if c in redacted.columns]
    return (redacted.where("is_redacted")
            .select(*ELEMENT_KEY, *extra, F.col("redacted_types").alias("types"),
                    F.col("redacted_tokens").alias("tokens")))


def manifest_tokens(redacted: DataFrame, vault: DataFrame) -> DataFrame:
    """Tokens in use per session with their types: vault tokens and element tokens."""
    placed = (redacted.select("session_id", F.explode_outer("redacted_tokens").alias("token"))
              .where(F.col("token").isNotNull())
              .groupBy("session_id", "token").agg(F.count("*").alias("n_elements")))
    known = vault.select("session_id", "token").distinct()
    return (known.join(placed, ["session_id", "token"], "full_outer")
            .select("session_id", "token", token_type(F.col("token")).alias("token_type"),
                    F.coalesce("n_elements", F.lit(0)).alias("n_elements")))


def snapshot_manifest(redacted: DataFrame) -> DataFrame:
    """Per snapshot: the tokens it uses, how many, and their types as a map."""
    rows = (redacted.select("session_id", "step_no", F.explode_outer("redacted_tokens").alias("token"))
            .where(F.col("token").isNotNull()).distinct())
    return (rows.groupBy("session_id", "step_no")
            .agg(F.sort_array(F.collect_set("token")).alias("tokens_used"))
            .withColumn("total_tokens", F.size("tokens_used"))
            .withColumn("token_types", F.map_from_arrays(
                "tokens_used", F.transform("tokens_used", token_type))))


def audit_rows(vault: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """One row per new token, and one per overwritten password element."""
    new = vault.select("session_id", F.col("first_step").alias("step_no"), "element_id", "token",
                       "type", "method", "confidence", "category")
    if elements is None:
        return new
    passwords = elements.where(password_element(elements)).select(
        "session_id", "step_no", "element_id", F.lit(K.PASSWORD_TOKEN).alias("token"),
        F.lit("PASSWORD_FIELD").alias("type"), F.lit("DOM_ATTRIBUTE").alias("method"),
        F.lit(1.0).alias("confidence"), F.lit("SPII").alias("category"))
    return new.unionByName(passwords)


def resolve_tokens(requests: DataFrame, vault: DataFrame) -> DataFrame:
    """Look up tokens inside the requester's own session only.

    ``requests`` has ``session_id`` (whose vault is asked for), ``token`` and
    optionally ``caller_session``; a foreign caller is rejected, an unknown
    token stays unresolved.
    """
    known = vault.select("session_id", "token", F.col("value").alias("_value"))
    out = requests.join(known, ["session_id", "token"], "left")
    allowed = (F.col("caller_session") == F.col("session_id")
               if "caller_session" in requests.columns else F.lit(True))
    return out.select(
        *requests.columns,
        F.when(allowed, F.col("_value")).alias("value"),
        F.when(~F.coalesce(allowed, F.lit(False)), "rejected").when(F.col("_value").isNull(), "not_found")
        .otherwise("resolved").alias("status"))


def restore(texts: DataFrame, vault: DataFrame, text: str = "text",
            key: tuple[str, ...] = ELEMENT_KEY) -> DataFrame:
    """Put the values back: every token of the row's session, in one literal pass.

    Only tokens that occur in a text are looked up, with an equi-join on
    (session, token); no session's vault is ever gathered in one place.
    """
    pattern = r"\[[A-Z_]+_[0-9]+\]"
    wanted = (texts.select(*key, F.explode_outer(F.array_distinct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("token"))
        .where(F.col("token").isNotNull())
        .join(vault.select("session_id", "token", "value"), ["session_id", "token"])
        .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_m")))
    # Fence the tokens, cut there, swap the tokens and glue the parts together.
    # Control characters of the text itself are escaped while it is cut.
    escaped = rf"replace(replace(`{text}`, {STX}, '\u0002b'), {SOH}, '\u0002a')"
    unescaped = rf"replace(replace(p, '\u0002a', {SOH}), '\u0002b', {STX})"
    cut = rf"split(regexp_replace({escaped}, r'{pattern}', '\u0001$0\u0001'), {SOH})"
    glued = f"array_join(transform({cut}, p -> coalesce(_m[p], {unescaped})), '')"
    return (texts.join(wanted, list(key), "left")
            .withColumn(text, F.when(F.col("_m").isNull(), F.col(text)).otherwise(F.expr(glued)))
            .drop("_m"))


def encrypt_vault(vault: DataFrame, key: Column) -> DataFrame:
    """Replace values by AES-GCM ciphertext (base64, random IV per value)."""
    return vault.withColumn("value", F.base64(F.aes_encrypt("value", key, F.lit("GCM"))))


def decrypt_vault(vault: DataFrame, key: Column) -> DataFrame:
    plain = F.aes_decrypt(F.unbase64("value"), key, F.lit("GCM"))
    return vault.withColumn("value", plain.cast("string"))


def availability(credentials: DataFrame) -> DataFrame:
    """Six ``has_*`` flags per session from (session_id, field, locked); none if locked."""
    lowered = F.lower("field")
    flags = [(F.coalesce(F.bool_or(lowered == name), F.lit(False)) & ~F.coalesce(
        F.bool_or("locked"), F.lit(False))).alias(f"has_{name}") for name in K.VAULT_FLAGS]
    return credentials.groupBy("session_id").agg(
        *flags, F.coalesce(F.bool_or("locked"), F.lit(False)).alias("locked"))


def available_fields(manifest: DataFrame) -> DataFrame:
    """Fields a token manifest makes available, one row per session and field."""
    return manifest.select(
        "session_id", F.lower(F.coalesce("token_type", F.lit("unknown"))).alias("field"),
        F.lit(True).alias("available")).distinct()


def reset_session(table: DataFrame, session_id: str) -> DataFrame:
    """A vault, audit or span table without one session."""
    return table.where(F.col("session_id") != session_id)
