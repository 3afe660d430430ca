"""Scalar text functions used across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions import constants as K
from cloakframe.functions.patterns import SPACE
from cloakframe.functions.sqltext import in_list


def filled(col: Column) -> Column:
    """Treat an empty string as absent."""
    return F.when(col != "", col)


def first_filled(*cols: Column, default: str = "") -> Column:
    return F.coalesce(*[filled(c) for c in cols], F.lit(default))


def trim_spaces(col: Column) -> Column:
    return F.regexp_replace(col, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def normalize_label(col: Column) -> Column:
    """Lower-case a label and drop everything but letters, digits and spaces."""
    kept = F.regexp_replace(F.lower(col), rf"[^a-z0-9{SPACE}]", "")
    return F.coalesce(trim_spaces(kept), F.lit(""))


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, r"\D", "")


def all_same_digit(col: Column) -> Column:
    """One digit repeated, at least twice."""
    return (F.length(col) > 1) & (col == F.repeat(F.substring(col, 1, 1), F.length(col)))


def mailbox(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", 1))


def mail_provider(email: Column) -> Column:
    return F.lower(F.substring_index(F.substring_index(email, "@", -1), ".", 1))


def clip(col: Column, limit: int) -> Column:
    return F.left(col, F.lit(limit))


def luhn_valid(col: Column) -> Column:
    """Luhn checksum over 13 to 19 digits; separators are ignored."""
    digits = digits_only(col)
    return F.coalesce(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), F.lit(False))


def part_of_longer_number(text: Column, start: Column, end: Column) -> Column:
    """Digits right next to the span, or one separator away from it."""
    before = F.substring(text, F.greatest(start - 1, F.lit(1)), F.least(start, F.lit(2)))
    after = F.substring(text, end + 1, F.lit(2))
    return before.rlike(rf"[0-9][{SPACE}\-]?\z") | after.rlike(rf"^[{SPACE}\-]?[0-9]")


def touches_alphanumeric(text: Column, start: Column, end: Column) -> Column:
    before = F.substring(text, F.greatest(start, F.lit(1)), F.least(start, F.lit(1)))
    after = F.substring(text, end + 1, F.lit(1))
    return before.rlike("[0-9A-Za-z]") | after.rlike("[0-9A-Za-z]")


def severity(pii_type: Column) -> Column:
    """Tier of a personal-data type: SPII, PII or CONTEXTUAL."""
    return (F.when(pii_type.isin(K.TIERS["SPII"]), "SPII")
            .when(pii_type.isin(K.TIERS["PII"]), "PII")
            .otherwise("CONTEXTUAL"))


def severity_sql(expr: str) -> str:
    return (f"CASE WHEN {in_list(expr, K.TIERS['SPII'])} THEN 'SPII' "
            f"WHEN {in_list(expr, K.TIERS['PII'])} THEN 'PII' ELSE 'CONTEXTUAL' END")


def token_type(token: Column) -> Column:
    """Type named in a token such as ``[EMAIL_1]``; null for anything else."""
    return filled(F.regexp_extract(token, r"^\[([A-Z_]+?)(?:_\d+)?\]\z", 1))


def screen_type(title: Column, url: Column, text: Column) -> Column:
    """Kind of page by keywords over title, address and text; first class wins."""
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, url, text)]))
    out = None
    for name, words in K.SCREEN_WORDS.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(blob, F.lit(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(K.DEFAULT_SCREEN)
