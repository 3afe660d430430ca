"""End-to-end privacy plans: scan, tokenize, redact, prove, report."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators import audit, detect, spans as sp, tokens
from cloakframe.session import materialize


@dataclass(frozen=True)
class Sanitized:
    """Everything one pass over a batch of elements yields."""

    elements: DataFrame
    spans: DataFrame
    vault: DataFrame
    redacted: DataFrame

    def staged(self) -> Sanitized:
        """The same with the redacted elements stored, for several later passes."""
        return replace(self, redacted=materialize(self.redacted))

    @property
    def audit(self) -> DataFrame:
        return tokens.audit_rows(self.vault, self.elements)

    @property
    def report(self) -> DataFrame:
        return audit.egress_report(self.redacted, self.vault)

    @property
    def telemetry(self) -> DataFrame:
        return audit.telemetry(self.audit, self.report)

    @property
    def manifest(self) -> DataFrame:
        return tokens.manifest_tokens(self.redacted, self.vault)

    def safe_and_blocked(self) -> tuple[DataFrame, DataFrame]:
        return audit.split_by_proof(self.redacted, self.report)


def as_elements(df: DataFrame, session: str, step: str, text: str = "text",
                position: str | None = None, element: str | None = None) -> DataFrame:
    """View any text table as elements: who the session is, which step, which text."""
    pos = F.col(position) if position else F.lit(0)
    name = F.col(element) if element else F.concat(F.lit("e_"), F.col(step))
    return df.select(
        F.col(session).cast("string").alias("session_id"), F.col(step).alias("step_no"),
        pos.cast("int").alias("element_pos"), name.cast("string").alias("element_id"),
        F.col(text).alias("text"))


def scan(elements: DataFrame, extra_spans: DataFrame | None = None, **options) -> DataFrame:
    """Span rows of all elements, stored once.

    ``extra_spans`` are span rows of another detector (for instance a
    named-entity model); per field they are merged with the pattern spans.
    """
    found = sp.explode_spans(detect.scan_elements(elements, **options))
    if extra_spans is not None:
        merged = sp.merge_span_tables(found, extra_spans,
                                      (*sp.ELEMENT_KEY, "element_id", "field"))
        found = sp.explode_spans(merged, (*sp.ELEMENT_KEY, "element_id"))
    return materialize(found)


def sanitize(elements: DataFrame, extra_spans: DataFrame | None = None, **options) -> Sanitized:
    """Scan, number, redact.  Only the small span table is shuffled by value."""
    found = scan(elements, extra_spans, **options)
    vault = materialize(tokens.build_vault(found))
    return Sanitized(elements, found, vault, tokens.redact(elements, found, vault))
