"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hex strings) are reported
as they stand.  Weak parts, which alone are ordinary text (account names, opaque
strings, endpoints), are reported only where complementary parts lie in the same
scope (a paragraph, however long): an identifier with a secret, an opaque string
with an identifier or endpoint, an endpoint with both.  The interval join runs
over all parts of a batch at once: scopes are intervals on one line, each part
looks up the one it begins in by binary search, and the kinds of every scope
are counted; no pairs are built.

Defined cases: a null or empty text has no spans; spans count code points, end
exclusive; equal spans of one kind count once; very long texts are scanned whole;
repeated rows are reported each; an empty table gives no rows; other columns are
ignored by the scan and kept by the redaction.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cloakframe.llm.common import text_array

STRONG = ["assign", "access", "hex"]
KINDS = [*STRONG, "ident", "opaque", "endpoint"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENT = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}|\bASIA[A-Z0-9]{12,}""", re.I | re.A)
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
ENDPOINT = re.compile(r"""\b(?:https?|s3|ftp|redis|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|amqp)://[^\s"'<>|]+""", re.A)
SCOPE = re.compile(r"\n[ \t]*\n")
_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def weak_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if ":" in text or "=" in text or "ASIA" in text:
        out += [(m.start(), 3, m.end()) for m in IDENT.finditer(text)]
    for m in OPAQUE.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s):
            out.append((m.start(), 4, m.end()))
    if "://" in text:
        out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return out


def linked(scope: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Mask of the parts to report: strong ones, and weak ones with complementary parts in their scope."""
    n = int(scope.max()) + 1 if len(scope) else 0
    ident, secret, point = (np.bincount(scope[np.isin(kind, k)], minlength=n)[scope] > 0 for k in ((1, 3), (0, 2, 4), (5,)))
    weak = [(kind == 3) & secret, (kind == 4) & (ident | point), (kind == 5) & ident & secret]
    return (kind < len(STRONG)) | weak[0] | weak[1] | weak[2]


def scan(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Reported spans (start, kind, end), in order, of every text."""
    row, spans, scopes, begun, found = [], [], [], 0, []
    for k, text in enumerate(texts):
        strong = sorted(strong_spans(text))
        weak = []
        if strong or ":" in text or "=" in text or "ASIA" in text:
            weak = _apart(weak_spans(text), [(s, e) for s, _, e in strong])
        found.append(strong)
        if weak:
            cuts = [m.end() for m in SCOPE.finditer(text)]
            parts = strong + weak
            row += [k] * len(parts)
            spans += parts
            scopes.append(begun + np.searchsorted(np.array(cuts, np.int64), [s for s, _, _ in parts], side="right"))
            begun += len(cuts) + 1
    if spans:
        kind = np.array([x[1] for x in spans])
        for i in np.flatnonzero(linked(np.concatenate(scopes), kind) & (kind >= len(STRONG))).tolist():
            found[row[i]].append(spans[i])
    return [sorted(set(x)) for x in found]


def _apart(weak: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Weak spans that overlap no taken one, by binary search."""
    if not taken:
        return sorted(weak)
    starts = np.array([s for s, _ in taken])
    latest = np.maximum.accumulate([e for _, e in taken])
    out = []
    for w in sorted(weak):
        k = int(np.searchsorted(starts, w[2]))
        if not k or latest[k - 1] <= w[0]:
            out.append(w)
    return out


def _digest(batches):
    for batch in batches:
        found = scan(text_array(batch.column("text")).to_pylist())
        rows = []
        for spans in found:
            written = [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
            base = ",".join(w for w, (_, k, _) in zip(written, spans, strict=True) if k < len(STRONG))
            n = [sum(k == j for _, k, _ in spans) for j in range(len(STRONG))]
            rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(written)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_spans(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every document: one scan, no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_digest, f"doc_id long, {_SCHEMA}")


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with every run of overlapping spans replaced by ``mark``."""
    out, at, end = [], 0, 0
    for s, _, e in spans:
        if s >= end:
            out += [text[at:s], mark]
        at = end = max(end, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All documents with their reported spans replaced; texts without any stay as they are.

    A column ``n_chars`` follows the new text; all other columns are kept.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            new = [redacted(t, s, mark) if s else t for t, s in zip(texts, scan([t or "" for t in texts]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), *batch.columns[1:]], names=["text", *batch.schema.names[1:]])

    names = docs.columns
    others = [c for c in names if c != "text"]
    out = docs.select("text", *others)
    out = out.mapInArrow(run, out.schema)
    if "n_chars" in names:
        changed = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").contains(mark), changed).otherwise(F.col("n_chars")))
    return out.select(*names)
