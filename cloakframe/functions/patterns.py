"""Render the fixed patterns for a regular-expression engine.

Java 17 treats accented letters as word characters at ``\\b`` and neither Java
nor RE2 counts NBSP as ``\\s``; the detectors need the ASCII boundary and the
Unicode space class, so both are spelled out.
"""

from __future__ import annotations

import re

WORD = "0-9A-Za-z_"
SPACE = (r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}")
EDGE = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"

_CLASS = re.compile(r"\[(?:\\.|[^\]\\])*\]")


def _spaces(pattern: str) -> str:
    """Spell out ``\\s`` both inside and outside of character classes."""
    pattern = _CLASS.sub(lambda m: m.group(0).replace(r"\s", SPACE), pattern)
    return pattern.replace(r"\s", f"[{SPACE}]")


def jvm(pattern: str) -> str:
    """Pattern for Spark: ASCII boundaries as look-arounds.

    A boundary next to a word character needs one look-around only; where the
    neighbour may be punctuation the two-sided form is used.
    """
    out = _spaces(pattern)
    out = re.sub(r"\\b(?=$|\||\))", f"(?![{WORD}])", out)
    if re.match(r"(?:\(\?i\))?\\b\[a-zA-Z0-9\._", out):
        return out.replace(r"\b", EDGE)
    return out.replace(r"\b", f"(?<![{WORD}])")


def re2(pattern: str) -> str:
    """Pattern for RE2, whose ``\\b`` is ASCII already."""
    return _spaces(pattern)
