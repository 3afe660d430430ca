"""Small helpers for composing SQL expressions as text.

Detector expressions have hundreds of nodes; writing them as one SQL string
costs a single parse instead of one gateway call per node.
"""

from __future__ import annotations

from collections.abc import Iterable

from cloakframe.functions.patterns import SPACE

SOH = r"'\u0001'"
STX = r"'\u0002'"
ALNUM = "[0-9A-Za-z]"


def raw(text: str) -> str:
    """Raw SQL string literal (no escape processing)."""
    return f"r'{text}'" if "'" not in text else f'r"{text}"'


def quoted(text: str) -> str:
    """Plain SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(expr: str, values: Iterable[str]) -> str:
    return f"{expr} IN ({', '.join(quoted(v) for v in values)})"


def filled(expr: str) -> str:
    """NULL for an empty string, so that empty behaves like absent."""
    return f"nullif({expr}, '')"


def trimmed(expr: str) -> str:
    """Strip any Unicode space from both ends."""
    pattern = raw(rf"^[{SPACE}]+|[{SPACE}]+\z")
    return f"regexp_replace({expr}, {pattern}, '')"


def any_word(expr: str, words: Iterable[str], bounded: bool = False) -> str:
    """True when ``expr`` contains one of the words, as one regular expression."""
    alternatives = "|".join(_escape(w) for w in words)
    if bounded:
        alternatives = f"(?<![0-9a-z])(?:{alternatives})(?![0-9a-z])"
    return f"({expr} rlike {raw(alternatives)})"


def _escape(word: str) -> str:
    return "".join("\\" + c if c in r".\+*?()[]{}|^$-/&" else c for c in word)
