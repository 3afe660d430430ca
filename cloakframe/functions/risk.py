"""Risk level of plan steps, and the reason shown for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions import constants as K
from cloakframe.functions.sqltext import any_word, in_list, quoted


def risk_level_sql(action: str, description: str, forbidden: tuple[str, ...] = ()) -> str:
    act, text = f"upper({action})", f"lower(coalesce({description}, ''))"
    banned = f"WHEN {in_list(act, forbidden)} THEN 'FORBIDDEN' " if forbidden else ""
    return (f"CASE {banned}WHEN {in_list(act, K.CRITICAL_ACTIONS)} THEN 'CRITICAL' "
            f"WHEN {any_word(text, K.CRITICAL_WORDS)} THEN 'CRITICAL' "
            f"WHEN {any_word(text, K.CAUTION_WORDS)} THEN "
            f"CASE WHEN {any_word(text, K.SAFE_WORDS)} THEN 'SAFE' ELSE 'CAUTION' END "
            "ELSE 'SAFE' END")


def risk_level(action: str = "action", description: str = "description",
               forbidden: tuple[str, ...] = ()) -> Column:
    """FORBIDDEN, CRITICAL, CAUTION or SAFE; words count also inside other words."""
    return F.expr(risk_level_sql(action, description, forbidden))


def risk_reason(action: str = "action", description: str = "description",
                level: str = "level") -> Column:
    act, text = f"upper({action})", f"lower(coalesce({description}, ''))"
    named = " ".join(
        f"WHEN {level} = 'CRITICAL' AND contains({text}, {quoted(w)}) "
        f"THEN {quoted(f'Action involves {w} — sensitive operation')}" for w in K.REASON_WORDS)
    return F.expr(
        f"CASE WHEN {act} = 'TYPE_FROM_VAULT' THEN {quoted(K.REASONS['vault'])} "
        f"WHEN {act} = 'CAPTCHA_HANDOFF' THEN {quoted(K.REASONS['captcha'])} {named} "
        f"WHEN {level} = 'CRITICAL' THEN {quoted(K.REASONS['critical'])} "
        f"WHEN {level} = 'FORBIDDEN' THEN {quoted(K.REASONS['forbidden'])} "
        f"WHEN {level} = 'CAUTION' THEN {quoted(K.REASONS['caution'])} "
        f"ELSE {quoted(K.REASONS['safe'])} END")
