"""Scalar functions for use from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cloakframe.functions.risk import risk_level_sql
from cloakframe.functions.sqltext import raw
from cloakframe.functions.text import severity_sql


def register(spark: SparkSession) -> None:
    """Create ``pii_category``, ``risk_level``, ``luhn_valid`` and ``token_type``."""
    digits = "regexp_replace(s, '[^0-9]', '')"
    bodies = {
        "pii_category(t STRING)": severity_sql("t"),
        "risk_level(action STRING, description STRING)": risk_level_sql("action", "description"),
        "token_type(token STRING)":
            f"nullif(regexp_extract(token, {raw(r'^\[([A-Z_]+?)(?:_[0-9]+)?\]$')}, 1), '')",
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION luhn_valid(s STRING) RETURNS BOOLEAN "
              f"RETURN coalesce(length({digits}) BETWEEN 13 AND 19 AND luhn_check({digits}), false)")
