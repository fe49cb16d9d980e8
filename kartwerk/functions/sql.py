"""The text and number functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text


def register(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions; they are expanded into the plan like any expression."""
    bodies = {
        "arabic_digits": ("s STRING", "STRING", f"translate(s, '{text.ARABIC_DIGITS}{text.PERSIAN_DIGITS}', '{text.DIGITS * 2}')"),
        "arabic_fold": ("s STRING", "STRING", f"translate(s, '{text.FOLD_FROM}', '{text.FOLD_TO}')"),
        "arabic_undecorated": ("s STRING", "STRING", f"translate(s, '{text.DIACRITICS}', '')"),
        "nid_digits": ("s STRING", "STRING", rf"regexp_replace(translate(coalesce(s, ''), '{text.ARABIC_DIGITS}', '{text.DIGITS}'), '[^\\p{{Nd}}]', '')"),
        "nid_gender": ("s STRING", "STRING", "CASE WHEN length(s) <> 14 THEN NULL WHEN try_cast(substr(s, 11, 1) AS INT) % 2 = 1 THEN 'male' WHEN try_cast(substr(s, 11, 1) AS INT) % 2 = 0 THEN 'female' END"),
    }
    for name, (args, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(bodies)
