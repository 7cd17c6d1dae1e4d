"""Recodes and month arithmetic as session functions, for use from SQL text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from cohortlake.functions import codes


def _text(value) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_recode(spark: SparkSession, name: str, mapping: Mapping[str, Sequence], other: str | None = None) -> None:
    """``name(code)``: the label whose codes hold it, else ``other``."""
    branches = " ".join(f"WHEN code IN ({', '.join(map(_text, values))}) THEN {_text(label)}" for label, values in mapping.items())
    rest = "NULL" if other is None else _text(other)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(code STRING) RETURNS STRING RETURN CASE {branches} ELSE {rest} END")


def register(spark: SparkSession) -> None:
    """``study_month(day, base_year)``, ``region_of(state)`` and ``enrolled_days(days)`` in the session.

    Their bodies are SQL, so Catalyst inlines them like any expression.
    """
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION study_month(day DATE, base_year INT) RETURNS INT "
              "RETURN (year(day) - base_year) * 12 + month(day)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION enrolled_days(days BIGINT) RETURNS STRING "
              "RETURN CASE WHEN days > 0 THEN 'yes' WHEN days = 0 THEN 'no' ELSE 'missing' END")
    create_recode(spark, "region_of", codes.REGIONS, codes.OTHER_REGION)
