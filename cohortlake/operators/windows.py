"""Observation windows around an index month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.dates import month_index, trend_slope
from cohortlake.operators.joins import apart

HALF = 6


def index_windows(members: DataFrame, index: str) -> DataFrame:
    """Window bounds: the half-year after the index month is 'pre', the next one 'post'."""
    m = F.col(index)
    return members.withColumns({
        "start_month": m + 1, "end_month": m + 2 * HALF,
        "pre_start": m + 1, "pre_end": m + HALF,
        "post_start": m + HALF + 1, "post_end": m + 2 * HALF,
    })


def window_flag(month: str, start: str, end: str) -> Column:
    return F.coalesce(F.col(month).between(F.col(start), F.col(end)).cast("int"), F.lit(0))


def prepost_window(events: DataFrame, windows: DataFrame, keys: Sequence[str], date: str,
                   base_year: int) -> DataFrame:
    """Row-level events inside a member's twelve months, flagged pre and post.

    Equi-join on the member with the month range applied to the joined row. The windows
    have a shuffle of their own, so adaptive execution is free to split a hot member.
    """
    dated = events.withColumn("service_month", month_index(F.col(date), base_year))
    return _flagged(dated.join(apart(windows), list(keys), "inner"))


def _flagged(joined: DataFrame) -> DataFrame:
    inside = joined.where(F.col("service_month").between(F.col("start_month"), F.col("end_month")))
    return inside.withColumns({
        "pre": window_flag("service_month", "pre_start", "pre_end"),
        "post": window_flag("service_month", "post_start", "post_end"),
    })


def indexed_lines(lines: DataFrame, headers: DataFrame, members: DataFrame, claim: Sequence[str], keys: Sequence[str],
                  index: str) -> DataFrame:
    """Lines with their header's columns and their member's index month.

    The month is joined to the headers, which are fewer, and reaches the lines with them: no line is sent to its
    member just to learn the window, and a test on a header's date is made before lines are joined.
    """
    placed = headers.join(apart(members.select(*keys, index)), list(keys), "inner")
    return lines.join(placed, list(claim), "inner")


def prepost_indexed(events: DataFrame, index: str, date: str, base_year: int) -> DataFrame:
    """As :func:`prepost_window` for events that carry their member's index month."""
    dated = events.withColumn("service_month", month_index(F.col(date), base_year))
    return _flagged(index_windows(dated, index))


def in_pre_months(index: str, date: str, base_year: int) -> Column:
    """Whether a date lies in the half-year after the index month."""
    return month_index(F.col(date), base_year).between(F.col(index) + 1, F.col(index) + HALF)


def monthly_totals(events: DataFrame, keys: Sequence[str], date: str, base_year: int,
                   totals: Mapping[str, Column]) -> DataFrame:
    """Events summed to one row per member and calendar month.

    Every window feature depends on the month alone, so this map-side combined table
    (a few dozen rows per member at most) is what joins the index, however many
    events one member has.
    """
    dated = events.withColumn("service_month", month_index(F.col(date), base_year))
    return dated.groupBy(*keys, "service_month").agg(*[F.sum(c).alias(n) for n, c in totals.items()])


def window_totals(monthly: DataFrame, windows: DataFrame, keys: Sequence[str], measures: Sequence[str],
                  period: str) -> DataFrame:
    """Sum of monthly measures inside one period ('pre' or 'post') per member."""
    inside = F.col("service_month").between(F.col(f"{period}_start"), F.col(f"{period}_end"))
    joined = monthly.join(windows.select(*keys, f"{period}_start", f"{period}_end"), list(keys)).where(inside)
    return joined.groupBy(*keys).agg(*[F.sum(m).alias(f"{m}_{period}") for m in measures])


def month_slots(monthly: DataFrame, windows: DataFrame, keys: Sequence[str], measure: str,
                prefix: str | None = None) -> DataFrame:
    """Six columns ``<prefix>_month1..6``: the measure in each month of the pre period."""
    name = prefix or measure
    joined = monthly.join(windows.select(*keys, "pre_start", "pre_end"), list(keys)).where(
        F.col("service_month").between(F.col("pre_start"), F.col("pre_end"))
    )
    slot = F.col("service_month") - F.col("pre_start")
    return joined.groupBy(*keys).agg(*[
        F.sum(F.when(slot == k, F.col(measure)).otherwise(0)).alias(f"{name}_month{k + 1}") for k in range(HALF)
    ])


def slot_slope(prefix: str, digits: int = 6) -> Column:
    """Linear trend over the six monthly columns of :func:`month_slots`."""
    return trend_slope([F.col(f"{prefix}_month{k + 1}") for k in range(HALF)], digits)
