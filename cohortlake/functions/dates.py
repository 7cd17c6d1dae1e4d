"""Month arithmetic on a running month index (January of the base year is 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlake.functions import codes


def month_index(date: Column, base_year: int) -> Column:
    return ((F.year(date) - base_year) * 12 + F.month(date)).cast("int")


def month_name(index: Column) -> Column:
    names = F.array(*[F.lit(n) for n in codes.MONTH_NAMES])
    return F.element_at(names, (F.pmod(index - 1, F.lit(12)) + 1).cast("int"))


def month_year(index: Column, base_year: int) -> Column:
    return (F.floor((index - 1) / 12) + base_year).cast("int")


def index_from_name(year: Column, name: Column, base_year: int) -> Column:
    """Month index from a calendar year and a three-letter month name."""
    names = F.array(*[F.lit(n) for n in codes.MONTH_NAMES])
    position = F.array_position(names, name).cast("int")
    return F.when(position > 0, (year - base_year) * 12 + position).cast("int")


def on_or_after(column: Column, day: str) -> Column:
    """Comparison with an uncast column, so the predicate reaches the parquet scan."""
    return column >= F.lit(day).cast("timestamp_ntz")


def before(column: Column, day: str) -> Column:
    return column < F.lit(day).cast("timestamp_ntz")


def trend_slope(values: Sequence[Column], digits: int = 6) -> Column:
    """Least-squares slope of equally spaced values on x = 1..n, in closed form.

    With centred x the slope is sum((x - mean x) * y) / sum((x - mean x)^2).
    """
    n = len(values)
    centred = [i - (n - 1) / 2 for i in range(n)]
    spread = sum(c * c for c in centred)
    total = None
    for weight, value in zip(centred, values):
        term = F.lit(float(weight)) * value.cast("double")
        total = term if total is None else total + term
    return F.round(total / F.lit(float(spread)), digits)
