"""Table-driven recodes as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlake.functions import codes


def _chain(branches: Iterable[tuple[Column, object]], default: object) -> Column:
    expr = None
    for condition, value in branches:
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def to_int(source: Column) -> Column:
    """Whole number held as text or as a number, else null; '007' and '7.0' are 7.

    A pattern test comes first: ``try_cast`` raises and catches an exception inside for
    every bad value, which costs microseconds per row on dirty columns.
    """
    text = F.trim(source.cast("string"))
    return F.when(text.rlike(r"^-?0*[0-9]{1,18}(\.0*)?$"), F.regexp_replace(text, r"\..*$", "").cast("bigint"))


def recode(source: Column, table: Mapping[str, Sequence], default: str | None = codes.MISSING,
           numeric: bool = False) -> Column:
    """Map codes to labels. Text codes keep their leading zeros; ``numeric`` compares
    as whole numbers, so that '01' and '1' agree and junk falls to ``default``."""
    value = to_int(source) if numeric else source.cast("string")
    return _chain(((value.isin(list(members)), label) for label, members in table.items()), default)


def band(source: Column, bands: Sequence[tuple], default: str | None = codes.MISSING) -> Column:
    """First matching open interval wins; null falls to ``default``."""

    def inside(low, high):
        parts = ([source > low] if low is not None else []) + ([source < high] if high is not None else [])
        return reduce(and_, parts)

    return _chain(((inside(low, high), label) for label, low, high in bands), default)


def age_band(age: Column) -> Column:
    return band(age, codes.AGE_BANDS)


def region(state: Column) -> Column:
    return recode(state, codes.REGIONS, codes.OTHER_REGION)


def race_group(race: Column) -> Column:
    """Collapse to the five reporting groups (null falls in the last one)."""
    return recode(race, codes.RACE_GROUPS, codes.OTHER_RACE_GROUP)


def composite_flag(flags: Sequence[Column]) -> Column:
    """'yes' if any flag is 1, 'no' if all are 0, else 'missing'."""
    return (
        F.when(reduce(or_, [f == 1 for f in flags]), "yes")
        .when(reduce(and_, [f == 0 for f in flags]), "no")
        .otherwise(codes.MISSING)
    )


def days_flag(days: Column) -> Column:
    """Positive days 'yes', zero 'no', null 'missing'."""
    return F.when(days > 0, "yes").when(days == 0, "no").otherwise(codes.MISSING)


def present(source: Column) -> Column:
    """1 when the value is not null, else 0."""
    return source.isNotNull().cast("int")


def any_code(pairs: Sequence[tuple[Column, Sequence[str]]]) -> Column:
    """1 when any column holds one of its codes (compared as text, null never matches)."""
    hits = [F.coalesce(c.cast("string").isin(list(members)), F.lit(False)) for c, members in pairs]
    return reduce(or_, hits).cast("int")


def month_flags(month: Column, count: int = 12, names: Sequence[str] | None = None) -> list[Column]:
    """One 0/1 column per month number."""
    labels = names or [f"m{i:02d}" for i in range(1, count + 1)]
    return [F.coalesce((month == i + 1).cast("int"), F.lit(0)).alias(n) for i, n in enumerate(labels)]


def age_sex_cells(age: Column, male: Column) -> list[Column]:
    """Eleven 0/1 cells on completed years; an unknown sex falls in no split cell."""
    years = F.floor(age).cast("int")
    cells = []
    for name, low, high, sex in codes.AGE_SEX_CELLS:
        tests = ([years >= low] if low is not None else []) + ([years <= high] if high is not None else [])
        tests += [male == sex] if sex is not None else []
        cells.append(F.when(reduce(and_, tests), 1).otherwise(0).alias(name))
    return cells


def row_sum(columns: Sequence[Column]) -> Column:
    """Sum across the columns of one row; a null counts as zero."""
    values = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)
