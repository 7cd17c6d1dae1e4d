"""Member-month panels, coverage vectors and the loss-of-coverage label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.dates import month_name, month_year
from cohortlake.functions.recode import days_flag, month_flags, recode


def member_month_panel(wide: DataFrame, keys: Sequence[str], summed: Mapping[str, Sequence[str]],
                       resolved: Mapping[str, Sequence[str]]) -> DataFrame:
    """Wide annual record (twelve columns per attribute) to one row per member and month.

    Duplicate records of a member are combined first: ``summed`` attributes add up,
    ``resolved`` attributes keep the greatest code. One ``stack`` then unpivots all
    attributes together, so the panel needs a single shuffle and no self-join.
    """
    aggregates = [F.sum(c).alias(c) for cols in summed.values() for c in cols]
    aggregates += [F.max(c).alias(c) for cols in resolved.values() for c in cols]
    one_per_member = wide.groupBy(*keys).agg(*aggregates)
    attributes = {**summed, **resolved}
    rows = [
        F.struct(F.lit(i + 1).alias("month"), *[F.col(cols[i]).alias(a) for a, cols in attributes.items()])
        for i in range(12)
    ]
    return one_per_member.select(*keys, F.inline(F.array(*rows)))


def enroll_flags(panel: DataFrame, medicaid_days: str = "medicaid_days", chip_days: str = "chip_days",
                 dual_code: str = "dual_code", plan_code: str = "plan_code", chip_code: str = "chip_code",
                 include_chip: bool = False) -> DataFrame:
    """Enrollment, dual, managed-care and coverage flags per member-month.

    ``enrolled`` follows Medicaid days alone unless ``include_chip`` is set.
    """
    medicaid, chip = days_flag(F.col(medicaid_days)), days_flag(F.col(chip_days))
    covered = (medicaid == "yes") | (chip == "yes") if include_chip else medicaid == "yes"
    return panel.withColumns({
        "med_enroll": medicaid,
        "chip_enroll": chip,
        "enrolled": F.when(covered, "yes").otherwise("no"),
        "dual": recode(F.col(dual_code), codes.DUAL_STATUS),
        "managed_care": recode(F.col(plan_code), {"yes": codes.MANAGED_CARE_PLANS}, "no"),
        "coverage_type": recode(F.col(chip_code), codes.COVERAGE_TYPE),
    })


def annual_summary(flags: DataFrame, keys: Sequence[str], days: str = "medicaid_days") -> DataFrame:
    """Months enrolled, with Medicaid, dual and managed-care, total days and twelve month flags per key (member, year)."""
    month_columns = [f"{m.lower()}_elig" for m in codes.MONTH_NAMES]

    def months(flag: str) -> Column:
        return F.count_if(F.col(flag) == "yes")

    enrolled = flags.where(F.col("enrolled") == "yes")
    return enrolled.groupBy(*keys).agg(
        months("enrolled").alias("enrolled_months"),
        months("med_enroll").alias("medicaid_months"),
        months("dual").alias("medicare_months"),
        months("managed_care").alias("managed_care_months"),
        F.sum(days).alias("total_days"),
        *[F.max((F.col("month") == i + 1).cast("int")).alias(n) for i, n in enumerate(month_columns)],
    )


def month_pivot_flags(df: DataFrame, keys: Sequence[str], month: str) -> DataFrame:
    """Twelve 0/1 columns per member: any row in that month."""
    names = [f"m{i:02d}" for i in range(1, 13)]
    rows = df.select(*keys, *month_flags(F.col(month), 12, names))
    return rows.groupBy(*keys).agg(*[F.max(n).alias(n) for n in names])


def select_cohort(members: DataFrame, summary: DataFrame, person: str, state: str, age_cat: str,
                  states: Sequence[str] = tuple(codes.STUDY_STATES), full_months: int | None = None) -> DataFrame:
    """One record per person in the study states, under 65, with no dual month.

    A person listed in several states keeps the alphabetically first one. The summary
    join is inner: the dual filter would discard unmatched members anyway.
    """
    from cohortlake.operators.profile import keep_first

    one_state = keep_first(members, [person], [state])
    kept = one_state.where(F.col(state).isin(list(states)) & (F.col(age_cat) != "over64"))
    joined = kept.join(summary.where(F.col("medicare_months") == 0), [person, state], "inner")
    if full_months is not None:
        joined = joined.where(F.col("enrolled_months") == full_months)
    return joined


def coverage_mask(months: DataFrame, keys: Sequence[str], index: str, width: int = 36) -> DataFrame:
    """Coverage of month 1..width packed as bits of one long, with the first covered month.

    One bigint per member replaces ``width`` columns in the shuffle.
    """
    if not 1 <= width <= 64:
        raise ValueError("one long holds 64 months")
    inside = months.where(F.col(index).between(1, width))
    bit = F.expr(f"shiftleft(1L, {index} - 1)")
    return inside.groupBy(*keys).agg(
        F.bit_or(bit).alias("mask"), F.min(index).cast("int").alias("first"),
    )


def enrollment_panel(mask: DataFrame, keys: Sequence[str], width: int = 36) -> DataFrame:
    """``col1..colN`` 0/1 columns from a coverage mask."""
    return mask.select(*keys, *[F.getbit("mask", F.lit(i)).cast("int").alias(f"col{i + 1}") for i in range(width)])


def any_month(panel: DataFrame, start: int, stop: int) -> Column:
    """True when any of ``col<start>..col<stop>`` is 1."""
    return reduce(or_, [F.col(f"col{i}") == 1 for i in range(start, stop + 1)])


def first_enroll(mask: DataFrame, follow_up: int = 12, last_start: int = 24) -> DataFrame:
    """Months covered in the ``follow_up`` months after the first one, which is not counted.

    Members whose first month comes after ``last_start`` get 0.
    """
    following = F.expr(f"bit_count(shiftright(mask, first) & {2 ** follow_up - 1}L)").cast("int")
    return mask.withColumns({
        "enroll_months": F.when(F.col("first") <= last_start, following).otherwise(0),
        "total_months": F.bit_count("mask").cast("int"),
    })


def coverage_loss(mask: DataFrame, base_year: int, full_months: int = 12, last_start: int = 24) -> DataFrame:
    """Stage-1 population with the label: 1.0 unless all follow-up months are covered."""
    starts = first_enroll(mask, last_start=last_start).where(F.col("first") <= last_start)
    enrolled = (F.col("enroll_months") >= full_months).cast("int")
    return starts.withColumns({
        "enrolled": enrolled,
        "lose_coverage": (1 - enrolled).cast("double"),
        "enroll_month": month_name(F.col("first")),
        "enroll_year": month_year(F.col("first"), base_year),
    })
