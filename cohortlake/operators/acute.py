"""Acute events: emergency predicate, avoidable flags and the visit hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.recode import any_code
from cohortlake.operators.episodes import episode_rollup
from cohortlake.operators.joins import apart

EVENT_FLAGS = ["ed_avoid", "ed_other", "ip_avoid", "ip_other"]
OUTCOMES = [
    "non_avoid_ip", "avoid_ip", "non_avoid_ed", "avoid_ed",
    "all_cause_ip", "all_cause_ed", "all_cause_acute", "avoid_acute",
]


def ed_visit(revenue: Column, place: Column, procedure: Column,
             revenue_codes: Sequence[str] = tuple(codes.ED_REVENUE_CODES),
             places: Sequence[str] = tuple(codes.ED_PLACES_OF_SERVICE),
             procedures: Sequence[str] = tuple(codes.ED_PROCEDURES)) -> Column:
    """1 when any of the three code columns marks an emergency visit."""
    return any_code([(revenue, revenue_codes), (place, places), (procedure, procedures)])


def acute_union(inpatient: DataFrame, outpatient: DataFrame, columns: Sequence[str], ed_flag: str) -> DataFrame:
    """Inpatient rows plus the outpatient rows that are emergency visits, with source tags."""
    stays = inpatient.select(*columns, F.lit(0).alias("ed_visit"), F.lit(1).alias("inpatient_visit"))
    visits = outpatient.where(F.col(ed_flag) == 1).select(
        *columns, F.lit(1).alias("ed_visit"), F.lit(0).alias("inpatient_visit")
    )
    return stays.unionByName(visits)


def avoidable_ed_codes(weights: DataFrame, code: str, parts: Sequence[str], cutoff: float = 0.5) -> DataFrame:
    """Codes whose avoidable share (the sum of ``parts``) exceeds the cutoff."""
    share = F.col(parts[0])
    for p in parts[1:]:
        share = share + F.col(p)
    return weights.groupBy(code).agg(F.max((share > cutoff).cast("int")).alias("avoidable_ed"))


def attach_code_flag(events: DataFrame, flags: DataFrame, code: str, flag: str) -> DataFrame:
    """Left lookup of a 0/1 code flag; unlisted codes get 0. ``flags`` is unique by code."""
    return events.join(apart(flags.select(code, flag)), code, "left").na.fill(0, subset=[flag])


def visit_flags(events: DataFrame) -> DataFrame:
    """Avoidable and other, emergency and inpatient, as four 0/1 columns."""
    ed, ip = F.col("ed_visit") == 1, F.col("inpatient_visit") == 1
    return events.withColumns({
        "ed_avoid": (ed & (F.col("avoidable_ed") == 1)).cast("int"),
        "ed_other": (ed & (F.col("avoidable_ed") == 0)).cast("int"),
        "ip_avoid": (ip & (F.col("avoidable_ip") == 1)).cast("int"),
        "ip_other": (ip & (F.col("avoidable_ip") == 0)).cast("int"),
    })


def hierarchy(episodes: DataFrame) -> DataFrame:
    """Exclusive outcome per episode: inpatient beats emergency, other beats avoidable."""
    ip_avoid, ip_other = F.col("ip_avoid") == 1, F.col("ip_other") == 1
    ed_avoid, ed_other = F.col("ed_avoid") == 1, F.col("ed_other") == 1
    no_stay = ~(ip_avoid | ip_other)
    outcome = {
        "non_avoid_ip": ip_other,
        "avoid_ip": ip_avoid & ~ip_other,
        "non_avoid_ed": no_stay & ed_other,
        "avoid_ed": no_stay & ed_avoid & ~ed_other,
        "all_cause_ip": ~no_stay,
        "all_cause_ed": no_stay & (ed_avoid | ed_other),
        "all_cause_acute": ip_avoid | ip_other | ed_avoid | ed_other,
        "avoid_acute": (ip_avoid & ~ip_other) | (no_stay & ed_avoid & ~ed_other),
    }
    kept = [c for c in episodes.columns if c not in EVENT_FLAGS]
    return episodes.select(*kept, *[condition.cast("int").alias(n) for n, condition in outcome.items()])


def acute_hierarchy(events: DataFrame, keys: Sequence[str], start: str, end: str, gap_days: int = 1,
                    mode: str = "lag") -> DataFrame:
    """Flagged events to one row per episode with the exclusive outcomes."""
    return hierarchy(episode_rollup(visit_flags(events), keys, start, end, EVENT_FLAGS, gap_days, mode))


def acute_measures(start: str, end: str) -> dict[str, Column]:
    """Measures summed per member and month from episode rows."""
    days = F.when(F.col("all_cause_ip") == 1, F.datediff(end, start)).otherwise(0)
    return {**{o: F.col(o) for o in OUTCOMES}, "inpatient_days": days}


def pre_acute_features(pre_totals: DataFrame, keys: Sequence[str], suffix: str = "_pre") -> DataFrame:
    """Inpatient days, visit totals and the avoidable share of visits (0 when there is none)."""
    visits, avoidable = F.col(f"all_cause_acute{suffix}"), F.col(f"avoid_acute{suffix}")
    return pre_totals.select(
        *keys,
        F.coalesce(F.col(f"inpatient_days{suffix}"), F.lit(0)).alias("total_inpatient_days"),
        visits.alias("total_all_cause_visits"),
        avoidable.alias("total_avoid_acute_visits"),
        F.when(visits == 0, F.lit(0.0)).otherwise(F.round(F.try_divide(avoidable, visits), 5))
        .alias("percent_non_emergent"),
    )
