"""Claim completeness, claim cost, payment gaps and strata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.recode import present

MONEY = "decimal(18,2)"


def claim_completeness(lines: DataFrame, claim: Sequence[str], fields: Mapping[str, str],
                       tiers: Mapping[str, Sequence]) -> DataFrame:
    """Per claim: which tiers are met. ``fields`` maps field names to columns; a field
    counts when any line of the claim has it."""
    flags = lines.groupBy(*claim).agg(*[F.max(present(F.col(c))).alias(f) for f, c in fields.items()])

    def met(required: Sequence) -> Column:
        parts = [F.greatest(*[F.col(f) for f in r]) if isinstance(r, (list, tuple)) else F.col(r) for r in required]
        return F.least(*parts) if len(parts) > 1 else parts[0]

    return flags.withColumns({name: met(required) for name, required in tiers.items()})


def completeness_report(claims: DataFrame, state: str, measures: Sequence[str]) -> DataFrame:
    """Claims meeting each measure by state, with a grand total row (state 'ALL'), in one rollup."""
    totals = claims.rollup(state).agg(
        *[F.sum(m).alias(m) for m in measures], F.count("*").alias("total_claims"),
        F.grouping(state).alias("__all"),
    )
    return totals.select(
        F.when(F.col("__all") == 1, "ALL").otherwise(F.col(state)).alias(state), *measures, "total_claims"
    )


def payment_columns(claim_type: str, header_amount: str, line_amount: str,
                    ffs: Sequence[str] = (codes.FEE_FOR_SERVICE,),
                    mc: Sequence[str] = (codes.MANAGED_CARE,)) -> dict[str, Column]:
    """Amounts by payer, zero where the other payer paid or the amount is missing."""
    zero = F.lit(0).cast(MONEY)
    kind = F.col(claim_type)
    return {
        "ffs_total": F.coalesce(F.when(kind.isin(list(ffs)), F.col(header_amount).cast(MONEY)), zero),
        "mc_total": F.coalesce(F.when(kind.isin(list(mc)), F.col(line_amount).cast(MONEY)), zero),
    }


def claim_cost(lines: DataFrame, claim: Sequence[str], ffs_agg: str = "mean") -> DataFrame:
    """Line amounts to claim cost.

    ``ffs_agg='mean'`` where the payment is a header amount repeated on each line,
    ``'sum'`` where each line carries its own.
    """
    ffs = F.avg("ffs_total") if ffs_agg == "mean" else F.sum("ffs_total")
    return lines.groupBy(*claim).agg(
        F.sum("mc_total").cast(MONEY).alias("mc_total"), ffs.cast(MONEY).alias("ffs_total")
    ).withColumn("total_cost", (F.col("mc_total") + F.col("ffs_total")).cast(MONEY))


def member_cost(claim_costs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Claims of the listed families summed per member. Which families count is the caller's list."""
    stacked = claim_costs[0]
    for other in claim_costs[1:]:
        stacked = stacked.unionByName(other)
    amounts = ["mc_total", "ffs_total", "total_cost"]
    return stacked.groupBy(*keys).agg(*[F.sum(a).cast(MONEY).alias(a) for a in amounts])


def payment_gaps(lines: DataFrame, claim: Sequence[str], state: str, claim_type: str, header_amount: str,
                 line_amount: str, ffs: Sequence[str] = (codes.FEE_FOR_SERVICE,),
                 mc: Sequence[str] = (codes.MANAGED_CARE,)) -> DataFrame:
    """Claims with a missing payment by state and payer: claim maximum, then state sum."""
    is_ffs, is_mc = F.col(claim_type).isin(list(ffs)), F.col(claim_type).isin(list(mc))
    flags = {
        "missing_ffs": is_ffs & F.col(header_amount).isNull(),
        "missing_mc": is_mc & F.col(line_amount).isNull(),
        "ffs_claim": is_ffs,
        "mc_claim": is_mc,
    }
    per_claim = lines.groupBy(*claim, state).agg(
        *[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flags.items()]
    )
    return per_claim.groupBy(state).agg(
        *[F.sum(n).alias(n) for n in flags], F.count("*").alias("total")
    )


def stratum(age_cat: Column, disabled: Column) -> Column:
    """'adults', 'kids' or 'disabled'; null outside all three."""
    child = age_cat.isin(codes.CHILD_BANDS)
    return (
        F.when(disabled == "yes", "disabled")
        .when((disabled == "no") & child, "kids")
        .when((disabled == "no") & ~age_cat.isin([*codes.CHILD_BANDS, codes.MISSING]), "adults")
    )


def stratum_by_age(age: Column, disabled_flag: Column) -> Column:
    """The same split on completed years and a 0/1 disability flag."""
    return (
        F.when(disabled_flag == 1, "disabled")
        .when((disabled_flag == 0) & (age > 17), "adults")
        .when((disabled_flag == 0) & (age < 18), "kids")
    )
