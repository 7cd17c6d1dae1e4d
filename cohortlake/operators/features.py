"""Code crosswalks, pivoted counts, adherence, area rates and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.operators.joins import apart, spine_fill
from cohortlake.operators.profile import distinct_events
from cohortlake.session import materialize

UNMATCHED = "unmatched"


def unique_codes(crosswalk: DataFrame, code: str, category: str) -> DataFrame:
    """One category per code (the greatest), so that a lookup never multiplies rows."""
    return crosswalk.where(F.col(code).isNotNull()).groupBy(code).agg(F.max(category).alias(category))


def crosswalk_exact(events: DataFrame, crosswalk: DataFrame, code: str, category: str,
                    how: str = "left") -> DataFrame:
    """Code to category on the whole code. No broadcast hint: adaptive execution
    measures the crosswalk and picks the join, or splits a code that most events have."""
    return events.join(apart(unique_codes(crosswalk, code, category)), code, how)


def crosswalk_prefix(events: DataFrame, crosswalk: DataFrame, code: str, category: str,
                     length: int = 3) -> DataFrame:
    """Whole-code lookup, then the greatest category sharing the first ``length`` characters.

    Both passes run on the distinct codes of the events, which are few however many
    events there are; one lookup by code then decorates the events.
    """
    exact = unique_codes(crosswalk, code, category)
    prefix = F.substring(code, 1, length)
    by_prefix = exact.groupBy(prefix.alias("__prefix")).agg(F.max(category).alias("__by_prefix"))
    used = events.select(code).where(F.col(code).isNotNull()).distinct()
    resolved = (
        used.join(exact, code, "left").withColumn("__prefix", prefix)
        .join(by_prefix, "__prefix", "left")
        .select(code, F.coalesce(category, "__by_prefix").alias(category))
    )
    return events.join(resolved, code, "left")


def pivot_counts(events: DataFrame, keys: Sequence[str], category: str, values: Sequence[str],
                 prefix: str = "", unmatched: str | None = UNMATCHED) -> DataFrame:
    """One column per listed category counting a member's events; rows without a category
    are counted under ``unmatched``.

    The value list is given, so no extra job discovers it, and a single combined
    aggregate produces all columns.
    """
    counts = [F.count_if(F.col(category) == v).alias(f"{prefix}{v}") for v in values]
    if unmatched:
        counts.append(F.count_if(F.col(category).isNull()).alias(f"{prefix}{unmatched}"))
    return events.groupBy(*keys).agg(*counts)


def pivot_wide(events: DataFrame, keys: Sequence[str], category: str, values: Sequence[str],
               prefix: str = "", unmatched: str | None = UNMATCHED) -> DataFrame:
    """As :func:`pivot_counts` for hundreds of categories.

    Events are first counted by member and category (map-side), so the wide row is
    built from at most one input row per cell. No listed value may be called ``unmatched``.
    """
    named = F.coalesce(F.col(category), F.lit(unmatched)) if unmatched else F.col(category)
    columns = [*values, *([unmatched] if unmatched else [])]
    counted = events.groupBy(*keys, named.alias("__category")).agg(F.count("*").alias("__n"))
    wide = counted.groupBy(*keys).pivot("__category", columns).agg(F.sum("__n"))
    return wide.select(*keys, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{prefix}{v}") for v in columns])


def category_values(crosswalk: DataFrame, category: str) -> list[str]:
    """Sorted categories of a crosswalk: the column set of a pivot.

    The schema of a wide table has to be known on the driver, so this is the one
    list collected here; it is as long as the result is wide.
    """
    rows = crosswalk.select(category).where(F.col(category).isNotNull()).distinct().collect()
    return sorted(r[0] for r in rows)


def category_events(events: DataFrame, crosswalk: DataFrame, keys: Sequence[str], date: str, code: str, category: str,
                    length: int = 3) -> DataFrame:
    """Distinct (member, date, code) with the two-pass category."""
    unique = distinct_events(events, [*keys, date, code], [code])
    return crosswalk_prefix(unique, crosswalk, code, category, length)


def category_counts(events: DataFrame, spine: DataFrame, crosswalk: DataFrame, keys: Sequence[str], date: str,
                    code: str, category: str, values: Sequence[str], length: int = 3,
                    prefix: str = "") -> DataFrame:
    """Distinct (member, date, code), two-pass category, pivoted counts, zero-filled spine."""
    placed = category_events(events, crosswalk, keys, date, code, category, length)
    return spine_fill(spine.select(*keys), pivot_counts(placed, keys, category, values, prefix), keys)


def provider_events(events: DataFrame, keys: Sequence[str], date: str, service: str, billing: str) -> DataFrame:
    """Distinct (member, date, specialty) of the service provider, else of the billing provider."""
    chosen = events.withColumn("specialty", F.coalesce(F.col(service), F.col(billing)))
    return distinct_events(chosen, [*keys, date, "specialty"], ["specialty"])


def provider_counts(events: DataFrame, spine: DataFrame, keys: Sequence[str], date: str, service: str,
                    billing: str, values: Sequence[str], prefix: str = "") -> DataFrame:
    """Counts per specialty: the service provider's, else the billing provider's."""
    unique = provider_events(events, keys, date, service, billing)
    return spine_fill(spine.select(*keys), pivot_counts(unique, keys, "specialty", values, prefix, None), keys)


def rx_adherence(fills: DataFrame, keys: Sequence[str], drug: str, fill_date: str, days: str,
                 generic: str) -> DataFrame:
    """Fills, drugs, share generic and days supplied over the span from first fill to last supply end."""
    return drug_totals(fills, keys, drug, fill_date, days, generic).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in DRUG_TOTALS], F.count("*").alias("number_of_unique_med"),
    ).select(*keys, F.col("fills").alias("number_of_fills"), "number_of_unique_med",
             *[c.alias(n) for n, c in adherence_shares().items()])


DRUG_TOTALS = ("fills", "generic", "supplied", "span")


def drug_totals(fills: DataFrame, keys: Sequence[str], drug: str, fill_date: str, days: str, generic: str) -> DataFrame:
    """One row per member and drug: fills, generic fills, days supplied, days from first fill to last supply end."""
    supply = F.col(days).try_cast("int")
    span = F.datediff(F.max(F.date_add(fill_date, supply)), F.min(fill_date))
    return fills.groupBy(*keys, drug).agg(
        F.count("*").alias("fills"), F.sum(generic).alias("generic"), F.sum(supply).alias("supplied"), span.alias("span"))


def adherence_shares() -> dict[str, Column]:
    """Shares from a member's sums of the drug totals."""
    return {"percent_generic": F.round(F.try_divide("generic", "fills"), 4),
            "percent_med_adherence": F.round(F.try_divide("supplied", "span"), 4)}


def sum_or_null(columns: Sequence[str]) -> Column:
    """Plain sum: null when any part is null."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total


def area_features(rates: DataFrame, kept: Sequence[str], combined: Mapping[str, Sequence[str]]) -> DataFrame:
    """Area table with some rates summed into one and the rest of the columns left out."""
    return rates.select(*kept, *[sum_or_null(parts).alias(name) for name, parts in combined.items()])


def impute_group_mean(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Null to the group mean; still null to the mean of the column after that first fill.

    Group means are a small aggregate joined back (a hot group is never gathered in one
    window), and the overall mean follows from the same aggregate: each filled column
    averages its values plus, for every group, the group mean times its null count. The
    aggregate is written once, as both uses read it.
    """
    stats = df.groupBy(group).agg(
        *[F.avg(c).alias(f"__mean_{i}") for i, c in enumerate(columns)],
        *[F.sum(c).alias(f"__sum_{i}") for i, c in enumerate(columns)],
        *[F.count(c).alias(f"__n_{i}") for i, c in enumerate(columns)],
        F.count("*").alias("__rows"),
    )
    stats = materialize(stats, "group-means")

    def overall(i: int) -> Column:
        mean, known = F.col(f"__mean_{i}"), F.col(f"__n_{i}")
        filled_sum = F.sum(F.col(f"__sum_{i}") + mean * (F.col("__rows") - known))
        filled_rows = F.sum(F.when(known > 0, F.col("__rows")))
        return F.try_divide(filled_sum, filled_rows)

    fallback = stats.agg(F.struct(*[overall(i).alias(f"f{i}") for i in range(len(columns))]).alias("all")).scalar()
    means = stats.select(F.col(group).alias("__group"), *[f"__mean_{i}" for i in range(len(columns))])
    joined = df.join(means, F.col(group).eqNullSafe(F.col("__group")), "left").withColumn("__all", fallback)
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.col(f"__mean_{i}"), F.col(f"__all.f{i}"))
        for i, c in enumerate(columns)
    }
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


BITS = 62


def group_indicators(events: DataFrame, crosswalk: DataFrame, keys: Sequence[str], code: str, group: str,
                     values: Sequence[str]) -> DataFrame:
    """0/1 per disease group: inner lookup drops unlisted codes, names are trimmed.

    A code may belong to several groups, so the crosswalk is only made distinct. Each
    group is one bit: a member's groups are OR-ed into one long per 62 groups, and that
    is all the shuffle carries, instead of one column per group.
    """
    names = F.array(*[F.lit(x) for x in values])
    slots = (
        crosswalk.select(code, (F.array_position(names, F.trim(group)) - 1).alias("__slot"))
        .where(F.col("__slot") >= 0).distinct()
    )
    slot = F.col("__slot")
    words = (len(values) + BITS - 1) // BITS
    masks = [
        F.bit_or(F.when(slot.between(w * BITS, (w + 1) * BITS - 1), F.expr(f"shiftleft(1L, cast(__slot - {w * BITS} AS INT))"))
                 .otherwise(0)).alias(f"__mask_{w}")
        for w in range(words)
    ]
    # repeated events only repeat the same bits, so they need not be made distinct first
    packed = events.select(*keys, code).join(slots, code, "inner").groupBy(*keys).agg(*masks)
    return packed.select(*keys, *[
        F.getbit(f"__mask_{i // BITS}", F.lit(i % BITS)).cast("int").alias(x) for i, x in enumerate(values)
    ])


def apply_rules(df: DataFrame, rules: Sequence[tuple[str, int, str]] = tuple(codes.GROUP_RULES)) -> DataFrame:
    """Ordered override rules: each sees the values its predecessors left.

    Consecutive rules that do not read each other's targets are applied together, so
    33 rules take a handful of projections.
    """
    pending: dict[str, Column] = {}
    result = df
    for target, value, condition in rules:
        reads = {w for w in condition.replace("+", " ").split() if w in df.columns} | {target}
        if reads & pending.keys():
            result = result.withColumns(pending)
            pending = {}
        pending[target] = F.when(F.expr(condition), value).otherwise(F.col(target))
    return result.withColumns(pending) if pending else result
