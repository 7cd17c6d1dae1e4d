"""Care episodes: merging date intervals of one member.

Which episode an interval belongs to depends only on the distinct (member, start,
end) triples and how often each occurs. Rows are therefore combined to distinct
triples first (map-side), and only those are ordered in a window: however many rows
one member has, its window holds at most one row per pair of calendar dates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions import codes

SALTS = 32
CHUNK = 100_000


def _opens(start: Column, previous_end: Column, gap_days: int) -> Column:
    """A new episode starts after a gap, or when no earlier end is known."""
    return F.coalesce(
        previous_end.isNull() | (start > F.date_add(previous_end, gap_days)), F.lit(False)
    )


def number_intervals(intervals: DataFrame, keys: Sequence[str], start: str, end: str, copies: str = "copies",
                     gap_days: int = 1, mode: str = "lag", tie: Sequence[str] = ()) -> DataFrame:
    """Episode number and overlap class of distinct intervals.

    ``mode='lag'`` compares with the end of the previous row; ``'running_max'`` with the
    latest end so far, which also merges an interval contained in an earlier long one.
    Further copies of an interval normally overlap their first copy perfectly; where
    even a copy opens an episode (no end, or an end before the start), every copy does,
    and ``episode`` is the number of the first of them.
    """
    ordered = Window.partitionBy(*keys).orderBy(start, end, *tie)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    s, e = F.col(start), F.col(end)
    if mode == "lag":
        previous_end = F.lag(end).over(ordered)
        copy_previous = e
    elif mode == "running_max":
        previous_end = F.max(end).over(before)
        copy_previous = F.greatest(F.col("__prev_end"), e)
    else:
        raise ValueError("mode is 'lag' or 'running_max'")

    seen = intervals.select(
        "*",
        F.lag(start).over(ordered).alias("__prev_start"),
        previous_end.alias("__prev_end"),
        F.row_number().over(ordered).alias("__row"),
    )
    opens = _opens(s, F.col("__prev_end"), gap_days)
    copies_open = _opens(s, copy_previous, gap_days)
    prev_start, prev_end = F.col("__prev_start"), F.col("__prev_end")
    touches = s <= F.date_add(prev_end, gap_days)
    label = (
        F.when(F.col("__row") == 1, codes.OVERLAP_LABELS["first"])
        .when(opens, codes.OVERLAP_LABELS["new"])
        .when(touches & (e > prev_end), codes.OVERLAP_LABELS["regular"])
        .when((s == prev_start) & (e < prev_end), codes.OVERLAP_LABELS["same_start"])
        .when((s > prev_start) & (e < prev_end), codes.OVERLAP_LABELS["embedded"])
        .when((s == prev_start) & (e == prev_end), codes.OVERLAP_LABELS["perfect"])
    )
    flagged = seen.select(
        *intervals.columns,
        opens.cast("long").alias("__opens"),
        F.when(copies_open, F.col(copies) - 1).otherwise(0).alias("__extra"),
        copies_open.alias("copies_open"),
        label.alias("overlap"),
        F.when(copies_open, codes.OVERLAP_LABELS["new"])
        .otherwise(codes.OVERLAP_LABELS["perfect"]).alias("copy_overlap"),
    )
    through = ordered.rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum(F.col("__opens") + F.col("__extra")).over(through)
    return flagged.select("*", (last - F.col("__extra")).alias("episode")).drop("__opens", "__extra")


def episodes(df: DataFrame, keys: Sequence[str], start: str, end: str, gap_days: int = 1, mode: str = "lag",
             salts: int = SALTS) -> DataFrame:
    """Every row with its ``episode`` number and ``overlap`` class.

    Equal rows are first combined to one row with a count, map-side, so a third of all rows
    in one interval is no group of rows anywhere; different rows of one interval spread over
    ``salts`` tasks by a hash of the row. The position of a row among equal intervals comes from per-salt
    counts plus a running count inside its salt. Rows are told apart again at the end, a bounded
    number at a time.
    """
    interval = [*keys, start, end]
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    salted = rows.withColumn("__hash", F.xxhash64(*df.columns)).withColumn(
        "__salt", F.pmod("__hash", F.lit(salts)).cast("int")
    )
    per_salt = salted.groupBy(*interval, "__salt").agg(F.sum("__n").alias("__in_salt"))
    distinct = per_salt.groupBy(*interval).agg(F.sum("__in_salt").alias("copies"))
    numbered = number_intervals(distinct, keys, start, end, "copies", gap_days, mode)

    before = Window.unboundedPreceding
    spread = Window.partitionBy(*interval).orderBy("__salt").rowsBetween(before, -1)
    offsets = per_salt.withColumn("__offset", F.coalesce(F.sum("__in_salt").over(spread), F.lit(0)))
    lookup = _null_safe_join(offsets, numbered, interval, ["copies_open", "overlap", "copy_overlap", "episode"])
    joined = _null_safe_join(
        salted, lookup, [*interval, "__salt"],
        ["__offset", "copies_open", "overlap", "copy_overlap", "episode"],
    )
    local = Window.partitionBy(*interval, "__salt").orderBy("__hash").rowsBetween(before, -1)
    first = F.col("__offset") + F.coalesce(F.sum("__n").over(local), F.lit(0))
    placed = _explode_range(joined.withColumn("__first", first), "__copy", F.col("__first") + 1, F.col("__first") + F.col("__n"))
    return placed.select(
        *df.columns,
        F.when(F.col("copies_open"), F.col("episode") + F.col("__copy") - 1)
        .otherwise(F.col("episode")).cast("long").alias("episode"),
        F.when(F.col("__copy") == 1, F.col("overlap")).otherwise(F.col("copy_overlap")).alias("overlap"),
    )


def _explode_range(df: DataFrame, name: str, first: Column, last: Column, step: int = CHUNK) -> DataFrame:
    """One row per number from ``first`` to ``last``; no array is longer than ``step`` but for the list of its starts."""
    starts = df.withColumn("__last", last).withColumn("__at", F.explode(F.sequence(first, F.col("__last"), F.lit(step).cast("long"))))
    ends = F.least(F.col("__at") + step - 1, F.col("__last"))
    return starts.withColumn(name, F.explode(F.sequence("__at", ends))).drop("__last", "__at")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], added: Sequence[str]) -> DataFrame:
    """Inner equi-join in which null keys match; keeps the left columns and ``added``."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *added)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, same, "inner").select(*left.columns, *added)


def episode_rollup(df: DataFrame, keys: Sequence[str], start: str, end: str, flags: Sequence[str] = (),
                   gap_days: int = 1, mode: str = "lag") -> DataFrame:
    """One row per episode: earliest start, latest end and the max of each flag.

    Flags are combined to distinct intervals before numbering, so rows are shuffled
    once and never joined back. Copies of an interval that open an episode each (no
    end, or an end before the start) must keep their own flags; they are combined only
    with copies of equal flags and then spread over their episode numbers, in bounded pieces.
    """
    standalone = F.col(end).isNull() | (F.col(start) > F.date_add(end, gap_days))
    tie = F.when(standalone, F.concat_ws("|", *[F.col(f).cast("string") for f in flags]))
    distinct = df.withColumn("__tie", tie).groupBy(*keys, start, end, "__tie").agg(
        F.count("*").alias("copies"), *[F.max(f).alias(f) for f in flags]
    )
    numbered = number_intervals(distinct, keys, start, end, "copies", gap_days, mode, tie=["__tie"])
    ranged = numbered.withColumnRenamed("episode", "__from").withColumn(
        "__to", F.col("__from") + F.when(F.col("copies_open"), F.col("copies") - 1).otherwise(0))
    each = _explode_range(ranged, "episode", F.col("__from"), F.col("__to"))
    return each.groupBy(*keys, "episode").agg(
        F.min(start).alias(start), F.max(end).alias(end), *[F.max(f).alias(f) for f in flags],
    )


def overlap_report(df: DataFrame, keys: Sequence[str], start: str, end: str, gap_days: int = 1,
                   mode: str = "lag") -> DataFrame:
    """Rows per overlap class, straight from the distinct intervals."""
    distinct = df.groupBy(*keys, start, end).agg(F.count("*").alias("copies"))
    numbered = number_intervals(distinct, keys, start, end, "copies", gap_days, mode)
    parts = F.array(
        F.struct(F.col("overlap").alias("overlap"), F.lit(1).cast("long").alias("rows")),
        F.struct(F.col("copy_overlap").alias("overlap"), (F.col("copies") - 1).alias("rows")),
    )
    return numbered.select(F.inline(parts)).where(F.col("rows") > 0).groupBy("overlap").agg(F.sum("rows").alias("n"))


def stay_totals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap_days: int = 1,
                mode: str = "lag") -> DataFrame:
    """Episodes and days of stay (last end minus first start) per member."""
    merged = episode_rollup(df, keys, start, end, (), gap_days, mode)
    return merged.groupBy(*keys).agg(
        F.count("*").alias("episodes"),
        F.sum(F.datediff(end, start)).cast("long").alias("stay_days"),
    )
