"""Frequency tables, rates, null profiles and other one-pass summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def frequency_table(df: DataFrame, column: str, count: str = "n") -> DataFrame:
    """Counts per value, most frequent first, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias(count)).orderBy(F.desc(count), F.asc(column))


def percent_distribution(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Count and percent of all rows per value.

    The total is a scalar subquery over the counts, so the rows are aggregated once
    and never gathered in one window partition.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.round(F.col("n") / total * 100, digits))


def group_rates(df: DataFrame, dimensions: Sequence[str], flag: str, measure: str | None = None,
                digits: int = 2) -> DataFrame:
    """Members, flagged members and percent flagged, overall and by each dimension.

    GROUPING SETS gives every breakdown in one pass over the data; rows come out in
    long form as (dimension, value).
    """
    sets = [[]] + [[d] for d in dimensions]
    aggregates = [
        F.count("*").alias("members"),
        F.sum(F.col(flag).cast("long")).alias("flagged"),
    ]
    if measure:
        aggregates.append(F.round(F.avg(measure), digits).alias(f"mean_{measure}"))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *dimensions).agg(
        *aggregates, *[F.grouping(d).alias(f"__{d}") for d in dimensions]
    )
    name, value = F.lit("all"), F.lit("all")
    for d in dimensions:
        used = F.col(f"__{d}") == 0
        name = F.when(used, d).otherwise(name)
        value = F.when(used, F.col(d).cast("string")).otherwise(value)
    kept = ["members", "flagged"] + ([f"mean_{measure}"] if measure else [])
    return grouped.select(
        name.alias("dimension"), value.alias("value"), *kept,
        F.round(F.try_divide(F.col("flagged"), F.col("members")) * 100, digits).alias("percent"),
    )


def _is_missing(name: str, kind: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "") | c.contains("None") | c.contains("NULL")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_profile(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Missing count and percent for every column in one aggregate, one row per column.

    Missing means null, NaN, empty text, or text holding 'None' or 'NULL'.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    one_row = df.agg(
        F.count("*").alias("total"),
        *[F.count_if(_is_missing(c, kinds[c])).alias(c) for c in columns],
    )
    long = one_row.unpivot(["total"], list(columns), "column_name", "missing")
    return long.select(
        "column_name", "missing", "total",
        F.round(F.try_divide(F.col("missing"), F.col("total")) * 100, digits).alias("percent_missing"),
    )


def any_present_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with at least one of the columns filled, as count and percent."""
    filled = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    return df.agg(
        F.count_if(filled).alias("filled"),
        F.round(F.avg(filled.cast("double")) * 100, 4).alias("percent_filled"),
    )


def describe_numeric(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """count, mean, sample standard deviation, min and max, one row per column."""
    stats = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("n"),
            F.round(F.avg(F.col(c).cast("double")), digits).alias("mean"),
            F.round(F.stddev_samp(F.col(c).cast("double")), digits).alias("stddev"),
            F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"),
        )
        for c in columns
    ])
    return df.agg(stats.alias("stats")).select(F.inline("stats"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts.

    Each column is first reduced to its distinct values by a partial aggregate, so
    no task holds a set of values in memory.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return (
        df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
        .groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the least by ``order``, which should be a total order.

    A min over structs combines map-side, so a key holding a large share of the rows
    sends one candidate per partition instead of all of them to a window.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*keys, "__first.*").select(*df.columns)


def resolve_by_max(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Greatest value per key and column; null loses to any value."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


def distinct_events(df: DataFrame, keys: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Distinct rows of the listed columns; rows with a null in ``required`` are dropped first."""
    chosen = df.select(*keys)
    return (chosen.na.drop(subset=list(required)) if required else chosen).distinct()


def crosstab(df: DataFrame, row: str, column: str, values: Mapping[str, object]) -> DataFrame:
    """Counts of ``row`` by listed values of ``column``, zero where none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(n) for n, v in values.items()])


def pair_correlation(df: DataFrame, left: str, right: str, digits: int = 6) -> DataFrame:
    return df.agg(
        F.count("*").alias("n"),
        F.round(F.corr(F.col(left).cast("double"), F.col(right).cast("double")), digits).alias("correlation"),
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of every unordered pair of the listed columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    cells = F.array(*[
        F.struct(
            F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
            F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), digits).alias("correlation"),
        )
        for a, b in pairs
    ])
    return (
        df.agg(cells.alias("cells")).select(F.inline("cells"))
        .orderBy(F.desc(F.abs("correlation")), "feature_a", "feature_b")
    )
