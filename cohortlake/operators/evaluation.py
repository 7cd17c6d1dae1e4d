"""Confusion metrics, exact area under the ROC curve, regression and group metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = ["tp", "tn", "fp", "fn"]


def confusion_cells(label: str, prediction: str, weight: Column | None = None) -> list[Column]:
    """tp, tn, fp and fn as aggregates, optionally weighted."""
    y, p = F.col(label), F.col(prediction)
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    tests = {"tp": (p == 1) & (y == 1), "tn": (p == 0) & (y == 0), "fp": (p == 1) & (y == 0), "fn": (p == 0) & (y == 1)}
    return [F.sum(F.when(t, w).otherwise(0)).alias(n) for n, t in tests.items()]


def metric_columns(zero: float | None = None) -> dict[str, Column]:
    """Metrics of the four cells. ``zero`` replaces a ratio with an empty denominator;
    the correlation coefficient is 0 there by definition."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in CELLS)

    def ratio(top: Column, bottom: Column) -> Column:
        value = F.try_divide(top, bottom)
        return value if zero is None else F.coalesce(value, F.lit(zero))

    margin = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "sensitivity": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp),
        "ppv": ratio(tp, tp + fp),
        "npv": ratio(tn, tn + fn),
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, margin), F.lit(0.0)),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def confusion_metrics(df: DataFrame, label: str, prediction: str, group: Sequence[str] = (),
                      zero: float | None = None, digits: int = 6) -> DataFrame:
    """The four cells and all metrics in one aggregate, overall or per group."""
    cells = df.groupBy(*group).agg(*confusion_cells(label, prediction))
    rounded = {n: F.round(c, digits) for n, c in metric_columns(zero).items()}
    return cells.select(*group, *CELLS, *[c.alias(n) for n, c in rounded.items()])


def fan_out_for(rows: int, per_bucket: int = 4_000_000) -> int:
    """``fan_out`` for :func:`score_bounds` such that a bucket holds about ``per_bucket`` scores."""
    return max(16, math.ceil(math.sqrt(rows / per_bucket)))


def score_bounds(df: DataFrame, score: str, fan_out: int = 16) -> Column:
    """Bounds cutting the rows into ``fan_out`` squared parts of about equal size by score, as
    a scalar subquery: coarse bounds, and for each coarse part its fine bounds. Their number
    is fixed by ``fan_out``, and the sketch behind them needs no shuffle of rows.
    A score shared by many rows only makes some parts empty."""
    parts = fan_out * fan_out
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    bounds = df.agg(F.percentile_approx(score, steps, max(2_000, 8 * parts)).alias("b"))
    coarse = F.array(*[F.col("b")[fan_out * i - 1] for i in range(1, fan_out)])
    fine = F.array(*[F.slice("b", fan_out * i + 1, fan_out - 1) for i in range(fan_out)])
    return bounds.select(F.struct(coarse.alias("coarse"), fine.alias("fine"))).scalar()


def auc_from_counts(counts: DataFrame, score: str, bounds: Column, group: Sequence[str] = (),
                    positives: str = "pos", negatives: str = "neg") -> DataFrame:
    """Exact AUC from positive and negative counts per distinct score.

    A single ordered window over all scores would run in one task. Scores are split at
    ``bounds`` instead: ranks inside a bucket come from a window on (group, bucket), and
    the negatives below a bucket from a window over the few bucket totals. Ties count half.
    """

    def wide(value: Column) -> Column:
        return value.cast("decimal(19,0)")

    def passed(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < F.col(score)))

    bucketed = (
        counts.withColumn("__bounds", bounds)
        .withColumn("__part", passed(F.col("__bounds.coarse")))
        .withColumn("__bucket", F.struct("__part", passed(F.col("__bounds.fine")[F.col("__part")]).alias("fine")))
        .drop("__bounds", "__part")
    )
    inside = Window.partitionBy(*group, "__bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = bucketed.withColumn("__below", F.coalesce(F.sum(negatives).over(inside), F.lit(0)))
    totals = ranked.groupBy(*group, "__bucket").agg(
        F.sum(positives).alias("p"), F.sum(negatives).alias("n"),
        F.sum(wide(F.col(positives)) * wide(2 * F.col("__below") + F.col(negatives))).alias("u2"),
    )
    lower = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("__before", F.coalesce(F.sum("n").over(lower), F.lit(0)))
    wins = F.sum(F.col("u2").cast("double") + (wide(2 * F.col("p")) * wide(F.col("__before"))).cast("double"))
    pairs = F.sum("p").cast("double") * F.sum("n").cast("double")
    return placed.groupBy(*group).agg(
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"),
        F.try_divide(wins, 2 * pairs).alias("auc"),
    )


def auc_rank(df: DataFrame, score: str, label: str, fan_out: int | None = None) -> DataFrame:
    """Exact AUC of one scored set; the number of buckets follows from the rows unless given."""
    fan_out = fan_out or fan_out_for(df.count())
    counts = df.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return auc_from_counts(counts, score, score_bounds(df, score, fan_out))


def regression_sums(actual: str, predicted: str, weight: Column | None = None) -> list[Column]:
    """Sufficient sums for means, totals and R-squared."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    w = F.lit(1.0) if weight is None else weight.cast("double")
    # the variance aggregate updates around the running mean, so large means cancel nothing
    spread = F.var_pop(y) * F.count(y) if weight is None else F.sum(w * y * y) - F.try_divide(F.sum(w * y) * F.sum(w * y), F.sum(w))
    return [
        F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * p).alias("wp"),
        spread.alias("spread"), F.sum(w * (y - p) * (y - p)).alias("wee"),
        F.sum(w * F.abs(y - p)).alias("wae"),
    ]


def regression_columns() -> dict[str, Column]:
    w, wy, wp = F.col("w"), F.col("wy"), F.col("wp")
    spread = F.col("spread")
    return {
        "mean_actual": F.try_divide(wy, w),
        "mean_predicted": F.try_divide(wp, w),
        "mean_difference": F.try_divide(wy - wp, w),
        "mean_absolute_difference": F.try_divide(F.col("wae"), w),
        "total_actual": wy,
        "total_predicted": wp,
        "r2": 1 - F.try_divide(F.col("wee"), F.when(spread > 0, spread)),
    }


def regression_metrics(df: DataFrame, actual: str, predicted: str, group: Sequence[str] = (),
                       digits: int = 4) -> DataFrame:
    """Means, totals, mean differences and R-squared in one aggregate."""
    sums = df.groupBy(*group).agg(*regression_sums(actual, predicted))
    return sums.select(*group, *[F.round(c, digits).alias(n) for n, c in regression_columns().items()])


def group_residual(df: DataFrame, actual: str, predicted: str, group: str, digits: int = 4) -> DataFrame:
    """Mean of prediction minus actual per group."""
    residual = F.col(predicted).cast("double") - F.col(actual).cast("double")
    return df.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(residual), digits).alias("mean_residual"))
