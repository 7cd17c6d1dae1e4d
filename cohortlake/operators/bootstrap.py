"""Bootstrap intervals in one job.

A replicate gives each row a weight: Poisson for sampling with replacement, Bernoulli
for sampling without. No replicate that misses a row is looked at: the hits of a row over all replicates are
one Poisson count, and given that count each hit falls on any replicate alike. So a row costs its hits
(fraction x replicates on average), drawn from hashes of (row key, salt, hit), and these are added up
map-side into the few cells a metric needs. All replicates of all groups are one aggregation.

``cell_replicates`` is the form for very large scored sets: independent Poisson weights
add up to a Poisson count, so one draw per (replicate, cell) has the same law as a draw
per row and costs replicates x cells, not replicates x rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.hashing import digest, poisson_levels, word, word_as_number
from cohortlake.operators.evaluation import (
    CELLS, auc_from_counts, confusion_cells, metric_columns, regression_columns, regression_sums, score_bounds,
)

CLASSIFICATION = ["sensitivity", "specificity", "ppv", "npv", "accuracy", "mcc", "f1"]
WORDS_PER_DIGEST = 4


def hit_rate(fraction: float, with_replacement: bool) -> float:
    """Expected hits of a row in one replicate. Without replacement a row is in if it is hit at all, so that
    1 - exp(-rate) is the fraction."""
    return fraction if with_replacement else -math.log1p(-fraction)


def weighted_replicates(df: DataFrame, key: Column, replicates: int, fraction: float, salt: str,
                        with_replacement: bool = True) -> DataFrame:
    """The rows of every replicate, each with ``weight`` 1; with replacement a row may be in one several times.

    One md5 digest holds four words and serves four consecutive hits. The rows are spread
    over the cluster first: each of them becomes many, so even a set that fits one file
    is worth one small shuffle.
    """
    if not with_replacement and fraction >= 1:
        raise ValueError("a fraction below 1 is needed to sample without replacement")
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # words are compared as text; the count of levels at or below a word is the Poisson draw
    levels = F.array(*[F.lit(x) for x in poisson_levels(replicates * hit_rate(fraction, with_replacement))])
    # a lambda's argument is evaluated once, an outer expression once per level
    hits = F.transform(F.array(word(key, f"{salt}|n")), lambda first: F.size(F.filter(levels, lambda level: level <= first)))[0]
    # neither nullable nor under an inner explode: a filter inferred from it would be pushed below the caller's
    # aggregates and draw once for every row there
    counted = df.repartition(tasks, key).withColumn("__hits", F.coalesce(hits, F.lit(0)))
    blocks = F.sequence(F.lit(0), F.expr(f"(__hits - 1) div {WORDS_PER_DIGEST}").cast("int"))

    def places(text: Column) -> list[Column]:
        return [F.shiftright(word_as_number(F.substring(text, 8 * i + 1, 8)) * replicates, 32).cast("int")
                for i in range(WORDS_PER_DIGEST)]

    if with_replacement:
        digests = counted.withColumn("__block", F.explode_outer(blocks)).withColumn(
            "__digest", digest(key, salt, F.col("__block").cast("string")))
        four = [F.struct((F.col("__block") * WORDS_PER_DIGEST + i).alias("__hit"), p.alias("replicate"))
                for i, p in enumerate(places(F.col("__digest")))]
        drawn = digests.select(*df.columns, "__hits", F.inline(F.array(*four))).where("__hit < __hits").drop("__hit", "__hits")
    else:
        texts = F.transform(blocks, lambda block: digest(key, salt, block.cast("string")))
        every = F.flatten(F.transform(texts, lambda text: F.array(*places(text))))
        drawn = counted.select(*df.columns, F.explode_outer(F.array_distinct(F.slice(every, F.lit(1), F.col("__hits")))).alias("replicate"))
        drawn = drawn.where("replicate is not null")
    return drawn.withColumn("weight", F.lit(1))


def percentile_interval(replicates: DataFrame, metrics: Sequence[str], group: Sequence[str] = (),
                        digits: int = 6) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles (linear interpolation) per metric; undefined replicates are left out."""
    long = replicates.unpivot(list(group), list(metrics), "metric", "value")
    return long.groupBy(*group, "metric").agg(
        F.round(F.avg("value"), digits).alias("mean"),
        F.percentile("value", F.array(*[F.lit(q) for q in codes.INTERVAL_95])).alias("__q"),
    ).select(
        *group, "metric", "mean",
        F.round(F.col("__q")[0], digits).alias("lower"), F.round(F.col("__q")[1], digits).alias("upper"),
    )


def normal_interval(replicates: DataFrame, metrics: Sequence[str], group: Sequence[str],
                    sample_deviation: bool = True, digits: int = 6) -> DataFrame:
    """Mean plus or minus 1.96 standard errors of the replicate mean, per group and metric.

    This is the precision of the mean over replicates, much narrower than the spread of
    the replicates themselves.
    """
    deviation = F.stddev_samp("value") if sample_deviation else F.stddev_pop("value")
    long = replicates.unpivot(list(group), list(metrics), "metric", "value")
    stats = long.groupBy(*group, "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), deviation.alias("sd")
    )
    half = codes.NORMAL_95 * F.try_divide(F.col("sd"), F.sqrt("n"))
    return stats.select(
        *group, "metric", F.round("m", digits).alias("mean"),
        F.round(F.col("m") - half, digits).alias("lower"), F.round(F.col("m") + half, digits).alias("upper"),
    )


def classification_replicates(weighted: DataFrame, label: str, prediction: str,
                              group: Sequence[str] = ()) -> DataFrame:
    """Weighted confusion metrics per replicate (and group)."""
    cells = weighted.groupBy("replicate", *group).agg(*confusion_cells(label, prediction, F.col("weight")))
    return cells.select("replicate", *group, *CELLS, *[c.alias(n) for n, c in metric_columns().items()])


def auc_replicates(weighted: DataFrame, scored: DataFrame, score: str, label: str) -> DataFrame:
    """Exact weighted AUC per replicate; bucket bounds come from the unweighted scores."""
    w = F.col("weight").cast("long")
    counts = weighted.groupBy("replicate", score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("neg"),
    )
    return auc_from_counts(counts, score, score_bounds(scored, score, 8), ["replicate"])


def bootstrap_ci(scored: DataFrame, key: Column, label: str, prediction: str, score: str, replicates: int,
                 fraction: float, salt: str) -> DataFrame:
    """Percentile intervals of the classification metrics and AUC."""
    narrow = scored.select(key.cast("string").alias("__key"), label, prediction, score)
    drawn = weighted_replicates(narrow, F.col("__key"), replicates, fraction, salt)
    # both kinds of metric read this one aggregate, whose shuffle they share
    weighted = drawn.groupBy("replicate", score, label, prediction).agg(F.sum("weight").alias("weight"))
    metrics = percentile_interval(classification_replicates(weighted, label, prediction), CLASSIFICATION)
    auc = percentile_interval(auc_replicates(weighted, narrow, score, label), ["auc"])
    return metrics.unionByName(auc)


def bootstrap_regression_ci(scored: DataFrame, key: Column, actual: str, predicted: str, replicates: int,
                            fraction: float, salt: str, with_replacement: bool = True,
                            digits: int = 4) -> DataFrame:
    """Percentile intervals of mean actual, predicted, difference and R-squared."""
    weighted = weighted_replicates(
        scored.select(key.cast("string").alias("__key"), actual, predicted), F.col("__key"), replicates, fraction,
        salt, with_replacement,
    )
    sums = weighted.groupBy("replicate").agg(*regression_sums(actual, predicted, F.col("weight")))
    values = sums.select("replicate", *[c.alias(n) for n, c in regression_columns().items()])
    return percentile_interval(
        values, ["mean_actual", "mean_predicted", "mean_difference", "r2"], digits=digits
    )


def group_residual_replicates(weighted: DataFrame, actual: str, predicted: str, group: str) -> DataFrame:
    """Weighted mean of prediction minus actual per replicate and group."""
    w = F.col("weight").cast("double")
    residual = F.col(predicted).cast("double") - F.col(actual).cast("double")
    return weighted.groupBy("replicate", group).agg(
        F.try_divide(F.sum(w * residual), F.sum(w)).alias("mean_residual")
    )


def cell_replicates(cells: DataFrame, cell: Sequence[str], count: str, replicates: int, fraction: float,
                    seed: int, with_replacement: bool = True) -> DataFrame:
    """Replicated counts of aggregated cells: one draw per replicate and cell.

    Cells are sorted within their replicate and drawn a batch at a time by a generator keyed by
    (seed, replicate, first cell), so a retried task repeats the same numbers.
    """
    grid = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn(
        "__stream", F.xxhash64("replicate", *cell)
    )
    # cells are few and replicates many: spread the draws
    spread = grid.repartition("replicate").sortWithinPartitions("replicate", *cell)
    schema = spread.drop("__stream", count).schema.add("weight", "long")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weights = np.empty(len(batch), dtype="int64")
            counts = batch[count].to_numpy("int64")
            for rows in batch.groupby("replicate", sort=False).indices.values():
                stream = int(batch["__stream"].iloc[rows[0]]) & (2**64 - 1)
                rng = np.random.Generator(np.random.Philox(key=[seed, stream]))
                weights[rows] = rng.poisson(counts[rows] * fraction) if with_replacement else rng.binomial(counts[rows], fraction)
            yield batch.drop(columns=["__stream", count]).assign(weight=weights)

    return spread.mapInPandas(draw, schema)


def bootstrap_cells_ci(scored: DataFrame, label: str, prediction: str, score_bin: Column, replicates: int,
                       fraction: float, seed: int, with_replacement: bool = True) -> DataFrame:
    """Percentile intervals from cells alone: the cost does not grow with the rows.

    Confusion metrics have exactly the law of the row bootstrap. AUC treats the scores of
    one bin as tied, so ``score_bin`` should be fine (a thousand bins of a probability).
    """
    cells = scored.groupBy(label, prediction, score_bin.alias("score_bin")).agg(F.count("*").alias("__n"))
    weighted = cell_replicates(
        cells, [label, prediction, "score_bin"], "__n", replicates, fraction, seed, with_replacement)
    metrics = percentile_interval(classification_replicates(weighted, label, prediction), CLASSIFICATION)
    auc = percentile_interval(auc_replicates(weighted, cells, "score_bin", label), ["auc"])
    return metrics.unionByName(auc)

