"""Metrics, samples and bootstrap intervals."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from cohortlake.operators import bootstrap, evaluation, sampling


def scored(spark, seed=5, n=400, ties=20):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(2), float(rng.randrange(ties)), rng.randrange(2)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, score double, prediction int")


@pytest.mark.parametrize("ties", [3, 20, 100000])
def test_auc_equals_evaluator(spark, ties):
    df = scored(spark, ties=ties)
    ours = evaluation.auc_rank(df, "score", "label", fan_out=4).first().auc
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_auc_without_positives(spark):
    assert evaluation.auc_rank(spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, label int"), "score", "label").first().auc is None


def test_metrics_with_empty_denominators(spark):
    none = evaluation.confusion_metrics(spark.createDataFrame([(0, 0), (0, 0)], "y int, p int"), "y", "p").first()
    assert none.sensitivity is None and none.ppv is None and none.specificity == 1.0 and none.mcc == 0.0
    zero = evaluation.confusion_metrics(spark.createDataFrame([(0, 0)], "y int, p int"), "y", "p", zero=0.0).first()
    assert zero.sensitivity == 0.0 and zero.f1 == 0.0


def test_metrics_values(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4
    m = evaluation.confusion_metrics(spark.createDataFrame(rows, "y int, p int"), "y", "p").first()
    assert (m.tp, m.fp, m.fn, m.tn) == (3, 1, 2, 4)
    assert (m.sensitivity, m.specificity, m.ppv, m.npv, m.accuracy) == (0.6, 0.8, 0.75, 0.666667, 0.7)
    assert m.f1 == round(2 * 0.75 * 0.6 / 1.35, 6) and m.mcc == round(10 / (4 * 5 * 5 * 6) ** 0.5, 6)


def test_r2_equals_evaluator(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.gauss(5, 2), rng.gauss(5, 2)) for _ in range(200)], "y double, prediction double")
    theirs = RegressionEvaluator(labelCol="y", metricName="r2").evaluate(df)
    assert evaluation.regression_metrics(df, "y", "prediction", digits=9).first().r2 == pytest.approx(theirs, abs=1e-8)


def test_split_is_disjoint_whole_and_stable(spark):
    people = spark.range(3000).withColumnRenamed("id", "member")
    split = sampling.hash_split(people, ["member"], {"a": 0.5, "b": 0.3, "c": 0.2}, "s")
    sizes = {r.part: r.n for r in split.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 3000
    assert abs(sizes["a"] - 1500) < 150 and abs(sizes["c"] - 600) < 120
    again = sampling.hash_split(people.repartition(7), ["member"], {"a": 0.5, "b": 0.3, "c": 0.2}, "s")
    assert split.exceptAll(again).count() == 0


def test_downsample_keeps_other_strata_and_nulls(spark):
    df = spark.createDataFrame([(i, ["x", "y", None][i % 3]) for i in range(3000)], "id long, g string")
    kept = {r.g: r.n for r in sampling.downsample(df, ["id"], "g", {"x": 0.2}, "s").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert kept["y"] == 1000 and kept[None] == 1000 and abs(kept["x"] - 200) < 50


def test_sample_to_size(spark):
    assert abs(sampling.sample_to_size(spark.range(5000), ["id"], 1000, "s").count() - 1000) < 120


def test_replicate_counts_have_the_right_law(spark):
    """Weights of (row, replicate): Poisson with replacement, 0 or 1 without, and independent between replicates."""
    n, replicates, fraction = 2000, 20, 0.5
    for again in (True, False):
        drawn = bootstrap.weighted_replicates(spark.range(n), F.col("id"), replicates, fraction, "s", with_replacement=again)
        weights = np.zeros((n, replicates))
        for r in drawn.groupBy("id", "replicate").agg(F.sum("weight").alias("w")).collect():
            weights[r.id, r.replicate] = r.w
        for k in range(4):
            share = math.exp(-fraction) * fraction**k / math.factorial(k) if again else {0: 1 - fraction, 1: fraction}.get(k, 0)
            assert abs((weights == k).mean() - share) < 0.01, (again, k)
        assert np.abs(weights.mean(0) - fraction).max() < 0.07
        pairs = np.corrcoef(weights.T)
        assert np.abs(pairs - np.eye(replicates)).max() < 0.11
    same = [bootstrap.weighted_replicates(spark.range(50).repartition(k), F.col("id"), 30, 0.1, "s") for k in (1, 7)]
    assert same[0].exceptAll(same[1]).count() == 0 and same[0].count() == same[1].count()


def test_rows_without_hits_are_not_carried(spark):
    drawn = bootstrap.weighted_replicates(spark.range(3000), F.col("id"), 1000, 0.002, "s")
    assert abs(drawn.count() - 6000) < 400
    missed = spark.range(3000).join(drawn, "id", "left_anti").count()
    assert abs(missed / 3000 - math.exp(-2)) < 0.03
    with pytest.raises(ValueError):
        bootstrap.weighted_replicates(spark.range(3), F.col("id"), 10, 1.0, "s", with_replacement=False)


def test_cell_and_row_bootstrap_agree(spark):
    df = scored(spark, n=2000)
    rows = {r.metric: r for r in bootstrap.bootstrap_ci(df, F.col("id"), "label", "prediction", "score", 400, 0.2, "s").collect()}
    by_cell = bootstrap.bootstrap_cells_ci(df, "label", "prediction", F.col("score"), 400, 0.2, 42)
    got = {c.metric: c for c in by_cell.collect()}
    assert set(got) == {*bootstrap.CLASSIFICATION, "auc"}
    for name in ("sensitivity", "specificity", "f1", "auc"):
        assert got[name]["mean"] == pytest.approx(rows[name]["mean"], abs=0.01)
        assert got[name].upper - got[name].lower == pytest.approx(rows[name].upper - rows[name].lower, rel=0.3)


def test_cell_draws_repeat(spark):
    cells = spark.createDataFrame([(0, 500), (1, 300)], "label int, n long")
    draws = [bootstrap.cell_replicates(cells.repartition(k), ["label"], "n", 50, 0.5, 7) for k in (1, 5)]
    assert draws[0].exceptAll(draws[1]).count() == 0
    assert draws[0].count() == 100
    once = bootstrap.cell_replicates(cells, ["label"], "n", 50, 0.5, 7, with_replacement=False)
    assert once.agg(F.max("weight")).first()[0] <= 500


def test_bootstrap_of_one_class(spark):
    df = spark.createDataFrame([(i, 1, float(i), 1) for i in range(30)], "id long, label int, score double, prediction int")
    got = {r.metric: r for r in bootstrap.bootstrap_ci(df, F.col("id"), "label", "prediction", "score", 40, 0.5, "s").collect()}
    assert got["sensitivity"]["mean"] == 1.0 and got["specificity"]["mean"] is None and got["auc"]["mean"] is None
