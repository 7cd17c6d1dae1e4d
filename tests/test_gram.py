"""Least squares from Gram matrices, against numpy and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import gram


def rows_of(n=400, seed=1):
    draw = np.random.default_rng(seed)
    a, b = draw.normal(size=n), draw.normal(size=n) * 100 + 5000
    kind = draw.choice(["x", "y", "z"], n)
    y = 3 + 2 * a - 0.01 * b + np.where(kind == "x", 7, 0) + draw.normal(size=n) * 0.1
    return a, b, kind, y


@pytest.fixture
def table(spark):
    a, b, kind, y = rows_of()
    rows = [(f"g{i % 10 // 9}", float(p), float(q), k, float(r)) for i, (p, q, k, r) in enumerate(zip(a, b, kind, y))]
    rows += [("g0", None, 1.0, "x", 1.0), ("g0", 1.0, float("nan"), "x", 1.0), ("g1", 1.0, 1.0, None, None), ("g1", 1.0, float("inf"), "x", 2.0)]
    return spark.createDataFrame(rows, "grp string, a double, b double, kind string, y double").repartition(5)


def slots(levels):
    return {**gram.dummies("kind", levels["kind"]), "a": F.col("a"), "b": F.col("b"), "twice": F.col("a") * 2}


def test_levels(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2), ("c", None), (None, 2)], "k string, n int")
    assert gram.levels_of(df, ["k", "n"]) == {"k": ["c", "a", "b"], "n": ["1", "2"]}


def test_coefficients_of_every_subset(table):
    levels = gram.levels_of(table.where("y is not null"), ["kind"])
    sums = gram.moments(gram.design(table, slots(levels), "y", ["grp"]), ["grp"])
    whole = sums["g0",] + sums["g1",]
    a, b, kind, y = rows_of()
    design = np.column_stack([np.ones(len(y)), *[kind == x for x in levels["kind"]], a, b, 2 * a]).astype(float)
    assert whole[0, 0] == len(y)
    np.testing.assert_allclose(whole, np.column_stack([design, y]).T @ np.column_stack([design, y]), rtol=1e-10)
    for columns in (None, [4], [5], [4, 5], [1, 2, 3], [1, 2, 3, 4, 5, 6], [6, 4], []):
        found = gram.solve(whole, columns)
        used = list(range(7)) if columns is None else sorted({0, *columns})
        best = np.linalg.lstsq(design[:, used], y, rcond=None)[0]
        # collinear designs have many solutions and one prediction
        np.testing.assert_allclose(design @ found, design[:, used] @ best, rtol=1e-6, atol=1e-6)
        fit = gram.fit_of(whole, found)
        missed = ((y - design @ found) ** 2).sum()
        assert abs(fit["r2"] - (1 - missed / ((y - y.mean()) ** 2).sum())) < 1e-9
        assert abs(fit["mean_predicted"] - (design @ found).mean()) < 1e-6
    full = gram.solve(whole)
    # the last dummy beside the constant, and the repeated column, are determined by earlier ones
    assert full[3] == 0 and full[6] == 0 and abs(full[4] - 2) < 0.05


def test_predictions_and_empty_groups(table):
    levels = {"kind": ["x", "y", "z"]}
    rows = gram.design(table, slots(levels), "y", ["grp"])
    b = gram.solve(gram.moments(rows, [])[()])
    scored = rows.select(F.col(gram.VECTOR), gram.prediction(F.array(*[F.lit(float(x)) for x in b])).alias("p")).collect()
    assert len(scored) == 400
    for r in scored[:50]:
        assert abs(r["p"] - float(np.dot(r["z"][:-1], b))) < 1e-9
    assert gram.moments(rows.where("false"), ["grp"]) == {}
    assert gram.fit_of(np.zeros((3, 3)), np.zeros(2))["r2"] is None
    assert list(gram.solve(np.zeros((3, 3)))) == [0, 0]


def test_one_group_may_hold_almost_all_rows(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 1000 == 0, F.lit("few")).otherwise("many").alias("grp"), (F.col("id") % 17).cast("double").alias("x"))
    sums = gram.moments(gram.design(df.withColumn("y", 3 * F.col("x") + 1), {"x": F.col("x")}, "y", ["grp"]), ["grp"])
    for name in ("few", "many"):
        np.testing.assert_allclose(gram.solve(sums[name,]), [1, 3], rtol=1e-9)
