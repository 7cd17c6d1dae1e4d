"""A grid of penalised logistic fits against Spark's own learner."""

import numpy as np
import pytest
from pyspark.ml import Pipeline

from cohortlake.operators import ml, penalised


@pytest.fixture(scope="module")
def encoded(spark):
    draw = np.random.default_rng(12)
    rows = []
    for _ in range(700):
        k, a, b = draw.choice(["x", "y", "z"]), draw.normal(), draw.normal() * 50 + 300
        logit = a - 0.02 * (b - 300) + (k == "x") * 1.5 - 0.5
        rows.append((str(k), float(a), float(b), float(draw.normal()), 2.0, float(draw.random() < 1 / (1 + np.exp(-logit)))))
    df = spark.createDataFrame(rows, "k string, a double, b double, noise double, fixed double, label double").repartition(3)
    return Pipeline(stages=ml.encoder(["k"], ["a", "b", "noise", "fixed"])).fit(df).transform(df).select("label", ml.FEATURES).persist()


def objective(x, y, constant, b, reg, mix):
    eta = constant + x @ b
    scaled = b * x.std(axis=0, ddof=1)
    return (np.logaddexp(0, eta) - y * eta).mean() + reg * (mix * np.abs(scaled).sum() + (1 - mix) / 2 * (scaled**2).sum())


def test_all_points_equal_sparks_fits(encoded):
    """Spark's fits stop at a tolerance: close to ours, and never better."""
    rows = encoded.select("label", ml.vector_to_array(ml.FEATURES).alias("x")).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    points = ml.grid(reg=[0.01, 0.2], mix=[0.0, 0.4, 1.0])
    found, passes = penalised.fit_grid(penalised.vectors(encoded, "label"), points)
    assert passes < 30
    for point, b in zip(points, found):
        model = ml.logistic("label", tol=1e-10, maxIter=150, **point).fit(encoded)
        np.testing.assert_allclose(b[1:], model.coefficients.toArray(), atol=1e-4)
        theirs = objective(x, y, model.intercept, model.coefficients.toArray(), **point)
        assert theirs - 1e-7 <= objective(x, y, b[0], b[1:], **point) <= theirs + 1e-10
    largest, _ = penalised.fit_grid(penalised.vectors(encoded, "label"), [{"reg": 1.0, "mix": 1.0}])
    # nothing but the constant is left at a large lasso penalty
    assert np.abs(largest[0][1:]).max() == 0


def test_outcomes_and_choice(encoded):
    points = ml.grid(reg=[0.01, 100.0], mix=[0.5, 1.0])
    chosen, values = penalised.choose(encoded, encoded, "label", points)
    model = ml.logistic("label", tol=1e-9, maxIter=150, reg=0.01, mix=0.5).fit(encoded)
    assert values[0] == pytest.approx(ml.mcc_value(model.transform(encoded), "label"), abs=1e-9)
    assert chosen == points[int(np.argmax([-9 if x is None else x for x in values]))]


def test_a_separable_set_settles(spark):
    df = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "a double, label double")
    fitted = Pipeline(stages=ml.encoder([], ["a"])).fit(df).transform(df)
    found, _ = penalised.fit_grid(penalised.vectors(fitted, "label"), [{"reg": 0.0001, "mix": 0.0}, {"reg": 0.0001, "mix": 1.0}])
    assert np.isfinite(found).all() and (found[:, 1] > 0).all()
