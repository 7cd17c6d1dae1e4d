"""Tree nodes as a table, and grids read off one forest."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from cohortlake.operators import ml, trees


@pytest.fixture(scope="module")
def sets(spark):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(900):
        k, x, noise = draw.choice(["a", "b", "c"]), draw.normal(), draw.normal()
        rows.append((k, float(x), float(noise), 3.0, float((x > 0.3) ^ (k == "b") ^ (draw.random() < 0.15)), float(x * 5 + (k == "c"))))
    df = spark.createDataFrame(rows, "k string, x double, noise double, fixed double, label double, y double").repartition(3)
    fitted = Pipeline(stages=ml.encoder(["k"], ["x", "noise", "fixed"])).fit(df)
    encoded = fitted.transform(df).select("label", "y", ml.FEATURES).persist()
    return encoded, ml.attribute_names(encoded)


def test_forest_prefixes_are_forests(spark, sets):
    encoded, _ = sets
    model = ml.forest("label", depth=6, trees=12, leaf=2).fit(encoded)
    votes = trees.Votes(trees.tree_nodes(model, spark))
    got = {(r["depth"], r["trees"]): (r["tp"], r["tn"], r["fp"], r["fn"]) for r in trees.forest_outcomes(votes, encoded, "label", [2, 6], [1, 5, 12]).collect()}
    assert len(got) == 6

    def cells(scored):
        n = {(r["label"], r["prediction"]): r["count"] for r in scored.groupBy("label", "prediction").count().collect()}
        return tuple(n.get(k, 0) for k in ((1.0, 1.0), (0.0, 0.0), (0.0, 1.0), (1.0, 0.0)))

    assert got[6, 12] == cells(model.transform(encoded))
    assert got[6, 1] == cells(model.trees[0].transform(encoded))
    # five trees: the mean of their class shares
    shares = [{(r["label"], tuple(r["f"])): r["p"] for r in t.transform(encoded).select("label", F.col("probability").alias("f0"), ml.FEATURES).select(
        "label", ml.vector_to_array(ml.FEATURES).alias("f"), ml.vector_to_array("f0")[1].alias("p")).collect()} for t in model.trees[:5]]
    yes = {k: sum(s[k] for s in shares) > 2.5 for k in shares[0]}
    assert got[6, 5] == (sum(v and k[0] == 1 for k, v in yes.items()), sum(not v and k[0] == 0 for k, v in yes.items()),
                         sum(v and k[0] == 0 for k, v in yes.items()), sum(not v and k[0] == 1 for k, v in yes.items()))


def test_a_cut_tree_is_the_shallow_tree(spark, sets):
    """Without sampling of rows and columns, a tree cut at a depth is the tree fitted to that depth."""
    encoded, _ = sets
    deep = ml.forest("label", depth=7, trees=1, subset="all", bagging=False).fit(encoded)
    votes = trees.Votes(trees.tree_nodes(deep, spark))
    got = {r["depth"]: (r["tp"], r["fp"]) for r in trees.forest_outcomes(votes, encoded, "label", [1, 3, 7], [1]).collect()}
    for depth in (1, 3, 7):
        scored = ml.forest("label", depth=depth, trees=1, subset="all", bagging=False).fit(encoded).transform(encoded).where("prediction = 1")
        assert got[depth] == (scored.where("label = 1").count(), scored.where("label = 0").count())


@pytest.mark.parametrize("kind", ["forest", "boosted", "regressor"])
def test_gains_give_the_importances(spark, sets, kind):
    encoded, names = sets
    learner = {
        "forest": ml.forest("label", depth=5, trees=6), "boosted": ml.boosted_classifier("label", depth=3, trees=4),
        "regressor": ml.boosted_regressor("y", depth=3, trees=4),
    }[kind]
    model = learner.fit(encoded)
    nodes = trees.tree_nodes(model, spark)
    got = {r["feature"]: r["importance"] for r in trees.gain_importance(nodes, names, by_tree=True).collect()}
    want = dict(zip(names, model.featureImportances.toArray()))
    if kind == "forest":
        assert got == pytest.approx({k: v for k, v in want.items() if v > 0}, abs=1e-9)
    else:
        assert set(got) == {k for k, v in want.items() if v > 0}
        plain = {r["feature"]: r["importance"] for r in trees.gain_importance(nodes, names, by_tree=False).collect()}
        assert plain == pytest.approx({k: v for k, v in want.items() if v > 0}, abs=1e-9)
    assert {r["feature"] for r in trees.unused(nodes, names).collect()} == {k for k, v in want.items() if v == 0}
    assert "fixed" in {r["feature"] for r in trees.unused(nodes, names).collect()}


def test_search_covers_the_grid(sets):
    encoded, _ = sets
    axes = {"leaf": [1, 30], "subset": ["auto", "sqrt", "log2"], "depth": [2, 5], "trees": [3, 8]}
    points = trees.search_forests(encoded, encoded, "label", axes).collect()
    assert len(points) == 24 and all(p["mcc"] is not None for p in points)
    by = {tuple(p)[:4]: p["mcc"] for p in points}
    assert all(by[leaf, "auto", d, t] == by[leaf, "sqrt", d, t] for leaf in (1, 30) for d in (2, 5) for t in (3, 8))
    best = trees.best_point(encoded.sparkSession.createDataFrame(points))
    assert best["mcc"] == max(by.values())
