"""Second-order boosting against a plain recursive fit, and by hand."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.operators import boost


def plain(rows, y, s, cuts, keys, drawn):
    """The same trees, one node at a time over lists."""
    bins = [[0 if v in (None, 0.0) or math.isnan(v) else 1 + sum(c < v for c in cuts[i]) for i, v in enumerate(r)] for r in rows]
    mean = sum(y) / len(y)
    margins = [math.log(mean / (1 - mean)) if s.logistic else mean] * len(rows)
    shrink = lambda g: math.copysign(max(abs(g) - s.alpha, 0), g)
    score = lambda g, h: shrink(g) ** 2 / (h + s.lambda_) if h + s.lambda_ > 0 else 0.0

    def build(members, level, number, g, h):
        G, H = sum(g[i] for i in members), sum(h[i] for i in members)
        node = {"value": -shrink(G) / (H + s.lambda_) if H + s.lambda_ > 0 else 0.0}
        best = None
        if level < s.depth:
            for f in boost.columns_of(number, level, len(cuts), s):
                for b in range(1, boost.BINS + 1):
                    for side in (True, False):
                        low = [i for i in members if (side if bins[i][f] == 0 else bins[i][f] <= b)]
                        if not low or len(low) == len(members):
                            continue
                        gl, hl = sum(g[i] for i in low), sum(h[i] for i in low)
                        if hl < s.child or H - hl < s.child:
                            continue
                        gain = score(gl, hl) + score(G - gl, H - hl) - score(G, H)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, f, b, side, low)
        if best and best[0] > boost.LEAST_GAIN:
            inside = set(best[4])
            kids = [build(m, level + 1, number, g, h) for m in (best[4], [i for i in members if i not in inside])]
            if best[0] >= s.gamma or any("kids" in k for k in kids):
                node |= {"split": best[1:4], "kids": kids}
        return node

    def value(node, row):
        while "kids" in node:
            f, b, side = node["split"]
            node = node["kids"][0 if (side if row[f] == 0 else row[f] <= b) else 1]
        return node["value"]

    for number in range(s.trees):
        p = [1 / (1 + math.exp(-m)) for m in margins] if s.logistic else margins
        g = [a - b for a, b in zip(p, y)]
        h = [a * (1 - a) for a in p] if s.logistic else [1.0] * len(y)
        members = [i for i, k in enumerate(keys) if drawn(k, number)]
        tree = build(members, 0, number, g, h)
        margins = [m + s.step * value(tree, r) for m, r in zip(margins, bins)]
    return [1 / (1 + math.exp(-m)) for m in margins] if s.logistic else margins


def table(spark, logistic):
    draw = np.random.default_rng(8)
    rows = []
    for i in range(160):
        x = [round(float(draw.normal()), 2), float(draw.integers(0, 2)), float(draw.integers(0, 5)), None if i % 11 == 0 else round(float(draw.random()), 2)]
        y = x[0] * 3 + x[1] * 2 - (x[2] == 3) * 4 + draw.normal()
        rows.append((i, *x, float(y > 0) if logistic else round(float(y), 3)))
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, y double").repartition(3), rows


CASES = [
    boost.Settings(trees=2, depth=3, lambda_=1.0), boost.Settings(trees=2, depth=4, lambda_=0.25, alpha=0.5, gamma=0.4, step=0.3),
    boost.Settings(trees=2, depth=3, subsample=0.6, by_level=0.5, child=1.5, logistic=False, lambda_=0.5),
    boost.Settings(trees=1, depth=2, by_tree=0.5, logistic=False, gamma=5.0, lambda_=0.0),
]


@pytest.mark.parametrize("case, local", [(0, 0), (1, 8192), (1, 40), (2, 40), (3, 0)])
def test_trees_are_those_of_a_plain_fit(spark, case, local):
    s = CASES[case]
    df, rows = table(spark, s.logistic)
    columns = ["a", "b", "c", "d"]
    model = boost.fit(df, "id", "y", columns, s, local=local)
    kept = defaultdict(set)
    for n in range(s.trees):
        hit = df.select("id").where(boost.below(boost.word(F.col("id"), f"{s.salt}|{n}"), s.subsample)).collect() if s.subsample < 1 else rows
        kept[n] = {r[0] for r in hit}
    want = plain([r[1:5] for r in rows], [r[5] for r in rows], s, model.cuts, [r[0] for r in rows], lambda k, n: k in kept[n])
    got = {r["key"]: r["prediction"] for r in boost.predict(model, df, "id", "y").collect()}
    np.testing.assert_allclose([got[r[0]] for r in rows], want, rtol=1e-9, atol=1e-9)
    assert any(f >= 0 for t in model.trees for f in t.feature)


def test_edges(spark):
    df, _ = table(spark, True)
    none = boost.fit(df.where("false"), "id", "y", ["a"], CASES[0])
    assert none.trees == [] and boost.predict(none, df, "id", "y").agg(F.min("prediction"), F.max("prediction")).first() == (0.5, 0.5)
    same = boost.fit(df.withColumn("y", F.lit(1.0)).withColumn("z", F.lit(0.0)), "id", "y", ["z"], CASES[0])
    assert all(t.feature == [-1] for t in same.trees)
    unlabelled = df.withColumn("y", F.when(F.col("id") > 5, F.col("y")))
    assert boost.predict(boost.fit(unlabelled, "id", "y", ["a"], CASES[0]), df, "id", "y", ["b"]).columns == ["b", "key", "y", "prediction"]
    assert boost.importance(boost.fit(df, "id", "y", ["a", "b"], CASES[0]))[0][1] > 0


def test_scoring_sends_arrays_made_once():
    """Tasks get each tree as arrays, not as lists that every batch turns into arrays; nothing sent names this package."""
    import pickle

    rng = np.random.default_rng(3)
    bins = rng.integers(0, 4, (500, 2)).astype(np.uint8)
    tree = boost.Tree()
    tree.leaf(0.5)
    low, high = tree.split(0, 0, 1, True, 1.0, 2.0, 3.0)
    tree.split(high, 1, 2, False, 1.0, 5.0, 7.0)
    model = boost.Model(["a", "b"], [np.arange(2.0)] * 2, boost.Settings(step=0.5), 1.0, [tree, tree])
    steps = model.steps()
    assert all(isinstance(x, np.ndarray) for arrays, values in steps for x in (*arrays, values))
    assert b"cohortlake" not in pickle.dumps(steps)
    plain = [1.0 + 2 * 0.5 * (2.0 if a <= 1 else 5.0 if 0 < b <= 2 else 7.0) for a, b in bins]
    assert boost.margins(model.base, steps, bins).tolist() == plain == model.margins(bins).tolist()


def test_draws_in_memory_are_those_of_the_filter(spark):
    s = boost.Settings(subsample=0.4, salt="d")
    keys = [None, *range(-3, 300)]
    kept = spark.createDataFrame([(k,) for k in keys], "key bigint").where(boost.below(boost.word(F.col("key"), f"{s.salt}|7"), s.subsample)).collect()
    in_memory = boost.drawn([b"" if k is None else str(k).encode() for k in keys], 7, s)
    assert {r["key"] for r in kept} == {k for k, hit in zip(keys, in_memory) if hit} and 80 < len(kept) < 160


@pytest.mark.parametrize("case", [1, 2])
def test_a_table_fitted_in_one_task_has_the_trees_of_one_fitted_by_jobs(spark, case):
    """With keys that are null or come twice."""
    df, _ = table(spark, CASES[case].logistic)
    df = df.unionAll(df.where("id < 20")).withColumn("id", F.expr("if(id % 13 = 0, null, id)"))
    columns = ["a", "b", "c", "d"]
    one, many = (boost.fit(df, "id", "y", columns, CASES[case], local=n) for n in (None, 30))
    assert len(one.trees) == CASES[case].trees and any((t.feature >= 0).any() for t in one.trees)
    scores = [sorted(r["prediction"] for r in boost.predict(m, df, "id", "y").collect()) for m in (one, many)]
    np.testing.assert_allclose(*scores, rtol=1e-9)


def test_the_chosen_classifier_grows_all_its_trees(spark):
    """As many trees as the learner grows untold, on every column at every level."""
    df, _ = table(spark, True)
    s = boost.Settings(**codes.BOOSTED_CHOSEN)
    model = boost.fit(df, "id", "y", ["a", "b", "c", "d"], s)
    assert len(model.trees) == 100 and s.by_tree == s.by_level == 1.0
    # a step of 0.005 needs them: the margins move
    assert boost.predict(model, df, "id", "y").agg(F.max("prediction") - F.min("prediction")).first()[0] > 0.3


def test_the_cost_settings_grow_all_their_trees(spark):
    df, _ = table(spark, False)
    model = boost.fit(df, "id", "y", ["a", "b", "c", "d"], boost.Settings(logistic=False, **codes.COST_BOOSTED))
    assert len(model.trees) == 100 and sum((t.feature >= 0).any() for t in model.trees) > 90
