"""Fitted tree ensembles as tables of nodes, and searches that read many settings off one forest.

A forest of the most trees and the greatest depth holds all smaller ones: its first t trees are a forest of t trees, and cutting
every tree at depth d gives trees of depth d, as a node's split does not depend on what lies below. One pass over the
validation rows adds up the votes tree by tree and depth by depth and counts the outcomes at every listed
(trees, depth), so a grid needs one fit per remaining setting. (A forest fitted for a smaller setting on
its own draws other rows and columns; both have the same law.)
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators import ml
from cohortlake.operators.evaluation import CELLS, metric_columns
from cohortlake.session import new_path

NODE = "nodeData"


def tree_nodes(model: Model, spark: SparkSession) -> DataFrame:
    """One row per node of a fitted ensemble: tree, node, low and high child, feature, bound, gain, rows, weight, share of class 1.

    The model is stored and its node table read back. A row goes to the low child if its value is at most the bound; splits of
    two categories are put that way. Leaves have no children and no feature.
    """
    path = new_path(spark, "trees")
    model.write().overwrite().save(path)
    raw = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    inner, split = F.col("leftChild") >= 0, F.col("split")
    values = split["leftCategoriesOrThreshold"]
    two = split["numCategories"] >= 0
    # the first of two categories goes low; where it goes right, the children change places
    swapped = two & ~F.array_contains(values, 0.0)
    left, right = F.when(inner, F.col("leftChild")), F.when(inner, F.col("rightChild"))
    counts = F.col("impurityStats")
    # variance statistics are count, sum and sum of squares; the others are a count per class
    summed = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    weight, share = (counts[0], F.lit(None).cast("double")) if model.getOrDefault("impurity") == "variance" else (
        summed, F.try_divide(F.get(counts, F.lit(1)), summed))
    return raw.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(swapped, right).otherwise(left).alias("low"),
        F.when(swapped, left).otherwise(right).alias("high"), F.when(inner, split["featureIndex"]).alias("feature"),
        F.when(inner, F.when(two, 0.5).otherwise(values[0])).alias("bound"), F.when(inner, F.col("gain")).alias("gain"),
        F.col("rawCount").alias("rows"), weight.alias("weight"), share.alias("share"), split["numCategories"].alias("categories"),
    )


def gain_importance(nodes: DataFrame, names: Sequence[str], by_tree: bool) -> DataFrame:
    """Feature, importance: gains weighted by the rows they split, as shares of their sum.

    ``by_tree`` gives every tree the same total first (forests); boosted trees add up as they are. Features without a split
    are not in the table.
    """
    gains = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    if by_tree:
        whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole"))
        gains = gains.join(whole, "tree").where("whole > 0").select("feature", (F.col("gain") / F.col("whole")).alias("gain"))
    summed = gains.groupBy("feature").agg(F.sum("gain").alias("gain"))
    total = summed.agg(F.sum("gain")).scalar()
    slots = nodes.sparkSession.createDataFrame(list(enumerate(names)), "feature int, name string")
    return summed.join(slots, "feature").select(F.col("name").alias("feature"), F.try_divide("gain", total).alias("importance"))


def unused(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Features that no tree splits on."""
    slots = nodes.sparkSession.createDataFrame(list(enumerate(names)), "slot int, feature string")
    split = nodes.where("feature is not null").select(F.col("feature").alias("slot")).distinct()
    return slots.join(split, "slot", "left_anti").select("feature")


class Votes:
    """The nodes of all trees as arrays; a leaf is its own child. As large as the model, and no larger for more rows scored."""

    def __init__(self, nodes: DataFrame):
        if not nodes.where("categories > 2").isEmpty():
            raise ValueError("encode categories as 0/1 columns")
        rows = nodes.select("tree", "node", "low", "high", "feature", "bound", "share").orderBy("tree", "node").collect()
        place = {(r["tree"], r["node"]): i for i, r in enumerate(rows)}
        child = lambda side: np.array([i if r[side] is None else place[r["tree"], r[side]] for i, r in enumerate(rows)])
        self.low, self.high = child("low"), child("high")
        self.feature = np.array([r["feature"] or 0 for r in rows])
        self.bound = np.array([np.inf if r["bound"] is None else r["bound"] for r in rows])
        self.share = np.array([r["share"] for r in rows])
        self.roots = np.array([i for i, r in enumerate(rows) if r["node"] == 0])

    def outcomes(self, x: np.ndarray, label: np.ndarray, depths: Sequence[int], trees: Sequence[int]) -> list[tuple]:
        """(depth, trees, tp, tn, fp, fn) of every listed forest on some rows; equal votes are class 0, as in Spark."""
        votes, out, deepest = np.zeros((len(depths), len(x))), [], max(depths)
        rows, good = np.arange(len(x)), label == 1
        for n, root in enumerate(self.roots, 1):
            at = np.full(len(x), root)
            for depth in range(deepest + 1):
                if depth in depths:
                    votes[depths.index(depth)] += self.share[at]
                at = np.where(x[rows, self.feature[at]] <= self.bound[at], self.low[at], self.high[at])
            if n in trees:
                for depth, sums in zip(depths, votes):
                    yes = 2 * sums > n
                    out.append((depth, n, int((yes & good).sum()), int((~yes & ~good).sum()), int((yes & ~good).sum()), int((~yes & good).sum())))
        return out


def forest_outcomes(votes: Votes, encoded: DataFrame, label: str, depths: Sequence[int], trees: Sequence[int]) -> DataFrame:
    """depth, trees, tp, tn, fp, fn over all encoded rows, from one pass."""
    shared = encoded.sparkSession.sparkContext.broadcast(votes)
    depths, trees = list(depths), list(trees)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                found = shared.value.outcomes(x, batch.column(0).to_numpy(zero_copy_only=False), depths, trees)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["depth", "trees", *CELLS])

    rows = encoded.select(F.col(label).cast("double"), vector_to_array(ml.FEATURES))
    parts = rows.mapInArrow(count, ", ".join(f"{c} bigint" for c in ("depth", "trees", *CELLS)))
    return parts.groupBy("depth", "trees").agg(*[F.sum(c).alias(c) for c in CELLS])


def search_forests(train: DataFrame, validation: DataFrame, label: str, axes: Mapping[str, Sequence], parallel: int = 4) -> DataFrame:
    """leaf, subset, depth, trees, mcc for every point of ``axes`` (leaf, subset, depth, trees), on encoded sets.

    One forest is fitted per leaf size and column rule; ``auto`` is ``sqrt`` for forests of several trees and is not fitted again.
    """
    spark, most = train.sparkSession, {"trees": max(axes["trees"]), "depth": max(axes["depth"])}
    rule = lambda subset: "sqrt" if subset == "auto" else subset
    fits = list(dict.fromkeys((leaf, rule(subset)) for leaf, subset in product(axes["leaf"], axes["subset"])))

    def run(setting):
        model = ml.forest(label, leaf=setting[0], subset=setting[1], **most).fit(train)
        cells = forest_outcomes(Votes(tree_nodes(model, spark)), validation, label, axes["depth"], axes["trees"])
        return [(*setting, r["depth"], r["trees"], r["mcc"]) for r in cells.select("depth", "trees", metric_columns()["mcc"].alias("mcc")).collect()]

    with ThreadPool(parallel) as pool:
        found = {(leaf, name, depth, trees): mcc for rows in pool.imap(run, fits) for leaf, name, depth, trees, mcc in rows}
    points = product(axes["leaf"], axes["subset"], axes["depth"], axes["trees"])
    rows = [(leaf, subset, depth, trees, found.get((leaf, rule(subset), depth, trees))) for leaf, subset, depth, trees in points]
    return spark.createDataFrame(rows, "leaf int, subset string, depth int, trees int, mcc double")


def best_point(points: DataFrame) -> dict:
    """The point of the largest value; of equal ones that of fewer trees, less depth and larger leaves."""
    return points.orderBy(F.desc_nulls_last("mcc"), "trees", "depth", F.desc("leaf"), "subset").first().asDict()
