"""Sparse counts against the dense pivot, and assembly by one aggregate against joins."""

import re

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlake.operators import assembly, features, joins, ml

KEYS = ["member", "state"]
SCHEMA = "member bigint, state string, cat string, paid double"


def _events(spark):
    rows = [(i % 7, "AB"[i % 2], None if i % 5 == 0 else f"c{i * i % 11}", None if i % 4 == 0 else i / 2) for i in range(300)]
    return spark.createDataFrame(rows + [(None, "A", "c1", 1.0), (3, None, "c1", 1.0), (99, "A", "c1", 1.0)], SCHEMA)


def _spine(spark):
    return spark.createDataFrame([(i, s, i * 10) for i in range(9) for s in "AB"] + [(None, "A", 5)], "member bigint, state string, age int")


def test_one_aggregate_equals_joins(spark, rows):
    events, spine, listed = _events(spark), _spine(spark), [f"c{i}" for i in range(9)]
    sums = events.groupBy(*KEYS).agg(F.sum("paid").alias("paid"), F.count("paid").alias("n"))
    plain = joins.assemble(spine, [features.pivot_counts(events, KEYS, "cat", listed, "x_"), sums], KEYS)
    plain = plain.withColumn("n", F.col("n").cast("double"))
    blocks = [assembly.counted(events, KEYS, "cat", listed, "x_"),
              assembly.summed(events, KEYS, {"paid": "paid", "n": F.when(F.col("paid").isNotNull(), 1)}, "double")]
    got = assembly.assemble(spine, blocks, KEYS)
    assert got.columns == plain.columns and rows(got) == rows(plain)


def test_ten_blocks_share_one_shuffle(spark):
    names = [f"c{i}" for i in range(3)]
    blocks = [assembly.counted(_events(spark), KEYS, "cat", names, f"b{i}_") for i in range(10)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = assembly.assemble(_spine(spark), blocks, KEYS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2  # the stacked blocks and the spine


def test_empty_blocks_and_equal_names(spark):
    block = assembly.counted(_events(spark).limit(0), KEYS, "cat", ["c1"])
    out = assembly.assemble(_spine(spark), [block], KEYS).collect()
    assert len(out) == 19 and all(r["c1"] == 0 and r["unmatched"] == 0 for r in out)
    with pytest.raises(ValueError):
        assembly.assemble(_spine(spark), [block, block], KEYS)


def test_sparse_counts_equal_the_dense_pivot(spark, rows):
    crosswalk = spark.createDataFrame([(f"c{i}",) for i in (10, 2, 4, 5, 3, 3, 9)] + [(None,)], "cat string")
    index = assembly.category_index(crosswalk, "cat")
    order = [r["cat"] for r in index.orderBy("slot").collect()]
    assert order == ["c10", "c2", "c3", "c4", "c5", "c9", "unmatched"]
    sparse = assembly.sparse_counts(_events(spark), KEYS, "cat", index)
    vectors = _spine(spark).join(sparse, KEYS, "left").withColumn("v", assembly.sparse_vector("counts", order, "v"))
    dense = joins.spine_fill(_spine(spark), features.pivot_counts(_events(spark), KEYS, "cat", order[:-1]), KEYS)
    wanted = dense.select(*KEYS, F.array(*[F.col(c).cast("double") for c in order]).alias("v"))
    assert rows(vectors.select(*KEYS, vector_to_array("v").alias("v"))) == rows(wanted)
    first = vectors.where("member = 8").first()["v"]
    assert first.size == 7 and len(first.indices) == 0


def test_sparse_counts_enter_the_encoder(spark):
    """1,500 categories: one vector column, whose names reach the feature vector's attributes."""
    events = spark.range(4000).select((F.col("id") % 50).alias("member"), F.concat(F.lit("k"), F.col("id") % 1500).alias("cat"))
    index = assembly.category_index(events, "cat")
    names = [r["cat"] for r in index.orderBy("slot").collect()]
    counts = assembly.sparse_counts(events, ["member"], "cat", index)
    table = counts.select("member", (F.col("member") % 3).cast("string").alias("sex"), assembly.sparse_vector("counts", names, "dx", "dx_"))
    fitted = Pipeline(stages=ml.encoder(["sex"], ["dx"])).fit(table).transform(table)
    assert fitted.first()["features"].size == 1501 + 3 and len(table.columns) == 3
    attributes = fitted.schema["features"].metadata["ml_attr"]["attrs"]["numeric"]
    assert {a["name"] for a in attributes} == {f"dx_dx_{n}" for n in names}
    assert sum(r["features"].values.sum() for r in fitted.collect()) == 4000 + 50


def test_repeated_category_of_the_list(spark):
    index = assembly.category_index(spark.createDataFrame([("b",), ("b",), ("unmatched",)], "cat string"), "cat")
    assert [tuple(r) for r in index.orderBy("slot").collect()] == [(0, "b"), (1, "unmatched")]
