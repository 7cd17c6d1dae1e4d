"""Bucketed and incremental sinks, and the functions for SQL text."""

from pyspark.sql import functions as F

from cohortlake.functions import codes, sql
from cohortlake.functions.recode import region, row_sum
from cohortlake.plans import source_plans
from cohortlake.sources import tables

SMALL = "/root/testdata/sf0.001"


def test_bucketed_join_has_no_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = source_plans.bucketed_join(spark, SMALL)
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan


def test_replaced_partition_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save_table(spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "x int, month int"), path, ["month"])
    first = {f.name for f in (tmp_path / "t" / "month=1").iterdir()}
    tables.replace_partitions(spark.createDataFrame([(9, 2)], "x int, month int"), path, ["month"])
    assert {f.name for f in (tmp_path / "t" / "month=1").iterdir()} == first
    assert sorted(map(tuple, spark.read.parquet(path).select("month", "x").collect())) == [(1, 1), (1, 2), (2, 9)]


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    states = [s for values in codes.REGIONS.values() for s in values][:6] + ["ZZ", None]
    df = spark.createDataFrame([(s,) for s in states], "state string")
    got = df.select(F.expr("region_of(state)").alias("a"), region(F.col("state")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    sql.create_recode(spark, "quoted", {"it's": ["a'b", "c"]})
    row = spark.sql("SELECT quoted('a\\'b') AS x, quoted('d') AS y, study_month(DATE'1996-03-05', 1995) AS m, "
                    "enrolled_days(0L) AS n, enrolled_days(NULL) AS o").first()
    assert tuple(row) == ("it's", None, 15, "no", "missing")


def test_row_sum_counts_nulls_as_zero(spark):
    df = spark.createDataFrame([(1, None, 2.5), (None, None, None)], "a int, b int, c double")
    assert [r.s for r in df.select(row_sum([F.col(c) for c in "abc"]).alias("s")).collect()] == [3.5, 0.0]
