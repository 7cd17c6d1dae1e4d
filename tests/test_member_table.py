"""What the model tables and the assembled features read, and how often."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import windows
from cohortlake.plans import claim_plans, feature_plans, ml_plans, views
from cohortlake.session import at_once, materialize

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df):
    """Files that a query's last plan reads."""
    return [f.rsplit("/", 2)[-2] if f.endswith(".snappy.parquet") else f.rsplit("/", 1)[-1] for f in df.inputFiles()]


def test_indexed_lines_are_those_of_the_window_join(spark):
    headers = spark.createDataFrame(
        [(1, 10), (2, 10), (3, 20), (4, None), (5, 30), (5, 30), (None, 10)], "claim_id int, member_id int")
    lines = spark.createDataFrame(
        [(c, date(1995, m, 3) if m else None) for c in (1, 2, 3, 4, 5, 5, 6, None) for m in (None, 1, 2, 7, 8, 12)], "claim_id int, fill date")
    members = spark.createDataFrame([(10, 1), (20, 6), (30, None), (None, 1)], "member_id int, m int")
    owned = lines.join(headers, "claim_id")
    want = windows.prepost_window(owned, windows.index_windows(members, "m"), ["member_id"], "fill", 1995)
    indexed = windows.indexed_lines(lines, headers, members, ["claim_id"], ["member_id"], "m")
    got = windows.prepost_indexed(indexed, "m", "fill", 1995)
    columns = ["claim_id", "member_id", "fill", "service_month", "pre", "post"]
    assert want.count() > 0
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    inside = indexed.where(windows.in_pre_months("m", "fill", 1995)).count()
    assert inside == want.where(F.col("pre") == 1).count() > 0


def test_claim_lines_meet_their_claims_once(spark):
    """Three blocks read one written table of lines; the line table itself is in none of their plans."""
    read = scans(feature_plans.assemble(spark, SMALL))
    assert "lineitem.parquet" not in read and any("pre-lines" in f for f in read)


def test_blocks_of_the_member_table_are_written_apart(spark):
    """The last join of the member table reads a row a member from each block made from claims, and aggregates none."""
    frame = ml_plans.base_frame(spark, SMALL)
    assert "lineitem.parquet" not in scans(frame)
    assert plan(frame).count("Aggregate") <= 3  # index months, area rates and their mean
    blocks = [claim_plans.slope, claim_plans.post_outcomes]
    for block in blocks:
        months = claim_plans.claim_months(spark, SMALL)
        assert sorted(block(spark, SMALL, months).collect()) == sorted(block(spark, SMALL).collect())


def test_member_table_is_joined_in_written_steps(spark):
    """A task of the last join holds the sorted rows of the last blocks only: outcome and cost, beside the first half."""
    frame = ml_plans.base_frame(spark, SMALL, lambda: spark.createDataFrame([(1, 0.5)], "member_id int, given double"))
    assert plan(frame).count("Join") == 3 and plan(frame).count("Aggregate") == 0
    assert {r["member_id"]: r["given"] for r in frame.where("member_id in (1, 2)").select("member_id", "given").collect()} == {1: 0.5, 2: 0.0}


def test_cost_from_claims_whose_lines_were_summed_once(spark):
    index = materialize(views.index_months(spark, SMALL), "index")
    totals = materialize(claim_plans.claim_totals(spark, SMALL), "totals")
    apart, shared = claim_plans.total_cost(spark, SMALL), claim_plans.total_cost(spark, SMALL, totals, index)
    assert "lineitem.parquet" in scans(apart) and "lineitem.parquet" not in scans(shared)
    assert sorted(apart.collect()) == sorted(shared.collect())
    assert shared.where("total_cost > 0").count() > 0
    months = claim_plans.claim_months(spark, SMALL, totals)
    for block in (claim_plans.slope, claim_plans.post_outcomes):
        assert sorted(block(spark, SMALL).collect()) == sorted(block(spark, SMALL, months, index).collect())


def test_lines_carry_the_listed_columns(spark):
    lines = feature_plans.pre_lines(spark, SMALL, feature_plans.CODE_AND_FILL)
    assert not {"l_suppkey", "l_linenumber", "l_linestatus"} & set(lines.columns)
    for block in (feature_plans.dx_counts, feature_plans.rx_adherence):
        assert sorted(block(spark, SMALL).collect()) == sorted(block(spark, SMALL, lines).collect())


def test_makers_side_by_side_keep_their_order(spark):
    assert at_once(lambda: spark.range(3).count(), lambda: "b", lambda: spark.range(5).count()) == [3, "b", 5]
    with pytest.raises(ZeroDivisionError):
        at_once(lambda: 1, lambda: 1 // 0)
