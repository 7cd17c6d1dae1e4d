"""Readers, sinks, encoders, grids and importances."""

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.operators import ml
from cohortlake.session import materialize, shared_dir
from cohortlake.sources import tables


def test_code_lists_keep_zeros_and_drop_quotes(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("dx,cat\n'001','A '\n'001','A'\n002,B\n")
    got = tables.read_code_list(spark, str(path), {"dx": "code", "cat": "category"}, quote_mark="'")
    assert sorted((r.code, r.category) for r in got.collect()) == [("001", "A"), ("002", "B")]
    tabbed = tmp_path / "groups.txt"
    tabbed.write_text("Diag_ID\tDiag_Group\tClass\n0010\t CARM \tx\n")
    row = tables.read_code_list(spark, str(tabbed), {"Diag_ID": "code", "Diag_Group": "grp"}, "\t").first()
    assert (row.code, row.grp) == ("0010", "CARM")


def test_area_rates_are_numbers_and_counties_text(spark, tmp_path):
    path = tmp_path / "area.csv"
    path.write_text("STATE,COUNTYFIPS,RATE,OTHER\nAL,01001,1.5,x\nAL,01003,,y\n")
    got = sorted((r.county, r.rate) for r in tables.read_area_rates(spark, str(path), {"RATE": "rate"}).collect())
    assert got == [("01001", 1.5), ("01003", None)]


def test_month_partitions_prune(spark, tmp_path):
    df = spark.range(24).select((F.col("id") % 12 + 1).cast("int").alias("month"), F.col("id").alias("claim"))
    tables.save_table(df, str(tmp_path / "claims"), ["month"])
    got = tables.month_partitions(spark, str(tmp_path / "claims"), [1, 2], ["claim"])
    assert sorted(r.claim for r in got.collect()) == [0, 1, 12, 13]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan or "PartitionFilters: [month" in plan


def test_report_sink_and_stack(spark, tmp_path):
    frame = tables.stack_years({2017: spark.range(2), 2018: spark.range(3)})
    tables.save_report(frame, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 5


def test_bucketed_blocks_join_without_a_shuffle(spark, tmp_path):
    from cohortlake.operators.joins import assemble

    blocks = [
        tables.save_bucketed(spark.range(50).select(F.col("id").alias("member"), F.lit(i).alias(f"v{i}")),
                             f"block_{i}", str(tmp_path / f"b{i}"), ["member"], 4)
        for i in range(3)
    ]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = assemble(blocks[0], blocks[1:], ["member"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for i in range(3):
            spark.sql(f"DROP TABLE block_{i}")


def test_hot_claim_is_split_by_adaptive_execution(spark):
    """A claim with most of the lines: the row-level join is split, and stays whole."""
    from cohortlake.operators.joins import header_lines

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        lines = spark.range(0, 40000, 1, 8).select(
            F.when(F.col("id") < 20000, 1).otherwise(F.col("id")).alias("claim"), F.md5(F.col("id").cast("string")).alias("x"))
        headers = spark.range(40000).select(F.col("id").alias("claim"), F.lit("1").alias("kind"))
        joined = header_lines(headers, lines, ["claim"], "kind", ["1"])
        assert len(joined.collect()) == 40000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def test_hot_member_adds_no_large_group(spark):
    """The window of a member with very many rows sees its distinct intervals only."""
    from cohortlake.operators.episodes import episode_rollup

    rows = spark.range(20000).select(
        F.when(F.col("id") < 15000, 1).otherwise(F.col("id")).alias("member"),
        F.date_add(F.lit("2018-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("start"))
    df = rows.withColumn("end", F.date_add("start", 0))
    plan = episode_rollup(df, ["member"], "start", "end")._jdf.queryExecution().executedPlan().toString()
    below_window = plan[plan.rindex("Window ["):]
    assert "partial_count" in below_window
    merged = episode_rollup(df, ["member"], "start", "end").where("member = 1").collect()
    assert len(merged) == 1


def test_year_filter_reaches_the_scan(spark):
    orders = tables.load(spark, "/root/testdata/sf0.001", "orders", "o_orderkey", "o_orderdate")
    plan = tables.year_slice(orders, "o_orderdate", 1997)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_shared_dir_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or spark.sparkContext.getCheckpointDir()).rstrip("/")
    assert materialize(spark.range(5), "t").count() == 5


def training(spark, n=300):
    rows = [(i, ["a", "b", "c"][i % 3], float(i % 10), float((i % 3 == 0) or (i % 10 > 7))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, cat string, x double, label double")


def test_encoder_names_and_scaling(spark):
    df = training(spark)
    model = ml.fit(df, ml.encoder(["cat"], ["x"], scale=True), ml.logistic("label"))
    names = [r.feature for r in ml.importance_table(model, df, ["x"]).collect()]
    assert names == ["cat_vec_a", "cat_vec_b", "cat_vec_c", "x"]


def test_unseen_category_is_kept_or_refused(spark):
    df = training(spark)
    other = df.limit(1).withColumn("cat", F.lit("new"))
    keep = ml.fit(df, ml.encoder(["cat"], ["x"]), ml.logistic("label"))
    assert ml.score(keep, other).count() == 1
    refuse = ml.fit(df, ml.encoder(["cat"], ["x"], invalid="error"), ml.logistic("label"))
    with pytest.raises(Exception):
        ml.score(refuse, other).collect()


def test_grid_choice_and_persistence(spark, tmp_path):
    df = training(spark)
    settings = ml.grid(depth=[1, 3], trees=[3])
    assert len(ml.grid(reg=codes.ELASTIC_NET_REG, mix=codes.ELASTIC_NET_MIX)) == 42
    chosen, model, trials = ml.choose_by_mcc(df, df, ml.encoder(["cat"], ["x"]), "label", ml.boosted_classifier, settings)
    assert len(trials) == 2 and dict(trials[[t[1] for t in trials].index(max(t[1] for t in trials))][0]) == chosen
    path = str(tmp_path / "model")
    ml.save_model(model, path)
    scored = ml.batch_score(spark, path, df, ["id"])
    assert scored.where("probability_col between 0 and 1").count() == df.count()
    metrics = ml.evaluate(ml.score(model, df), "label").first()
    assert metrics.auc > 0.9 and metrics.mcc == pytest.approx(max(t[1] for t in trials), abs=1e-6)


def test_importances(spark):
    df = training(spark).withColumn("noise", F.lit(1.0))
    model = ml.fit(df, ml.encoder(["cat"], ["x", "noise"]), ml.forest("label", depth=3, trees=5))
    table = ml.importance_table(model, df)
    assert ml.top_k(table, 2).count() == 2
    assert "noise" in {r.feature for r in ml.unused_features(table).collect()}


def test_feature_sets():
    sets = ml.feature_sets(["dx_a"], ["trend"])
    assert "race" not in sets["no_race"][0] and "race" in sets["area_sdoh"][0]
    assert sets["baseline"] == (["ageCat", "sex"], ["dx_a"])
    assert set(codes.AREA_RATES) <= set(sets["area_individual"][1])
    assert ml.restrict_set(sets["no_sdoh"], ["race", "trend"]) == (["race"], ["trend"])
