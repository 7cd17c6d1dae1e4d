"""Edge rows for recodes, panels, windows, features and cost."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.dates import index_from_name, month_index, month_name, month_year, trend_slope
from cohortlake.functions.recode import age_band, age_sex_cells, any_code, composite_flag, days_flag, race_group, recode, region, to_int
from cohortlake.operators import cost, features, joins, panel, profile, windows


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first().x


@pytest.mark.parametrize("age,label", [
    (0, "under10"), (9, "under10"), (9.5, "under10"), (10, "10To17"), (17, "10To17"), (17.5, "10To17"), (18, "18To29"),
    (29, "18To29"), (30, "30To39"), (64, "50To64"), (64.5, "50To64"), (65, "over64"), (None, "missing")])
def test_age_band(spark, age, label):
    source = F.lit(age).cast("double")
    assert one(spark, age_band(source)) == label


@pytest.mark.parametrize("code,label", [("01", "white"), ("1", "white"), ("7", "hispanic"), ("0", "missing"), ("x", "missing"), (None, "missing")])
def test_numeric_recode_tolerates_junk(spark, code, label):
    assert one(spark, recode(F.lit(code).cast("string"), codes.NUMBER_RECODES["race"], numeric=True)) == label


def test_text_recode_keeps_leading_zero(spark):
    assert one(spark, recode(F.lit("1"), codes.TEXT_RECODES["married"])) == "missing"
    assert one(spark, recode(F.lit("01"), codes.TEXT_RECODES["married"])) == "yes"


def test_to_int(spark):
    got = [one(spark, to_int(F.lit(x).cast("string"))) for x in ("12", " 7 ", "-3", "1.5", "A", "", None)]
    assert got == [12, 7, -3, None, None, None, None]


def test_composite_flag(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, None), (None, 1)], "a int, b int")
    got = [r.x for r in df.select(composite_flag([F.col("a"), F.col("b")]).alias("x")).collect()]
    assert got == ["yes", "no", "missing", "yes"]


def test_flags_and_groups(spark):
    assert [one(spark, days_flag(F.lit(x).cast("int"))) for x in (3, 0, None)] == ["yes", "no", "missing"]
    assert one(spark, region(F.lit("PA"))) == "Northeast" and one(spark, region(F.lit("WY"))) == "West"
    assert [one(spark, race_group(F.lit(x).cast("string"))) for x in ("white", "asian", None)] == ["White", "minority", "minority"]
    assert one(spark, any_code([(F.lit(None).cast("string"), ["1"]), (F.lit(23), ["23"])])) == 1
    assert one(spark, any_code([(F.lit("x"), ["1"]), (F.lit(None).cast("string"), ["23"])])) == 0


def test_age_sex_cells(spark):
    df = spark.createDataFrame([(0.5, 1), (4.9, None), (14.0, 0), (70.0, 1), (20.0, None)], "age double, male int")
    got = [{k for k, x in r.asDict().items() if x} for r in df.select(*age_sex_cells(F.col("age"), F.col("male"))).collect()]
    assert got == [{"a_under1"}, {"a_1_4"}, {"a_5_14f"}, {"a_65"}, set()]


def test_month_arithmetic(spark):
    assert one(spark, month_index(F.lit(datetime.date(2018, 1, 5)), 2017)) == 13
    assert [one(spark, month_name(F.lit(i))) for i in (1, 12, 13, 24)] == ["Jan", "Dec", "Jan", "Dec"]
    assert [one(spark, month_year(F.lit(i), 2017)) for i in (1, 12, 13)] == [2017, 2017, 2018]
    assert one(spark, index_from_name(F.lit(2018), F.lit("Mar"), 2017)) == 15
    assert one(spark, index_from_name(F.lit(2018), F.lit("???"), 2017)) is None


@pytest.mark.parametrize("y", [[0] * 6, [1, 2, 3, 4, 5, 6], [5, 0, 2, 9, 1, 1], [3] * 6])
def test_slope_equals_polynomial_fit(spark, y):
    expected = round(float(np.polyfit(range(1, 7), y, 1)[0]), 6) + 0.0
    assert one(spark, trend_slope([F.lit(x) for x in y])) == pytest.approx(expected, abs=1e-6)


def test_member_month_panel_combines_duplicates(spark):
    columns = [f"{p}{i}" for p in ("d", "c") for i in range(1, 13)]
    first = [1] + [0] * 11 + ["00"] + [None] * 11
    second = [2] + [None] * 11 + ["05"] + [None] * 11
    wide = spark.createDataFrame([(1, *first), (1, *second)], "id int, " + ", ".join(
        f"{c} {'int' if c[0] == 'd' else 'string'}" for c in columns))
    got = panel.member_month_panel(wide, ["id"], {"days": columns[:12]}, {"code": columns[12:]})
    rows = {r.month: (r.days, r.code) for r in got.collect()}
    assert len(rows) == 12 and rows[1] == (3, "05") and rows[2] == (0, None)


def test_enroll_flags_chip_only_month(spark):
    df = spark.createDataFrame([(0, 5, "01", "80", "2"), (None, None, "xx", None, None)],
                               "medicaid_days int, chip_days int, dual_code string, plan_code string, chip_code string")
    shipped = panel.enroll_flags(df).collect()
    assert [r.enrolled for r in shipped] == ["no", "no"]
    assert (shipped[0].dual, shipped[0].managed_care, shipped[0].coverage_type) == ("yes", "yes", "chip")
    assert (shipped[1].dual, shipped[1].managed_care, shipped[1].med_enroll) == ("missing", "no", "missing")
    assert [r.enrolled for r in panel.enroll_flags(df, include_chip=True).collect()] == ["yes", "no"]


def test_first_enroll_edges(spark):
    covered = {1: [1, 2, 13, 14], 2: [24, 25, 36], 3: [25, 26], 4: [36], 5: list(range(3, 16)), 6: [40]}
    months = spark.createDataFrame([(m, i) for m, idx in covered.items() for i in idx], "id int, i int")
    mask = panel.coverage_mask(months, ["id"], "i")
    got = {r.id: (r.first, r.enroll_months, r.total_months) for r in panel.first_enroll(mask).collect()}
    assert got == {1: (1, 2, 4), 2: (24, 2, 3), 3: (25, 0, 2), 4: (36, 0, 1), 5: (3, 12, 13)}
    loss = {r.id: (r.lose_coverage, r.enroll_month, r.enroll_year) for r in panel.coverage_loss(mask, 2017).collect()}
    assert loss == {1: (1.0, "Jan", 2017), 2: (1.0, "Dec", 2018), 5: (0.0, "Mar", 2017)}
    wide = panel.enrollment_panel(mask, ["id"]).where("id = 2").first().asDict()
    assert [k for k, x in wide.items() if k != "id" and x] == ["col24", "col25", "col36"]


def test_cohort_select(spark):
    members = spark.createDataFrame(
        [("a", "ME", "18To29"), ("a", "AL", "18To29"), ("b", "CA", "18To29"), ("c", "ME", "over64"), ("d", "ME", "missing")],
        "id string, state string, age string")
    summary = spark.createDataFrame(
        [("a", "AL", 12, 0), ("b", "CA", 12, 0), ("c", "ME", 12, 0), ("d", "ME", 5, 0)],
        "id string, state string, enrolled_months long, medicare_months long")
    assert {(r.id, r.state) for r in panel.select_cohort(members, summary, "id", "state", "age").collect()} == {("a", "AL"), ("d", "ME")}
    assert [r.id for r in panel.select_cohort(members, summary, "id", "state", "age", full_months=12).collect()] == ["a"]


def test_prepost_bounds(spark):
    index = windows.index_windows(spark.createDataFrame([(1, 6)], "id int, m int"), "m")
    dates = [datetime.date(2017 + (i - 1) // 12, (i - 1) % 12 + 1, 15) for i in (6, 7, 12, 13, 18, 19)] + [None]
    events = spark.createDataFrame([(1, d, n) for n, d in enumerate(dates)], "id int, d date, n int")
    got = {r.n: (r.pre, r.post) for r in windows.prepost_window(events, index, ["id"], "d", 2017).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (0, 1), 4: (0, 1)}
    monthly = windows.monthly_totals(events, ["id"], "d", 2017, {"k": F.lit(1)})
    assert windows.window_totals(monthly, index, ["id"], ["k"], "pre").first().k_pre == 2
    slots = windows.month_slots(monthly, index, ["id"], "k").first()
    assert [slots[f"k_month{i}"] for i in range(1, 7)] == [1, 0, 0, 0, 0, 1]


def test_crosswalk_passes(spark):
    events = spark.createDataFrame([("A001",), ("A00X",), ("Z1",), (None,)], "code string")
    lists = spark.createDataFrame([("A001", "c1"), ("A001", "c3"), ("A002", "c9"), (None, "n")], "code string, cat string")
    got = {r.code: r.cat for r in features.crosswalk_prefix(events, lists, "code", "cat").collect()}
    assert got == {"A001": "c3", "A00X": "c9", "Z1": None, None: None}
    assert features.crosswalk_exact(events, lists, "code", "cat").count() == 4
    assert features.crosswalk_exact(events, lists, "code", "cat", "inner").count() == 1


def test_pivot_counts_and_wide_agree(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y")], "id int, cat string")
    narrow = {r.id: (r.x, r.y, r.unmatched) for r in features.pivot_counts(df, ["id"], "cat", ["x", "y"]).collect()}
    assert narrow == {1: (2, 0, 1), 2: (0, 1, 0)}
    wide = {r.id: (r.x, r.y) for r in features.pivot_wide(df, ["id"], "cat", ["x", "y"]).collect()}
    assert wide == {1: (2, 0), 2: (0, 1)}
    assert features.category_values(df, "cat") == ["x", "y"]


def test_adherence_edges(spark):
    d = datetime.date(2018, 1, 1)
    fills = spark.createDataFrame(
        [(1, "a", d, 30, 1), (1, "b", d, 10, 0), (2, "a", d, None, 1), (3, "a", d, 0, 0)],
        "id int, drug string, d date, days int, g int")
    got = {r.id: r for r in features.rx_adherence(fills, ["id"], "drug", "d", "days", "g").collect()}
    assert (got[1].number_of_fills, got[1].number_of_unique_med, got[1].percent_generic, got[1].percent_med_adherence) == (2, 2, 0.5, 1.0)
    assert got[2].percent_med_adherence is None and got[3].percent_med_adherence is None


def test_imputation_order(spark):
    rows = [("a", 1.0), ("a", None), ("a", None), ("b", 4.0), ("c", None)]
    got = sorted((r.g, r.v) for r in features.impute_group_mean(spark.createDataFrame(rows, "g string, v double"), "g", ["v"]).collect())
    # overall mean is taken after the group fill: (1 + 1 + 1 + 4) / 4
    assert got == [("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 4.0), ("c", 1.75)]


def test_group_indicators_many_groups(spark):
    names = [f"G{i}" for i in range(70)]
    lists = spark.createDataFrame([("c1", " G0 "), ("c1", "G69"), ("c2", "G62"), ("c3", "other")], "code string, grp string")
    events = spark.createDataFrame([(1, "c1"), (1, "c1"), (2, "c2"), (3, "c9")], "id int, code string")
    got = {r.id: {n for n in names if r[n]} for r in features.group_indicators(events, lists, ["id"], "code", "grp", names).collect()}
    assert got == {1: {"G0", "G69"}, 2: {"G62"}}


def sequential(state):
    """The ordered rules, one by one, on a dict."""
    for target, value, condition in codes.GROUP_RULES:
        test = condition.replace(" = ", " == ").replace(" AND ", " and ")
        if eval(test, {}, dict(state)):
            state[target] = value
    return state


def test_rules_in_order(spark):
    names = [*codes.DISEASE_GROUPS, *codes.DRUG_GROUPS]
    rng = np.random.default_rng(3)
    cases = [dict(zip(names, map(int, rng.integers(0, 2, len(names)))), age=int(a)) for a in rng.choice([5, 18, 19, 40], 60)]
    df = spark.createDataFrame([tuple(c.values()) + (i,) for i, c in enumerate(cases)], [*cases[0], "id"])
    got = {r.id: r.asDict() for r in features.apply_rules(df).collect()}
    for i, c in enumerate(cases):
        assert {k: got[i][k] for k in c} == sequential(dict(c))


def test_claim_cost_both_kinds(spark):
    rows = [("c1", "1", 100.0, 10.0), ("c1", "1", 100.0, 20.0), ("c2", "3", 50.0, 7.0), ("c2", "3", 50.0, None), ("c3", "1", None, None)]
    df = spark.createDataFrame(rows, "id string, kind string, head double, line double")
    header = cost.claim_cost(df.withColumns(cost.payment_columns("kind", "head", "line")), ["id"], "mean")
    assert {r.id: float(r.total_cost) for r in header.collect()} == {"c1": 100.0, "c2": 7.0, "c3": 0.0}
    line = cost.claim_cost(df.withColumns(cost.payment_columns("kind", "line", "line")), ["id"], "sum")
    assert {r.id: float(r.total_cost) for r in line.collect()} == {"c1": 30.0, "c2": 7.0, "c3": 0.0}


def test_completeness(spark):
    rows = [("c1", 1, None, "x"), ("c1", None, 2, "x"), ("c2", 1, None, None)]
    df = spark.createDataFrame(rows, "id string, a int, b int, p string")
    claims = cost.claim_completeness(df, ["id"], {"a": "a", "b": "b", "p": "p"}, {"both": ["a", "b"], "any": ["a", ["b", "p"]]})
    report = cost.completeness_report(claims.withColumn("state", F.lit("ME")), "state", ["both", "any"])
    assert {r.state: (r.both, r.any, r.total_claims) for r in report.collect()} == {"ME": (1, 1, 2), "ALL": (1, 1, 2)}


def test_every_tier_is_usable(spark):
    for family, tiers in codes.COMPLETENESS_TIERS.items():
        fields = {f for r in tiers.values() for x in r for f in (x if isinstance(x, list) else [x])}
        df = spark.range(1).select(F.lit(1).alias("id"), *[F.lit(1).alias(f) for f in fields])
        claims = cost.claim_completeness(df, ["id"], {f: f for f in fields}, tiers).first()
        assert all(claims[t] == 1 for t in tiers), family


def test_strata(spark):
    got = [one(spark, cost.stratum(F.lit(a), F.lit(d))) for a, d in
           [("under10", "no"), ("18To29", "no"), ("missing", "no"), ("under10", "yes"), ("18To29", "missing")]]
    assert got == ["kids", "adults", None, "disabled", None]


def test_profile_helpers(spark, rows):
    df = spark.createDataFrame([(1, "x", float("nan")), (2, "", 1.0), (3, "a NULL b", None), (4, None, 2.0)], "id int, t string, v double")
    assert {r["column_name"]: r["missing"] for r in rows(profile.null_profile(df, ["id", "t", "v"]))} == {"id": 0, "t": 3, "v": 2}
    first = profile.keep_first(df.withColumn("k", F.lit(1)), ["k"], ["id"]).collect()
    assert [r.id for r in first] == [1]
    assert profile.any_present_share(df, ["t", "v"]).first().filled == 4
    rates = profile.group_rates(df.withColumns({"g": F.lit("u"), "flag": (F.col("id") > 2).cast("int")}), ["g"], "flag")
    assert {(r.dimension, r.value, r.flagged, r.percent) for r in rates.collect()} == {("all", "all", 2, 50.0), ("g", "u", 2, 50.0)}


def test_joins(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    b = spark.createDataFrame([(1, 5), (1, 6)], "id int, v int")
    assert joins.restrict_to(a, b, ["id"]).count() == 2
    filled = joins.spine_fill(spark.createDataFrame([(2,), (1,)], "id int"), b.groupBy("id").agg(F.sum("v").alias("v")), ["id"])
    assert {r.id: r.v for r in filled.collect()} == {1: 11, 2: 0}
    assert {r.found for r in joins.enrich(a, b.limit(1), ["id"], "found").collect()} == {0, 1}
    both = joins.union_sources({"x": a, "y": a}, ["id"])
    assert both.count() == 6 and {r.source for r in both.collect()} == {"x", "y"}


# --- hot keys, windows and caps ----------------------------------------------------

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, x in SKEW.items():
        spark.conf.set(k, x)
    yield lambda df: "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    for k, x in before.items():
        spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def _hot(spark, key):
    return spark.range(0, 40000, 1, 8).select(
        F.when(F.col("id") < 20000, 1).otherwise(F.col("id")).alias(key), F.md5(F.col("id").cast("string")).alias("x"),
        F.to_date(F.lit("1995-03-05")).alias("day"))


def test_hot_member_is_split_against_aggregated_windows(spark, skewed):
    index = _hot(spark, "member").groupBy("member").agg(F.min(F.lit(1)).alias("m"))
    inside = windows.prepost_window(_hot(spark, "member"), windows.index_windows(index, "m"), ["member"], "day", 1995)
    assert len(inside.collect()) == 40000 and skewed(inside)


def test_hot_code_is_split_against_an_aggregated_list(spark, skewed):
    from cohortlake.operators import acute

    listed = spark.range(40000).select(F.col("id").alias("code"), F.lit("c").alias("category"))
    placed = features.crosswalk_exact(_hot(spark, "code"), listed, "code", "category")
    assert len(placed.collect()) == 40000 and skewed(placed)
    flags = listed.groupBy("code").agg(F.max(F.lit(1)).alias("flag"))
    flagged = acute.attach_code_flag(_hot(spark, "code"), flags, "code", "flag")
    assert len(flagged.collect()) == 40000 and skewed(flagged)


def test_many_equal_and_open_intervals(spark):
    """Equal rows are one row with a count until the end; open copies are numbered in bounded pieces."""
    from cohortlake.operators import episodes

    day = F.to_date(F.lit("2018-01-01"))
    closed = spark.range(3000).select(F.lit(1).alias("m"), day.alias("s"), day.alias("e"))
    opened = spark.range(250_000).select(F.lit(2).alias("m"), day.alias("s"), F.lit(None).cast("date").alias("e"))
    rows = episodes.episodes(closed.union(opened), ["m"], "s", "e")
    got = {r["m"]: tuple(r)[1:] for r in rows.groupBy("m").agg(F.count("*"), F.min("episode"), F.max("episode"), F.countDistinct("episode")).collect()}
    assert got == {1: (3000, 1, 1, 1), 2: (250_000, 1, 250_000, 250_000)}
    rolled = episodes.episode_rollup(closed.union(opened), ["m"], "s", "e").groupBy("m").count().collect()
    assert {r["m"]: r["count"] for r in rolled} == {1: 1, 2: 250_000}


def test_later_claims_change_no_feature(spark, tmp_path):
    """Without the lines shipped after the pre period the pharmacy features are the same; without the claims
    dated after it so are the diagnosis, procedure and specialty features."""
    from cohortlake.plans import feature_plans

    source = "/root/testdata/sf0.001"
    read = {n: spark.read.parquet(f"{source}/{n}.parquet") for n in "nation customer supplier part orders lineitem".split()}
    owned = read["orders"].join(read["orders"].groupBy("o_custkey").agg(F.min("o_orderdate").alias("first")), "o_custkey")
    limit = F.add_months(F.trunc("first", "month"), 7)
    dated = owned.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", limit.alias("limit"))
    early = {
        "shipped": read["lineitem"].join(dated, "l_orderkey").where(F.to_date("l_shipdate") < F.col("limit")),
        "claimed": read["lineitem"].join(dated, "l_orderkey").where(F.to_date("o_orderdate") < F.col("limit")),
    }
    for kind, rows in early.items():
        for name, df in (read | {"lineitem": rows.select(*read["lineitem"].columns)}).items():
            df.write.parquet(str(tmp_path / kind / f"{name}.parquet"))
    blocks = {
        "shipped": [feature_plans.rx_counts, feature_plans.rx_adherence],
        "claimed": [feature_plans.dx_counts, feature_plans.proc_counts, feature_plans.provider_counts],
    }
    for kind, found in blocks.items():
        assert early[kind].count() < read["lineitem"].count()
        for block in found:
            before, after = (sorted(map(tuple, block(spark, d).collect())) for d in (source, str(tmp_path / kind)))
            assert before == after, block.__name__


def test_poisson_levels_have_no_cap():
    from cohortlake.functions.hashing import WORDS, poisson_levels

    for mean in (0.05, 3.0, 250.0, 900.0):
        levels = [int(x, 16) for x in poisson_levels(mean)]
        assert levels == sorted(levels) and levels[-1] / WORDS > 0.999999
        assert abs(sum(1 - x / WORDS for x in levels) - mean) < 0.01 * mean + 1e-3


def test_codes_compare_as_numbers(spark):
    from cohortlake.functions.recode import to_int

    texts = ["0000000001", "1234567890", "7.0", " 12 ", "x", "", None, "1.5", "-3", "7."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(to_int(F.col("t"))).collect()] == [1, 1234567890, 7, 12, None, None, None, None, -3, 7]
    assert spark.range(1).select(to_int(F.lit(7.0))).first()[0] == 7


def test_coverage_mask_refuses_more_months_than_bits(spark):
    from cohortlake.operators import panel

    with pytest.raises(ValueError):
        panel.coverage_mask(spark.range(1).selectExpr("id as m", "1 as i"), ["m"], "i", 65)


def test_auc_of_very_large_counts(spark):
    from cohortlake.operators.evaluation import auc_from_counts, score_bounds

    n = 10**11
    counts = spark.createDataFrame([(i / 500, n * (i % 3 == 0), n * (i % 3 != 0)) for i in range(500)], "score double, pos bigint, neg bigint")
    got = auc_from_counts(counts, "score", score_bounds(counts, "score")).first()["auc"]
    pos, neg = [i for i in range(500) if i % 3 == 0], [i for i in range(500) if i % 3]
    assert abs(got - sum(p > q for p in pos for q in neg) / (len(pos) * len(neg))) < 1e-9
