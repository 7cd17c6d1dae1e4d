"""Encoding, training, scoring and importances on the assembled member table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.dates import month_name, month_year
from cohortlake.functions.hashing import threshold
from cohortlake.operators import evaluation, features, joins, ml, penalised, sampling, trees
from cohortlake.plans import claim_plans, feature_plans, panel_plans, profile_plans, views as v
from cohortlake.plans.registry import query
from cohortlake.sources.tables import version
from cohortlake.session import at_once, materialize, shared_dir

LABEL = "outcome"
CATEGORICAL = ["ageCat", "sex", "race", "disabled", "enrollMonth", "enrollYear", "state"]
COUNTS = [f"dx_{t}" for t in feature_plans.PART_TYPES]
UTILISATION = ["lines_slope", "number_of_fills", "percent_generic", "percent_med_adherence"]
INDIVIDUAL = list(codes.INDIVIDUAL_CATEGORICAL)
AREA = ["rich_rate", "poor_rate", "debt_rate"]

STAGE1 = ["stage1_baseline_probability", "stage1_probability"]

_frames: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def _people(spark: SparkSession, d: str, index: DataFrame) -> DataFrame:
    """Demographics, index month, area rates and individual categories."""
    people = v.members(spark, d).join(index, "member_id")
    demographics = people.select(
        "member_id", "state", "sex", "race", "disabled", F.col("age_cat").alias("ageCat"),
        F.coalesce("age", F.lit(0.0)).alias("age"), month_name(F.col("index_month")).alias("enrollMonth"),
        month_year(F.col("index_month"), v.BASE_YEAR).alias("enrollYear"), F.col("nation_key").alias("county"))
    individual = profile_plans.recodes(spark, d).select("member_id", *INDIVIDUAL)
    area = features.impute_group_mean(feature_plans.area_rates(spark, d), "area", AREA).drop("area")
    return joins.assemble(demographics.join(area, "county"), [individual], v.MEMBER, fill=None)


def _line_blocks(spark: SparkSession, d: str, index: DataFrame) -> list[DataFrame]:
    """Diagnosis counts and adherence, from lines that met their claims once."""
    lines = feature_plans.pre_lines(spark, d, feature_plans.CODE_AND_FILL, index)
    made = (feature_plans.dx_counts(spark, d, lines), feature_plans.rx_adherence(spark, d, lines))
    return at_once(*[partial(materialize, b, "block") for b in made])


def _claim_blocks(spark: SparkSession, d: str, index: DataFrame) -> list[DataFrame]:
    """Trend, outcome and cost, from claims whose lines were summed once."""
    totals = materialize(claim_plans.claim_totals(spark, d), "claim-totals")

    def monthly() -> list[DataFrame]:
        months = materialize(claim_plans.claim_months(spark, d, totals), "claim-months")
        claims = claim_plans.post_outcomes(spark, d, months, index)
        outcome = claims.select("member_id", (F.col("claims_post") > 0).cast("double").alias(LABEL))
        return at_once(*[partial(materialize, b, "block") for b in (claim_plans.slope(spark, d, months, index), outcome)])

    costs = claim_plans.total_cost(spark, d, totals, index).select("member_id", "total_cost")
    (trend, outcome), cost = at_once(monthly, partial(materialize, costs, "block"))
    return [trend, outcome, cost]


def base_frame(spark: SparkSession, d: str, *more: Callable[[], DataFrame]) -> DataFrame:
    """Member table for modelling: demographics, index month, counts, trend, adherence
    and categories of the pre period, imputed area rates, post-period outcome and cost, and the blocks that ``more`` make.

    Each block that is made from claims is written by itself, one row a member, and they are joined in two written steps, so
    that no task holds the sorted rows of all of them at once; what several blocks start from is written once and read
    by each. Blocks that need nothing of one another are made side by side.
    """
    index = materialize(v.index_months(spark, d), "index-months")
    (dx, adherence), (trend, outcome, cost), people, *others = at_once(
        partial(_line_blocks, spark, d, index), partial(_claim_blocks, spark, d, index),
        lambda: materialize(_people(spark, d, index), "people"), *more)
    half = materialize(joins.assemble(people, [dx, trend, adherence], v.MEMBER, fill=None), "half")
    blocks = [outcome, cost, *others]
    # a rate unknown in every county stays null through imputation
    numeric_fill = {c: 0 for c in AREA} | {c: 0 for b in (dx, trend, adherence, *blocks) for c in b.columns if c not in v.MEMBER}
    return joins.assemble(half, blocks, v.MEMBER, fill=None).na.fill(numeric_fill)


def build_frame(spark: SparkSession, d: str) -> DataFrame:
    """The member table with the probabilities of the stage-1 models."""
    return base_frame(spark, d, partial(stage1_probabilities, spark, d))


def stage1_table(spark: SparkSession, d: str) -> DataFrame:
    """Stage-1 population under the names of the feature sets, in two halves."""
    population = panel_plans.stage1(spark, d).withColumnsRenamed(
        {"age_cat": "ageCat", "enroll_month": "enrollMonth", "enroll_year": "enrollYear", "prior_coverage": "cov2016yes"})
    individual = profile_plans.recodes(spark, d).select("member_id", *INDIVIDUAL)
    joined = joins.assemble(population, [individual], v.MEMBER, fill=None)
    return sampling.hash_split(joined, v.MEMBER, {"a": 0.5, "b": 0.5}, "stage1")


def _other_half(spark: SparkSession, table: DataFrame, categorical: list[str], name: str, **learner) -> DataFrame:
    """Probability of losing coverage for every member, from a stored model fitted on the half the member is not in."""
    def of(half: str, other: str) -> DataFrame:
        model = ml.fit(table.where(F.col("part") == half), ml.encoder(categorical, []), ml.logistic("lose_coverage", **learner))
        path = f"{shared_dir(spark)}/models/{uuid.uuid4().hex}"
        ml.save_model(model, path)
        mine = ml.batch_score(spark, path, table.where(F.col("part") == other), v.MEMBER)
        return mine.select("member_id", F.col("probability_col").alias(name))

    scored = at_once(partial(of, "a", "b"), partial(of, "b", "a"))
    return scored[0].unionByName(scored[1])


def stage1_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Both stage-1 models' probabilities; members outside the stage-1 population have no row."""
    table = materialize(stage1_table(spark, d), "stage1")
    sets = (codes.STAGE1_BASELINE, codes.STAGE1_CATEGORICAL)
    blocks = at_once(*[
        partial(_other_half, spark, table, [c for c in columns if c in table.columns], name) for name, columns in zip(STAGE1, sets)])
    return materialize(joins.assemble_inner(blocks, v.MEMBER), "stage1-probabilities")


def frame(spark: SparkSession, d: str) -> DataFrame:
    """The member table as a written table: model fitting reads it many times."""
    key, now = (spark.sparkContext.applicationId, d), version(spark, d)
    if key not in _frames or _frames[key][0] != now:
        _frames[key] = (now, materialize(build_frame(spark, d), "member-table"))
    return _frames[key][1]


def parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Train, validation and test parts: 80/20, then 80/20 of the first."""
    shares = {"train": 0.64, "validation": 0.16, "test": 0.2}
    split = sampling.hash_split(frame(spark, d), v.MEMBER, shares, "model")
    return {name: split.where(F.col("part") == name).drop("part") for name in shares}


def feature_set(name: str) -> tuple[list[str], list[str]]:
    stage1 = {"baseline": [], "no_sdoh": STAGE1[:1]}.get(name, STAGE1[1:])
    sets = ml.feature_sets(COUNTS, UTILISATION, AREA, stage1=stage1)
    return ml.restrict_set(sets[name], [*CATEGORICAL, *INDIVIDUAL, *COUNTS, *UTILISATION, *AREA, *STAGE1])


def _settings(trials) -> str:
    return ",".join(f"{k}={x}" for k, x in sorted(trials.items()))


# --- encoding -----------------------------------------------------------------


@query("ml_encode", f"""
    WITH {v.MEMBERS_SQL}, sizes AS (SELECT age_cat, count(*) AS n FROM members GROUP BY 1)
    SELECT age_cat, CAST(row_number() OVER (ORDER BY n DESC, age_cat) - 1 AS DOUBLE) AS age_index,
      CAST(row_number() OVER (ORDER BY n DESC, age_cat) - 1 AS INTEGER) AS hot_slot, n,
      CAST(count(*) OVER () AS INTEGER) AS width FROM sizes""")
def ml_encode(spark: SparkSession, d: str) -> DataFrame:
    people = v.members(spark, d).select("age_cat")
    encoded = Pipeline(stages=ml.encoder(["age_cat"], [])).fit(people).transform(people)
    hot = vector_to_array("features")
    return encoded.select(
        "age_cat", F.col("age_cat_index").alias("age_index"),
        (F.array_position(hot, 1.0) - 1).cast("int").alias("hot_slot"), F.size(hot).alias("width"),
    ).groupBy("age_cat", "age_index", "hot_slot", "width").agg(F.count("*").alias("n"))


@query("ml_scale", f"""
    WITH {v.MEMBERS_SQL}, filled AS (SELECT member_id, coalesce(age, 0) AS age FROM members)
    SELECT member_id, round(age / (SELECT stddev_samp(age) FROM filled), 6) AS scaled_age FROM filled""")
def ml_scale(spark: SparkSession, d: str) -> DataFrame:
    people = v.members(spark, d).select("member_id", F.coalesce("age", F.lit(0.0)).alias("age"))
    encoded = Pipeline(stages=ml.encoder([], ["age"], scale=True)).fit(people).transform(people)
    return encoded.select("member_id", F.round(vector_to_array("features")[0], 6).alias("scaled_age"))


@query("chi_square", f"""
    WITH {v.MEMBERS_SQL}, tested AS (
      SELECT age_cat, sex, race, CAST(coalesce(n, 0) > 0 AS INTEGER) AS label FROM members
      LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_totalprice > 450000) AS n FROM orders GROUP BY 1) ON o_custkey = member_id),
    long AS (SELECT 'age_cat' AS feature, age_cat AS x, label FROM tested UNION ALL SELECT 'sex', sex, label FROM tested
      UNION ALL SELECT 'race', race, label FROM tested),
    grid AS (SELECT f.feature, f.x, y.label FROM (SELECT DISTINCT feature, x FROM long) f CROSS JOIN (SELECT DISTINCT label FROM long) y),
    seen AS (SELECT feature, x, label, count(*) AS n FROM long GROUP BY 1, 2, 3),
    cells AS (SELECT g.*, coalesce(n, 0) AS n FROM grid g LEFT JOIN seen s USING (feature, x, label)),
    expected AS (SELECT *, sum(n) OVER (PARTITION BY feature, x) * 1.0 * sum(n) OVER (PARTITION BY feature, label)
      / sum(n) OVER (PARTITION BY feature) AS e FROM cells),
    tests AS (SELECT feature, CAST((count(DISTINCT x) - 1) * (count(DISTINCT label) - 1) AS INTEGER) AS degrees_of_freedom,
      sum((n - e) * (n - e) / e) AS s FROM expected GROUP BY 1),
    tails AS (SELECT feature, sum(exp(-s / 2 + (degrees_of_freedom / 2 + k) * ln(s / 2) - lgamma(degrees_of_freedom / 2 + k + 1))) AS below
      FROM tests, range(0, 5000) t(k) WHERE s > 0 GROUP BY 1)
    SELECT feature, round(greatest(1 - coalesce(below, 0), 0), 6) AS p_value, degrees_of_freedom, round(s, 6) AS statistic
    FROM tests LEFT JOIN tails USING (feature) ORDER BY p_value, feature""")
def chi_square(spark: SparkSession, d: str) -> DataFrame:
    from cohortlake.plans.evaluation_plans import member_scored

    people = v.members(spark, d).select("member_id", "age_cat", "sex", "race")
    tested = materialize(people.join(member_scored(spark, d).select("member_id", "label"), "member_id"), "labelled")
    result = ml.chi_square(tested, ["age_cat", "sex", "race"], "label")
    return result.select("feature", F.round("p_value", 6).alias("p_value"), "degrees_of_freedom", F.round("statistic", 6).alias("statistic"))


# --- classifiers --------------------------------------------------------------


@query("stage1_train_score", f"""
    WITH {panel_plans.STAGE1_SQL}, drawn AS (
      SELECT member_id, age_cat, lose_coverage, substr(md5(concat_ws('|', CAST(member_id AS VARCHAR), 'stage1')), 1, 8) < '{threshold(0.5)}' AS a
      FROM stage1),
    rates AS (SELECT a, age_cat, avg(lose_coverage) AS p FROM drawn GROUP BY 1, 2)
    SELECT d.member_id, round(p + 1e-6, 3) AS stage1_probability FROM drawn d JOIN rates r ON d.age_cat = r.age_cat AND d.a <> r.a""")
def stage1_train_score(spark: SparkSession, d: str) -> DataFrame:
    """Stage-1 model on one categorical, which saturates it: each member gets the rate of the other half's category."""
    table = materialize(stage1_table(spark, d), "stage1")
    scored = _other_half(spark, table, ["ageCat"], "p", tol=1e-12, maxIter=300)
    # rates of few members end in exact halves: both sides are moved off them
    return scored.select("member_id", F.round(F.col("p") + 1e-6, 3).alias("stage1_probability"))


@query("ml_tree_majority", f"""
    WITH {v.MEMBERS_SQL}, tested AS (
      SELECT state, CAST(coalesce(n, 0) > 0 AS INTEGER) AS label FROM members
      LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_totalprice > 450000) AS n FROM orders GROUP BY 1) ON o_custkey = member_id)
    SELECT state, count(*) AS n, CAST(avg(label) > 0.5 AS DOUBLE) AS prediction FROM tested GROUP BY 1""")
def ml_tree_majority(spark: SparkSession, d: str) -> DataFrame:
    """A forest of one unsampled tree, deep enough for one categorical: it predicts each category's majority."""
    from cohortlake.plans.evaluation_plans import member_scored

    people = v.members(spark, d).select("member_id", "state")
    tested = materialize(people.join(member_scored(spark, d).select("member_id", "label"), "member_id"), "labelled")
    model = ml.fit(tested, ml.encoder(["state"], [], invalid="error"), ml.forest("label", depth=30, trees=1, subset="all", bagging=False))
    return ml.score(model, tested).groupBy("state", "prediction").agg(F.count("*").alias("n"))


@query("ml_logreg", f"""
    WITH {v.MEMBERS_SQL}, tested AS (
      SELECT age_cat, CAST(coalesce(n, 0) > 0 AS INTEGER) AS label FROM members
      LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_totalprice > 450000) AS n FROM orders GROUP BY 1) ON o_custkey = member_id)
    SELECT age_cat, count(*) AS n, round(avg(label), 3) AS probability FROM tested GROUP BY 1""")
def ml_logreg(spark: SparkSession, d: str) -> DataFrame:
    """Unpenalised fit on one categorical: the model is saturated, so the fitted
    probability of each category is its observed rate."""
    from cohortlake.plans.evaluation_plans import member_scored

    people = v.members(spark, d).select("member_id", "age_cat")
    tested = materialize(people.join(member_scored(spark, d).select("member_id", "label"), "member_id"), "labelled")
    model = ml.fit(tested, ml.encoder(["age_cat"], [], invalid="error"), ml.logistic("label", tol=1e-10))
    return ml.score(model, tested).groupBy("age_cat").agg(
        F.count("*").alias("n"), F.round(F.avg("probability_col"), 3).alias("probability"))


def _search_sets(encoders, train: DataFrame, validation: DataFrame) -> list[DataFrame]:
    """Both parts encoded and kept."""
    return [encoders.transform(x).select(LABEL, ml.FEATURES).persist() for x in (train, validation)]


def _classifier_report(spark: SparkSession, d: str, name: str, build, settings: list[dict]) -> DataFrame:
    """Grid choice on train and validation, refit on train, then metrics on train and test."""
    p = parts(spark, d)
    stages = ml.encoder(*feature_set(name))
    chosen, _, _ = ml.choose_by_mcc(p["train"], p["validation"], stages, LABEL, build, settings)
    return _part_report(ml.fit(p["train"], stages, build(label=LABEL, **chosen)), p, chosen)


def _part_report(model, p: dict[str, DataFrame], chosen: dict) -> DataFrame:
    rows = None
    for part in ("train", "test"):
        row = ml.evaluate(ml.score(model, p[part]), LABEL).select(
            F.lit(part).alias("part"), F.lit(_settings(chosen)).alias("chosen"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("ml_elastic_net")
def ml_elastic_net(spark: SparkSession, d: str) -> DataFrame:
    """All 42 points fitted together on the whole training part, the best on validation refitted on it."""
    p = parts(spark, d)
    stages = ml.encoder(*feature_set("no_sdoh"))
    encoders = Pipeline(stages=stages).fit(p["train"])
    sets = _search_sets(encoders, p["train"], p["validation"])
    points = ml.grid(reg=codes.ELASTIC_NET_REG, mix=codes.ELASTIC_NET_MIX)
    chosen, _ = penalised.choose(*sets, LABEL, points)
    for x in sets:
        x.unpersist()
    return _part_report(ml.fit(p["train"], stages, ml.logistic(label=LABEL, **chosen)), p, chosen)


@query("ml_gbt_classifier")
def ml_gbt(spark: SparkSession, d: str) -> DataFrame:
    """Two depths of Spark's learner, all trees, each grown on every training row."""
    settings = ml.grid(depth=[2, 3], trees=[codes.BOOSTED_TREES], step=[0.1], subsample=[1.0])
    return _classifier_report(spark, d, "area_sdoh", ml.boosted_classifier, settings)


def forest_points(spark: SparkSession, d: str) -> DataFrame:
    """The whole forest grid on the whole training part, valued on validation."""
    p = parts(spark, d)
    encoders = Pipeline(stages=ml.encoder(*feature_set("baseline"))).fit(p["train"])
    sets = _search_sets(encoders, p["train"], p["validation"])
    points = trees.search_forests(*sets, LABEL, codes.FOREST_GRID)
    for x in sets:
        x.unpersist()
    return points


@query("ml_random_forest")
def ml_forest(spark: SparkSession, d: str) -> DataFrame:
    """The best point of the forest grid, refitted on the whole training part; metrics on train and test."""
    chosen = trees.best_point(forest_points(spark, d))
    chosen.pop("mcc")
    p = parts(spark, d)
    model = ml.fit(p["train"], ml.encoder(*feature_set("baseline")), ml.forest(LABEL, **chosen))
    return _part_report(model, p, chosen)


@query("ml_downsampled_forest")
def ml_downsampled(spark: SparkSession, d: str) -> DataFrame:
    """Forest on a training part with the common class thinned; the test part is untouched."""
    p = parts(spark, d)
    thinned = sampling.downsample(p["train"], v.MEMBER, LABEL, {0.0: 0.5}, "thin")
    model = ml.fit(thinned, ml.encoder(*feature_set("baseline")), ml.forest(LABEL, depth=4, trees=10))
    return ml.evaluate(ml.score(model, p["test"]), LABEL)


_LABELLED_SQL = f"""{v.MEMBERS_SQL}, tested AS (
  SELECT member_id, age_cat, CAST(coalesce(n, 0) > 0 AS INTEGER) AS label, substr(md5(concat_ws('|', CAST(member_id AS VARCHAR), 'score')), 1, 8) AS w
  FROM members LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_totalprice > 450000) AS n FROM orders GROUP BY 1) ON o_custkey = member_id)"""


@query("ml_batch_score", f"""
    WITH {_LABELLED_SQL}, rates AS (SELECT age_cat, avg(label) AS p FROM tested WHERE w < '{threshold(0.8)}' GROUP BY 1)
    SELECT member_id, round(p, 3) AS probability_col, CAST(p > 0.5 AS DOUBLE) AS prediction FROM tested JOIN rates USING (age_cat)""")
def ml_batch_score(spark: SparkSession, d: str) -> DataFrame:
    """Fit on the training part, store, load and score every member."""
    from cohortlake.plans.evaluation_plans import member_scored

    people = v.members(spark, d).select("member_id", "age_cat")
    labelled = people.join(member_scored(spark, d).select("member_id", "label"), "member_id")
    shares = {"train": 0.8, "test": 0.2}
    tested = materialize(sampling.hash_split(labelled, v.MEMBER, shares, "score"), "split")
    train = tested.where(F.col("part") == "train")
    model = ml.fit(train, ml.encoder(["age_cat"], [], invalid="error"), ml.logistic("label", tol=1e-10))
    path = f"{shared_dir(spark)}/models/{uuid.uuid4().hex}"
    ml.save_model(model, path)
    scored = ml.batch_score(spark, path, tested, v.MEMBER)
    return scored.withColumn("probability_col", F.round("probability_col", 3))


def _boosted(spark: SparkSession, d: str):
    """A boosted classifier on the widest registered set, its node table and slot names."""
    train = parts(spark, d)["train"]
    model = ml.fit(train, ml.encoder(*feature_set("area_sdoh")), ml.boosted_classifier(LABEL, depth=3, trees=5))
    return trees.tree_nodes(model.stages[-1], spark), ml.attribute_names(model.transform(train))


@query("top_k_importance")
def top_k_importance(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen features of the largest gain, from the stored model's node table."""
    nodes, names = _boosted(spark, d)
    found = trees.gain_importance(nodes, names, by_tree=False).withColumn("value", F.col("importance"))
    return ml.top_k(found.select("feature", "value", "importance"), 15)


@query("unused_features")
def unused_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of the same model that no tree splits on."""
    return trees.unused(*_boosted(spark, d))


@query("coefficient_importance", f"""
    WITH {v.PERSONS_SQL}, {claim_plans.POST_COST_SQL}, totals AS (
      SELECT member_id, CAST(sum(mc + ffs) AS DOUBLE) AS cost FROM post_costed GROUP BY 1),
    means AS (SELECT state, avg(coalesce(cost, 0)) AS mean_cost, row_number() OVER (ORDER BY count(*) DESC, state) AS place
      FROM persons LEFT JOIN totals USING (member_id) GROUP BY 1),
    base AS (SELECT mean_cost AS base_cost FROM means ORDER BY place DESC LIMIT 1),
    coefficients AS (SELECT 'state_vec_' || state AS feature, mean_cost - base_cost AS value FROM means, base
      WHERE place < (SELECT max(place) FROM means))
    SELECT feature, round(value, 2) AS value, round(abs(value), 2) AS importance FROM coefficients
    ORDER BY abs(value) DESC, feature LIMIT 15""")
def coefficient_importance(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients by absolute value. With one categorical each coefficient is the
    category's mean cost less that of the dropped category."""
    people = materialize(v.members(spark, d).select("member_id", "state").join(
        claim_plans.total_cost(spark, d).select("member_id", "total_cost"), "member_id"), "state-cost")
    model = ml.fit(people, ml.encoder(["state"], [], invalid="error"), ml.linear("total_cost", solver="normal"))
    top = ml.top_k(ml.importance_table(model, people), 15)
    return top.select("feature", F.round("value", 2).alias("value"), F.round("importance", 2).alias("importance"))


# --- cost models --------------------------------------------------------------


@query("ml_linear_regression", f"""
    WITH {v.MEMBERS_SQL}, {claim_plans.POST_COST_SQL}, totals AS (
      SELECT member_id, CAST(sum(mc + ffs) AS DOUBLE) AS cost FROM post_costed GROUP BY 1)
    SELECT age_cat, count(*) AS n, round(avg(coalesce(cost, 0)), 2) AS predicted_cost
    FROM members LEFT JOIN totals USING (member_id) GROUP BY 1""")
def ml_linear_regression(spark: SparkSession, d: str) -> DataFrame:
    """Least squares on one categorical: the prediction of each category is its mean cost."""
    people = materialize(v.members(spark, d).select("member_id", "age_cat").join(
        claim_plans.total_cost(spark, d).select("member_id", "total_cost"), "member_id"), "age-cost")
    stages = ml.encoder(["age_cat"], [], invalid="error")
    model = ml.fit(people, stages, ml.linear("total_cost", solver="normal"))
    return model.transform(people).groupBy("age_cat").agg(
        F.count("*").alias("n"), F.round(F.avg("prediction"), 2).alias("predicted_cost"))


@query("ml_boosted_leaf_means", f"""
    WITH {v.MEMBERS_SQL}, {claim_plans.POST_COST_SQL}, totals AS (
      SELECT member_id, CAST(sum(mc + ffs) AS DOUBLE) AS cost FROM post_costed GROUP BY 1)
    SELECT age_cat, count(*) AS n, round(avg(coalesce(cost, 0)), 2) AS predicted_cost
    FROM members LEFT JOIN totals USING (member_id) GROUP BY 1""")
def ml_boosted_leaf_means(spark: SparkSession, d: str) -> DataFrame:
    """Boosting stopped after its first tree, on one categorical: each leaf predicts its category's mean cost."""
    people = materialize(v.members(spark, d).select("member_id", "age_cat").join(
        claim_plans.total_cost(spark, d).select("member_id", "total_cost"), "member_id"), "age-cost")
    model = ml.fit(people, ml.encoder(["age_cat"], [], invalid="error"), ml.boosted_regressor("total_cost", depth=8, trees=1))
    return model.transform(people).groupBy("age_cat").agg(
        F.count("*").alias("n"), F.round(F.avg("prediction"), 2).alias("predicted_cost"))


@query("cost_slope_by_stratum", f"""
    WITH {v.MEMBERS_SQL}, {claim_plans.POST_COST_SQL}, totals AS (
      SELECT member_id, CAST(sum(mc + ffs) AS DOUBLE) AS cost FROM post_costed GROUP BY 1),
    placed AS (
      SELECT CASE WHEN disabled = 'yes' THEN 'disabled' WHEN disabled = 'no' AND age_cat IN ('under10', '10To17') THEN 'kids'
          WHEN disabled = 'no' AND age_cat <> 'missing' THEN 'adults' END AS stratum,
        CAST(member_id % 2 AS DOUBLE) AS x, coalesce(cost, 0) AS y FROM members LEFT JOIN totals USING (member_id))
    SELECT stratum, round(regr_slope(y, x), 2) AS slope, round(regr_intercept(y, x), 2) AS intercept
    FROM placed WHERE stratum IS NOT NULL GROUP BY 1""")
def cost_slope_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    """Unpenalised least squares on one 0/1 column, fitted apart for each stratum."""
    from cohortlake.operators.cost import stratum

    people = v.members(spark, d).select(
        "member_id", stratum(F.col("age_cat"), F.col("disabled")).alias("stratum"), (F.col("member_id") % 2).cast("double").alias("x"))
    table = materialize(people.join(claim_plans.total_cost(spark, d).select("member_id", "total_cost"), "member_id"), "stratum-cost")
    rows = []
    for name in ("adults", "kids", "disabled"):
        model = ml.fit(table.where(F.col("stratum") == name), ml.encoder([], ["x"]), ml.linear("total_cost", solver="normal")).stages[-1]
        rows.append((name, float(model.coefficients[0]), float(model.intercept)))
    fitted = spark.createDataFrame(rows, "stratum string, slope double, intercept double")
    return fitted.select("stratum", F.round("slope", 2).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("ml_gbt_regressor")
def ml_gbt_regressor(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    settings = ml.grid(depth=[2, 3], trees=[5], step=[0.1])
    stages = ml.encoder(*feature_set("area_sdoh"))
    chosen, _, _ = ml.choose_by_r2(p["train"], p["validation"], stages, "total_cost", ml.boosted_regressor, settings)
    model = ml.fit(p["train"], stages, ml.boosted_regressor("total_cost", **chosen))
    scored = model.transform(p["test"])
    return evaluation.regression_metrics(scored, "total_cost", "prediction").withColumn("chosen", F.lit(_settings(chosen)))
