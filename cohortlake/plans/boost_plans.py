"""Second-order boosting at the settings that the searches chose, and a tree with a closed answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.operators import boost, evaluation, gram, ml
from cohortlake.plans import claim_plans, gram_plans, ml_plans, views as v
from cohortlake.plans.registry import query
from cohortlake.session import materialize

LABEL, TARGET = ml_plans.LABEL, gram_plans.TARGET


def encoded(spark: SparkSession, d: str, name: str, label: str) -> tuple[dict[str, DataFrame], list[str]]:
    """Training and test part of a named feature set, categories as 0/1 columns."""
    categorical, numeric = ml_plans.feature_set(name)
    slots = {}
    for c in categorical:
        slots |= gram.dummies(c, gram_plans.LEVELS[c])
    slots |= {c: F.col(c) for c in numeric}
    names = {f"f{i}": column for i, column in enumerate(slots.values())}
    parts = ml_plans.parts(spark, d)
    return {p: parts[p].select("member_id", label, *[c.alias(n) for n, c in names.items()]) for p in ("train", "test")}, list(names)


@query("boosted_chosen_classifier")
def boosted_classifier(spark: SparkSession, d: str) -> DataFrame:
    """The chosen settings of the stage-2 classifier; metrics on train and test."""
    sets, columns = encoded(spark, d, "area_sdoh", LABEL)
    model = boost.fit(sets["train"], "member_id", LABEL, columns, boost.Settings(**codes.BOOSTED_CHOSEN))
    rows = None
    for part, df in sets.items():
        scored = boost.predict(model, df, "member_id", LABEL).select(
            F.col("y").alias(LABEL), F.col("prediction").alias("probability_col"), (F.col("prediction") > 0.5).cast("double").alias("prediction"))
        row = ml.evaluate(scored, LABEL).select(F.lit(part).alias("part"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("boosted_chosen_cost")
def boosted_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost regression with every axis of the reference's grid in use."""
    sets, columns = encoded(spark, d, "no_sdoh", TARGET)
    model = boost.fit(sets["train"], "member_id", TARGET, columns, boost.Settings(logistic=False, **codes.COST_BOOSTED))
    scored = boost.predict(model, sets["test"], "member_id", TARGET)
    return evaluation.regression_metrics(scored, "y", "prediction")


STUMP = {"age_cat": gram_plans.LEVELS["ageCat"], "sex": ["male", "female"], "race": gram_plans.LEVELS["race"], "disabled": ["yes", "no"], "state": v.STATES}
PENALTY, DRAW = 2.0, 0.5


def _score_sql(g: str, h: str) -> str:
    return f"power(greatest(abs({g}) - {DRAW}, 0), 2) / ({h} + {PENALTY})"


def _weight_sql(g: str, h: str) -> str:
    return f"-sign({g}) * greatest(abs({g}) - {DRAW}, 0) / ({h} + {PENALTY})"


_SIDES_SQL = " UNION ALL ".join(
    f"SELECT '{c}={x}' AS feature, count(*) AS h1, sum((SELECT b FROM whole) - y) AS g1 FROM placed WHERE {c} = '{x}'"
    for c, levels in STUMP.items() for x in levels)


@query("boosted_stump", f"""
    WITH {v.MEMBERS_SQL}, {claim_plans.POST_COST_SQL}, totals AS (
      SELECT member_id, CAST(sum(mc + ffs) AS DOUBLE) AS cost FROM post_costed GROUP BY 1),
    placed AS (SELECT members.*, coalesce(cost, 0) AS y FROM members LEFT JOIN totals USING (member_id)),
    whole AS (SELECT any_value(b) AS b, count(*) AS n, sum(b - y) AS g FROM placed, (SELECT avg(y) AS b FROM placed)),
    sides AS ({_SIDES_SQL}),
    judged AS (
      SELECT feature, h1, g1, n - h1 AS h0, g - g1 AS g0, b,
        {_score_sql("g1", "h1")} + {_score_sql("(g - g1)", "(n - h1)")} - {_score_sql("g", "n")} AS gained
      FROM sides, whole WHERE h1 BETWEEN 1 AND n - 1)
    SELECT feature, round(gained / 1e6, 2) AS gain, h1 AS n, round(b + {_weight_sql("g1", "h1")}, 2) AS predicted_with,
      round(b + {_weight_sql("g0", "h0")}, 2) AS predicted_without
    FROM judged ORDER BY gained DESC LIMIT 1""")
def boosted_stump(spark: SparkSession, d: str) -> DataFrame:
    """The one split that a tree of depth one makes over all 0/1 columns of five categories, with penalties."""
    people = v.members(spark, d).join(claim_plans.total_cost(spark, d).select("member_id", TARGET), "member_id")
    slots = {}
    for c, levels in STUMP.items():
        slots |= gram.dummies(c, levels)
    names = {f"f{i}": name for i, name in enumerate(slots)}
    table = materialize(people.select("member_id", TARGET, *[c.alias(n) for n, c in zip(names, slots.values())]), "stump")
    settings = boost.Settings(trees=1, step=1.0, depth=1, alpha=DRAW, lambda_=PENALTY, logistic=False)
    model = boost.fit(table, "member_id", TARGET, list(names), settings)
    if not model.trees or model.trees[0].feature[0] < 0:
        return spark.createDataFrame([], "feature string, gain double, n bigint, predicted_with double, predicted_without double")
    tree = model.trees[0]
    column = list(names)[tree.feature[0]]
    scored = boost.predict(model, table.withColumn("has", F.col(column)), "member_id", TARGET, ["has"])
    mean = lambda x: F.round(F.max(F.when(F.col("has") == x, F.col("prediction"))), 2)
    found = scored.agg(F.sum("has").cast("bigint").alias("n"), mean(1).alias("predicted_with"), mean(0).alias("predicted_without"))
    return found.select(
        F.lit(names[column]).alias("feature"), F.round(F.lit(tree.gain[0]) / 1e6, 2).alias("gain"), "n", "predicted_with", "predicted_without")
