"""What the searches of the learners are fitted on."""

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.operators import ml, penalised, trees
from cohortlake.plans import ml_plans


class Seen(Exception):
    pass


@pytest.fixture(scope="module")
def member_table(spark):
    """400 members with every column that a feature set may name."""
    k = F.col("member_id")
    texts = [F.concat(F.lit("v"), (k % 3).cast("string")).alias(c) for c in dict.fromkeys([*ml_plans.CATEGORICAL, *ml_plans.INDIVIDUAL])]
    numbers = [((k * (7 + i)) % 11).cast("double").alias(c) for i, c in enumerate([*ml_plans.COUNTS, *ml_plans.UTILISATION, *ml_plans.AREA, *ml_plans.STAGE1])]
    label, cost = ((k * 5) % 7 > 3).cast("double"), ((k * 31) % 97).cast("double")
    return spark.range(400).select(F.col("id").alias("member_id")).select("member_id", *texts, *numbers, label.alias("outcome"), cost.alias("total_cost")).persist()


@pytest.fixture
def rows_seen(spark, member_table, monkeypatch):
    """Runs a query up to its search, and gives the rows that the search is fitted on and those of the training part."""
    monkeypatch.setattr(ml_plans, "frame", lambda s, d: member_table)
    # a bound on the rows of a search, where one is in force
    monkeypatch.setattr(codes, "SEARCH_ROWS", 60, raising=False)

    def run(module, search, plan):
        def see(train, *rest, **more):
            raise Seen(train.count())

        monkeypatch.setattr(module, search, see)
        with pytest.raises(Seen) as seen:
            plan(spark, "")
        return seen.value.args[0], ml_plans.parts(spark, "")["train"].count()

    return run


def test_elastic_net_is_searched_on_every_training_row(rows_seen):
    seen, whole = rows_seen(penalised, "choose", ml_plans.ml_elastic_net)
    assert seen == whole > 200


def test_boosted_cost_is_searched_on_every_training_row(rows_seen):
    seen, whole = rows_seen(ml, "choose_by_r2", ml_plans.ml_gbt_regressor)
    assert seen == whole > 200


def test_the_forest_grid_is_searched_on_every_training_row(rows_seen):
    seen, whole = rows_seen(trees, "search_forests", ml_plans.forest_points)
    assert seen == whole > 200


def test_the_boosted_classifier_is_searched_on_every_row_with_all_trees(rows_seen, monkeypatch):
    seen, whole = rows_seen(ml, "choose_by_mcc", ml_plans.ml_gbt)
    assert seen == whole > 200
    points = []

    def see(train, validation, stages, label, build, settings):
        points.extend(settings)
        raise Seen(0)

    monkeypatch.setattr(ml, "choose_by_mcc", see)
    with pytest.raises(Seen):
        ml_plans.ml_gbt(None, "")
    assert points and all(p["trees"] == 100 and p.get("subsample", 1.0) == 1.0 for p in points)
