"""Encoding, learners, grid choice, scoring and importances on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.operators.evaluation import CELLS, auc_from_counts, confusion_cells, metric_columns, score_bounds

FEATURES = "features"


def encoder(categorical: Sequence[str], numeric: Sequence[str], invalid: str = "keep",
            scale: bool = False) -> list[Estimator]:
    """Index (by frequency, ties alphabetical), one-hot without the last category, assemble.

    With ``scale`` the numeric block is divided by its standard deviation and the scaled
    block is what enters the feature vector.
    """
    stages: list = []
    inputs: list[str] = []
    if categorical:
        indexed = [f"{c}_index" for c in categorical]
        vectors = [f"{c}_vec" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid=invalid))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=vectors))
        inputs += vectors
    if numeric and scale:
        stages.append(VectorAssembler(inputCols=list(numeric), outputCol="numeric_block", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="numeric_block", outputCol="numeric_scaled", withMean=False, withStd=True))
        inputs.append("numeric_scaled")
    else:
        inputs += list(numeric)
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="keep"))
    return stages


def feature_sets(counts: Sequence[str], utilisation: Sequence[str], area: Sequence[str] = tuple(codes.AREA_RATES),
                 individual: Sequence[str] = tuple(codes.INDIVIDUAL_CATEGORICAL),
                 stage1: Sequence[str] = ()) -> dict[str, tuple[list, list]]:
    """Named (categorical, numeric) column lists; the numeric blocks come from the data, ``stage1`` are
    the probabilities of the stage-1 models."""
    base = codes.STAGE2_CATEGORICAL
    numeric = [*utilisation, *counts, *stage1]
    return {
        "baseline": (list(codes.STAGE2_BASELINE), list(counts)),
        "no_sdoh": (list(base), numeric),
        "area_sdoh": (list(base), [*numeric, *area]),
        "area_individual": ([*base, *individual], [*numeric, *area]),
        "no_race": ([c for c in base if c != "race"], [*numeric, *area]),
    }


def restrict_set(feature_set: tuple[Sequence[str], Sequence[str]], available: Sequence[str]) -> tuple[list, list]:
    """A feature set limited to the columns a table has."""
    categorical, numeric = feature_set
    return [c for c in categorical if c in available], [c for c in numeric if c in available]


def logistic(label: str, reg: float = 0.0, mix: float = 0.0, **extra) -> LogisticRegression:
    return LogisticRegression(featuresCol=FEATURES, labelCol=label, regParam=reg, elasticNetParam=mix, **extra)


def boosted_classifier(label: str, depth: int = 5, trees: int = 20, step: float = 0.1, subsample: float = 1.0,
                       subset: str = "all", gain: float = 0.0, leaf: int = 1, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(featuresCol=FEATURES, labelCol=label, maxDepth=depth, maxIter=trees, stepSize=step,
                         subsamplingRate=subsample, featureSubsetStrategy=subset, minInfoGain=gain,
                         minInstancesPerNode=leaf, seed=seed)


def forest(label: str, depth: int = 20, trees: int = 50, leaf: int = 1, subset: str = "sqrt",
           bagging: bool = True, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=label, maxDepth=depth, numTrees=trees,
                                  minInstancesPerNode=leaf, featureSubsetStrategy=subset, bootstrap=bagging, seed=seed)


def boosted_regressor(label: str, depth: int = 5, trees: int = 20, step: float = 0.1, subsample: float = 1.0,
                      subset: str = "all", gain: float = 0.0, leaf: int = 1, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(featuresCol=FEATURES, labelCol=label, maxDepth=depth, maxIter=trees, stepSize=step,
                        subsamplingRate=subsample, featureSubsetStrategy=subset, minInfoGain=gain,
                        minInstancesPerNode=leaf, seed=seed)


def linear(label: str, **extra) -> LinearRegression:
    return LinearRegression(featuresCol=FEATURES, labelCol=label, **extra)


def fit(train: DataFrame, stages: Sequence[Estimator], learner: Estimator) -> PipelineModel:
    return Pipeline(stages=[*stages, learner]).fit(train)


def class_probability(column: str = "probability", cls: int = 1) -> Column:
    """One class's probability from the probability vector, without a Python UDF."""
    return vector_to_array(column)[cls]


def score(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("probability_col", class_probability())


def evaluate(scored: DataFrame, label: str, digits: int = 6) -> DataFrame:
    """AUC, cells and metrics of one scored set as one row.

    Everything is computed from one aggregate by (score, label, class): the model runs
    over the data once, and the uses share that shuffle.
    """
    grouped = scored.groupBy("probability_col", label, "prediction").agg(F.count("*").alias("rows")).where("rows > 0")
    rows = F.col("rows")
    metrics = grouped.agg(*confusion_cells(label, "prediction", rows)).select(
        *CELLS, *[F.round(c, digits).alias(n) for n, c in metric_columns().items()])
    counts = grouped.groupBy("probability_col").agg(
        F.sum(F.when(F.col(label) == 1, rows).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, rows).otherwise(0)).alias("neg"))
    auc = auc_from_counts(counts, "probability_col", score_bounds(grouped, "probability_col"))
    return metrics.withColumn("auc", auc.select(F.round("auc", digits)).scalar())


def mcc_value(scored: DataFrame, label: str) -> float:
    return scored.agg(*confusion_cells(label, "prediction")).select(metric_columns()["mcc"]).first()[0]


def grid(**axes: Sequence) -> list[dict]:
    """Every combination of the listed settings."""
    names = list(axes)
    return [dict(zip(names, values)) for values in product(*axes.values())]


def _choose(train, validation, stages, label, build, settings, value_of, parallel):
    """Fit every setting, a bounded number at a time, and keep the best on validation.

    The encoders are fitted once and both sets encoded once; only the learner is refitted. The driver
    holds one number per setting and the best model so far; the first of equal settings wins.
    """
    encoders = Pipeline(stages=list(stages)).fit(train)
    encoded = encoders.transform(train).select(label, FEATURES).persist()
    held_out = encoders.transform(validation).select(label, FEATURES).persist()

    def trial(setting):
        model = build(label=label, **setting).fit(encoded)
        return dict(setting), value_of(model.transform(held_out)), model

    trials, best = [], None
    with ThreadPool(parallel) as pool:
        for setting, value, model in pool.imap(trial, settings):
            trials.append((setting, value))
            if best is None or (value is not None and (best[1] is None or value > best[1])):
                best = (setting, value, model)
    encoded.unpersist()
    held_out.unpersist()
    return best[0], PipelineModel(stages=[*encoders.stages, best[2]]), trials


def choose_by_mcc(train: DataFrame, validation: DataFrame, stages: Sequence[Estimator], label: str, build,
                  settings: Sequence[Mapping], parallel: int = 4) -> tuple[dict, PipelineModel, list[tuple[dict, float]]]:
    """The setting with the best correlation coefficient on validation, its model, and all values."""
    return _choose(train, validation, stages, label, build, settings, lambda scored: mcc_value(scored, label), parallel)


def choose_by_r2(train: DataFrame, validation: DataFrame, stages: Sequence[Estimator], label: str, build,
                 settings: Sequence[Mapping], parallel: int = 4) -> tuple[dict, PipelineModel, list[tuple[dict, float]]]:
    """As :func:`choose_by_mcc` for regression, by R-squared."""
    from cohortlake.operators.evaluation import regression_columns, regression_sums

    def r2(scored: DataFrame) -> float | None:
        return scored.agg(*regression_sums(label, "prediction")).select(regression_columns()["r2"]).first()[0]

    return _choose(train, validation, stages, label, build, settings, r2, parallel)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def batch_score(spark: SparkSession, path: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score with a stored model; probability of class 1 and the predicted class per key."""
    return score(PipelineModel.load(path), df).select(*keys, "probability_col", "prediction")


def attribute_names(df: DataFrame, column: str = FEATURES, scaled: Sequence[str] = ()) -> list[str]:
    """Vector slot names from the column metadata, in slot order.

    Scaling drops the names of the numeric block; ``scaled`` lists them in order.
    """
    attrs = df.schema[column].metadata["ml_attr"]["attrs"]
    slots = [a for block in attrs.values() for a in block]
    given = {f"numeric_scaled_{i}": name for i, name in enumerate(scaled)}
    return [given.get(a["name"], a["name"]) for a in sorted(slots, key=lambda a: a["idx"])]


def importance_table(model: PipelineModel, sample: DataFrame, scaled: Sequence[str] = ()) -> DataFrame:
    """Feature, value and absolute value: coefficients of a linear learner or tree gains.

    The table has one row per vector slot, so it is as small as the model itself.
    """
    learner = model.stages[-1]
    values = learner.coefficients if hasattr(learner, "coefficients") else learner.featureImportances
    names = attribute_names(model.transform(sample), scaled=scaled)
    rows = [(n, float(v), abs(float(v))) for n, v in zip(names, values.toArray())]
    return sample.sparkSession.createDataFrame(rows, "feature string, value double, importance double")


def top_k(importance: DataFrame, k: int) -> DataFrame:
    """The k most important features."""
    return importance.orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def unused_features(importance: DataFrame) -> DataFrame:
    """Slots the learner never used."""
    return importance.where(F.col("importance") == 0).select("feature")


def chi_square(df: DataFrame, categorical: Sequence[str], label: str) -> DataFrame:
    """Independence test of each categorical column against the label, strongest first."""
    indexed = [f"{c}_index" for c in categorical]
    stages = [
        StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
        VectorAssembler(inputCols=indexed, outputCol=FEATURES),
    ]
    encoded = Pipeline(stages=stages).fit(df).transform(df)
    names = F.array(*[F.lit(c) for c in categorical])
    tested = ChiSquareTest.test(encoded, FEATURES, label, flatten=True)
    return tested.select(
        F.element_at(names, F.col("featureIndex") + 1).alias("feature"),
        F.col("pValue").alias("p_value"), F.col("degreesOfFreedom").alias("degrees_of_freedom"),
        F.col("statistic").alias("statistic"),
    ).orderBy("p_value", "feature")
