"""Splits, samples, model metrics, bootstrap intervals and group comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.hashing import poisson_levels, threshold
from cohortlake.functions.recode import race_group
from cohortlake.operators import bootstrap, evaluation, joins, profile, sampling
from cohortlake.plans import views as v
from cohortlake.plans.registry import query
from cohortlake.sources.tables import load


def _word_sql(key: str, salt: str) -> str:
    return f"substr(md5(concat_ws('|', {key}, '{salt}')), 1, 8)"


# --- splits and samples -------------------------------------------------------


@query("hash_split", f"""
    WITH drawn AS (SELECT c_custkey AS member_id, {_word_sql('CAST(c_custkey AS VARCHAR)', 'stage')} AS w FROM customer)
    SELECT member_id, CASE WHEN w < '{threshold(0.8)}' THEN 'train' ELSE 'test' END AS part FROM drawn""")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    people = load(spark, d, "customer", F.col("c_custkey").alias("member_id"))
    return sampling.hash_split(people, v.MEMBER, {"train": 0.8, "test": 0.2}, "stage")


@query("cohort_halves", f"""
    WITH ids AS (SELECT DISTINCT o_custkey AS member_id FROM orders),
    drawn AS (SELECT member_id, {_word_sql('CAST(member_id AS VARCHAR)', 'half')} AS w FROM ids)
    SELECT CASE WHEN w < '{threshold(0.5)}' THEN 'stage1' ELSE 'stage2' END AS part, count(*) AS claims,
      count(DISTINCT member_id) AS members FROM orders JOIN drawn ON o_custkey = member_id GROUP BY 1""")
def cohort_halves(spark: SparkSession, d: str) -> DataFrame:
    # the part is a function of the person, so no join back is needed
    claims = v.headers(spark, d).select("claim_id", "member_id")
    halves = sampling.hash_split(claims, v.MEMBER, {"stage1": 0.5, "stage2": 0.5}, "half")
    per_member = halves.groupBy("part", "member_id").agg(F.count("*").alias("claims"))
    return per_member.groupBy("part").agg(F.sum("claims").alias("claims"), F.count("*").alias("members"))


@query("hash_sample", f"""
    SELECT o_orderkey AS claim_id, 'fraction' AS kind FROM orders
    WHERE {_word_sql('CAST(o_orderkey AS VARCHAR)', 'sample')} < '{threshold(0.25)}'
    UNION ALL SELECT o_orderkey, 'target' FROM orders
    WHERE CAST(('0x' || {_word_sql('CAST(o_orderkey AS VARCHAR)', 'target')}) AS BIGINT) * CAST((SELECT count(*) FROM orders) AS DOUBLE)
      < {float(500 * 2**32)}""")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    claims = load(spark, d, "orders", F.col("o_orderkey").alias("claim_id"))
    by_fraction = sampling.hash_sample(claims, ["claim_id"], 0.25, "sample").withColumn("kind", F.lit("fraction"))
    by_target = sampling.sample_to_size(claims, ["claim_id"], 500, "target").withColumn("kind", F.lit("target"))
    return by_fraction.unionByName(by_target)


@query("stratified_downsample", f"""
    WITH {v.MEMBERS_SQL}, drawn AS (
      SELECT member_id, race, {_word_sql('CAST(member_id AS VARCHAR)', 'train')} AS t,
        {_word_sql('CAST(member_id AS VARCHAR)', 'down')} AS w FROM members)
    SELECT member_id, race FROM drawn WHERE t < '{threshold(0.8)}' AND w < CASE race WHEN 'white' THEN '{threshold(0.35)}'
      WHEN 'missing' THEN '{threshold(0.1)}' ELSE 'g' END""")
def downsample(spark: SparkSession, d: str) -> DataFrame:
    people = v.members(spark, d).select("member_id", "race")
    train = sampling.hash_split(people, v.MEMBER, {"train": 0.8, "test": 0.2}, "train").where(F.col("part") == "train")
    return sampling.downsample(train, v.MEMBER, "race", {"white": 0.35, "missing": 0.1}, "down").drop("part")


# --- classification metrics ---------------------------------------------------

METRICS_SQL = """
  tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS sensitivity, tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS specificity,
  tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS ppv, tn / nullif(CAST(tn + fn AS DOUBLE), 0) AS npv,
  (tp + tn) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0) AS accuracy,
  coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
    / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc,
  2.0 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0) AS f1"""
METRICS = ["sensitivity", "specificity", "ppv", "npv", "accuracy", "mcc", "f1"]
ROUNDED_SQL = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


def _cells_sql(weight: str = "1") -> str:
    tests = {"tp": (1, 1), "tn": (0, 0), "fp": (1, 0), "fn": (0, 1)}
    return ", ".join(
        f"CAST(sum(CASE WHEN prediction = {p} AND label = {y} THEN {weight} ELSE 0 END) AS BIGINT) AS {n}"
        for n, (p, y) in tests.items())


@query("confusion_metrics", f"""
    WITH {v.SCORED_SQL}, cells AS (SELECT {_cells_sql()} FROM scored), metrics AS (SELECT *, {METRICS_SQL} FROM cells)
    SELECT tp, tn, fp, fn, {ROUNDED_SQL} FROM metrics""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion_metrics(v.scored(spark, d), "label", "prediction")


@query("auc_rank", f"""
    WITH {v.SCORED_SQL}, ranked AS (
      SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored),
    sums AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n, sum(r) FILTER (label = 1) AS s FROM ranked)
    SELECT p AS positives, n AS negatives, round((s - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n), 6) AS auc FROM sums""")
def auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.auc_rank(v.scored(spark, d), "score", "label").withColumn("auc", F.round("auc", 6))


@query("auc_large", """
    WITH scored AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_extendedprice AS score FROM lineitem),
    ranked AS (
      SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored),
    sums AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n,
      sum(CAST(2 * r AS BIGINT)) FILTER (label = 1) AS s2 FROM ranked)
    SELECT p AS positives, n AS negatives,
      round(CAST(s2 - CAST(p AS HUGEINT) * (p + 1) AS DOUBLE) / (2.0 * p * n), 6) AS auc FROM sums""")
def auc_large(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "lineitem", "l_returnflag", F.col("l_extendedprice").alias("score"))
    labelled = raw.withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return evaluation.auc_rank(labelled, "score", "label").withColumn("auc", F.round("auc", 6))


MEMBER_SCORED_SQL = f"""{v.MEMBERS_SQL}, tested AS (
  SELECT c_custkey AS member_id, CAST(c_acctbal > 4500 AS INTEGER) AS prediction,
    CAST(coalesce(late, 0) > 0 AS INTEGER) AS label
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_totalprice > 450000) AS late FROM orders GROUP BY 1)
    ON o_custkey = c_custkey),
grouped AS (SELECT tested.*, CASE race WHEN 'white' THEN 'White' WHEN 'missing' THEN 'missing' WHEN 'black' THEN 'Black'
    WHEN 'hispanic' THEN 'Hispanic' ELSE 'minority' END AS grp FROM tested LEFT JOIN members USING (member_id))"""


def member_scored(spark: SparkSession, d: str) -> DataFrame:
    """Predictions per member with the collapsed race group attached."""
    c = load(spark, d, "customer", F.col("c_custkey").alias("member_id"), "c_acctbal")
    o = load(spark, d, "orders", F.col("o_custkey").alias("member_id"), "o_totalprice").groupBy("member_id").agg(
        F.count_if(F.col("o_totalprice") > 450000).alias("late"))
    tested = joins.spine_fill(c, o, v.MEMBER).select(
        "member_id", (F.col("c_acctbal") > 4500).cast("int").alias("prediction"),
        (F.col("late") > 0).cast("int").alias("label"))
    races = v.members(spark, d).select("member_id", "race")
    return joins.enrich(tested, races, v.MEMBER).withColumn("grp", race_group(F.col("race"))).drop("race")


@query("group_confusion", f"""
    WITH {MEMBER_SCORED_SQL}, cells AS (SELECT grp, {_cells_sql()} FROM grouped GROUP BY 1),
    metrics AS (SELECT *, {METRICS_SQL} FROM cells) SELECT grp, tp, tn, fp, fn, {ROUNDED_SQL} FROM metrics""")
def group_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion_metrics(member_scored(spark, d), "label", "prediction", ["grp"])


# --- bootstrap ----------------------------------------------------------------


def _replicates_sql(source: str, key: str, replicates: int, fraction: float, salt: str, with_replacement: bool = True) -> str:
    levels = poisson_levels(replicates * bootstrap.hit_rate(fraction, with_replacement))
    branches = " ".join(f"WHEN w < '{t}' THEN {k}" for k, t in enumerate(levels))
    every = "" if with_replacement else "DISTINCT"
    return f"""counted AS (
  SELECT *, CASE {branches} ELSE {len(levels)} END AS hits
  FROM (SELECT s.*, substr(md5(concat_ws('|', {key}, '{salt}', 'n')), 1, 8) AS w FROM {source} s)),
hit AS (SELECT *, unnest(range(0, hits)) AS i FROM counted),
placed AS (
  SELECT * EXCLUDE (w, hits, i), CAST(CAST('0x' || substr(md5(concat_ws('|', {key}, '{salt}', CAST(i // 4 AS VARCHAR))),
    CAST(8 * (i % 4) + 1 AS BIGINT), 8) AS BIGINT) * {replicates} // 4294967296 AS INTEGER) AS replicate, 1 AS weight
  FROM hit),
weighted AS (SELECT {every} * FROM placed)"""


def _percentile_sql(source: str, metrics: list[str], digits: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, round(avg({m}), {digits}) AS mean, round(quantile_cont({m}, 0.025), {digits}) AS lower,
      round(quantile_cont({m}, 0.975), {digits}) AS upper FROM {source}""" for m in metrics)


CLASS_REPLICATES, CLASS_FRACTION = 1000, 0.05


@query("bootstrap_ci", f"""
    WITH {v.SCORED_SQL}, {_replicates_sql('scored', 'CAST(doc_id AS VARCHAR)', CLASS_REPLICATES, CLASS_FRACTION, 'ci')},
    cells AS (SELECT replicate, {_cells_sql('weight')} FROM weighted GROUP BY 1),
    metrics AS (SELECT replicate, {METRICS_SQL} FROM cells),
    steps AS (SELECT replicate, score, sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS p,
      sum(CASE WHEN label = 0 THEN weight ELSE 0 END) AS n FROM weighted GROUP BY 1, 2),
    below AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY replicate ORDER BY score
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM steps),
    areas AS (SELECT replicate, CAST(sum(p * (2 * b + n)) AS DOUBLE) / nullif(2.0 * CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE), 0) AS auc FROM below GROUP BY 1)
    {_percentile_sql('metrics', METRICS, 6)} UNION ALL {_percentile_sql('areas', ['auc'], 6)}""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap.bootstrap_ci(
        v.scored(spark, d), F.col("doc_id"), "label", "prediction", "score", CLASS_REPLICATES, CLASS_FRACTION, "ci")


@query("bootstrap_cell_ci")
def bootstrap_cell_ci(spark: SparkSession, d: str) -> DataFrame:
    bins = F.floor(F.col("score") / 100)
    return bootstrap.bootstrap_cells_ci(v.scored(spark, d), "label", "prediction", bins, CLASS_REPLICATES, CLASS_FRACTION, 42)


GROUP_METRICS = ["sensitivity", "specificity", "f1"]


def _normal_sql(source: str, metrics: list[str], sd: str, digits: int, group: str = "grp") -> str:
    return " UNION ALL ".join(
        f"""SELECT {group}, '{m}' AS metric, round(avg({m}), {digits}) AS mean,
      round(avg({m}) - {codes.NORMAL_95} * {sd}({m}) / sqrt(count({m})), {digits}) AS lower,
      round(avg({m}) + {codes.NORMAL_95} * {sd}({m}) / sqrt(count({m})), {digits}) AS upper FROM {source} GROUP BY 1""" for m in metrics)


@query("group_bootstrap_ci", f"""
    WITH {MEMBER_SCORED_SQL}, {_replicates_sql('grouped', 'CAST(member_id AS VARCHAR)', 1000, 0.05, 'grp')},
    cells AS (SELECT replicate, grp, {_cells_sql('weight')} FROM weighted GROUP BY 1, 2),
    metrics AS (SELECT replicate, grp, {METRICS_SQL} FROM cells) {_normal_sql('metrics', GROUP_METRICS, 'stddev_samp', 6)}""")
def group_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    weighted = bootstrap.weighted_replicates(
        member_scored(spark, d), F.col("member_id").cast("string"), 1000, 0.05, "grp")
    values = bootstrap.classification_replicates(weighted, "label", "prediction", ["grp"])
    return bootstrap.normal_interval(values, GROUP_METRICS, ["grp"])


# --- regression ---------------------------------------------------------------


@query("regression_metrics", """
    WITH t AS (SELECT l_extendedprice AS y, l_quantity * p_retailprice * 1.5 AS p FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT round(avg(y), 2) AS mean_actual, round(avg(p), 2) AS mean_predicted, round(avg(y - p), 2) AS mean_difference,
      round(avg(abs(y - p)), 2) AS mean_absolute_difference, round(sum(y), 2) AS total_actual, round(sum(p), 2) AS total_predicted,
      round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) AS r2
    FROM t, (SELECT avg(y) AS m FROM t)""")
def regression(spark: SparkSession, d: str) -> DataFrame:
    line = load(spark, d, "lineitem", F.col("l_partkey").alias("p_partkey"), "l_quantity", F.col("l_extendedprice").alias("y"))
    part = load(spark, d, "part", "p_partkey", "p_retailprice")
    scored = line.join(part, "p_partkey").withColumn("p", F.col("l_quantity") * F.col("p_retailprice") * 1.5)
    values = evaluation.regression_metrics(scored, "y", "p", digits=8)
    # money to cents: averages over round row counts end in exact halves at more digits
    money = {c: F.round(c, 2) for c in values.columns if c != "r2"}
    return values.withColumns({**money, "r2": F.round("r2", 6)})


MEMBER_COST_SQL = """costs AS (
  SELECT c_custkey AS member_id, c_mktsegment AS grp, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS actual,
    250000.0::DOUBLE * count(*) AS predicted FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def member_costs(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders", F.col("o_custkey").alias("member_id"), "o_totalprice").groupBy("member_id").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("actual"),
        (F.lit(250000.0) * F.count("*")).alias("predicted"))
    c = load(spark, d, "customer", F.col("c_custkey").alias("member_id"), F.col("c_mktsegment").alias("grp"))
    return o.join(c, "member_id")


REGRESSION_SQL = """values_ AS (
  SELECT replicate, sum(weight * actual) / sum(weight) AS mean_actual, sum(weight * predicted) / sum(weight) AS mean_predicted,
    sum(weight * (actual - predicted)) / sum(weight) AS mean_difference,
    1 - sum(weight * (actual - predicted) * (actual - predicted))
      / (sum(weight * actual * actual) - sum(weight * actual) * sum(weight * actual) / sum(weight)) AS r2
  FROM weighted GROUP BY 1)"""
REGRESSION_METRICS = ["mean_actual", "mean_predicted", "mean_difference", "r2"]


@query("bootstrap_regression_ci", f"""
    WITH {MEMBER_COST_SQL}, {_replicates_sql('costs', 'CAST(member_id AS VARCHAR)', 1000, 0.1, 'cost')}, {REGRESSION_SQL}
    {_percentile_sql('values_', REGRESSION_METRICS, 4)}""")
def bootstrap_regression(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap.bootstrap_regression_ci(
        member_costs(spark, d), F.col("member_id"), "actual", "predicted", 1000, 0.1, "cost")


@query("subsample_regression_ci", f"""
    WITH {MEMBER_COST_SQL}, {_replicates_sql('costs', 'CAST(member_id AS VARCHAR)', 1000, 0.25, 'sub', False)}, {REGRESSION_SQL}
    {_percentile_sql('values_', REGRESSION_METRICS, 4)}""")
def subsample_regression(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap.bootstrap_regression_ci(
        member_costs(spark, d), F.col("member_id"), "actual", "predicted", 1000, 0.25, "sub", with_replacement=False)


@query("group_residual", f"""
    WITH {MEMBER_COST_SQL} SELECT grp, count(*) AS n, round(avg(predicted - actual), 6) AS mean_residual FROM costs GROUP BY 1""")
def group_residual(spark: SparkSession, d: str) -> DataFrame:
    # a mean of cents over round row counts can end in a half at the fourth digit
    return evaluation.group_residual(member_costs(spark, d), "actual", "predicted", "grp", digits=6)


@query("group_residual_ci", f"""
    WITH {MEMBER_COST_SQL}, {_replicates_sql('costs', 'CAST(member_id AS VARCHAR)', 1000, 0.25, 'res')},
    means AS (SELECT replicate, grp, sum(weight * (predicted - actual)) / sum(weight) AS mean_residual FROM weighted GROUP BY 1, 2)
    {_normal_sql('means', ['mean_residual'], 'stddev_pop', 4)}""")
def group_residual_ci(spark: SparkSession, d: str) -> DataFrame:
    weighted = bootstrap.weighted_replicates(member_costs(spark, d), F.col("member_id").cast("string"), 1000, 0.25, "res")
    values = bootstrap.group_residual_replicates(weighted, "actual", "predicted", "grp")
    return bootstrap.normal_interval(values, ["mean_residual"], ["grp"], sample_deviation=False, digits=4)


_PAIR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("correlation_pairs", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS correlation FROM lineitem"
    for i, a in enumerate(_PAIR_COLUMNS) for b in _PAIR_COLUMNS[i + 1:]
) + ") ORDER BY abs(correlation) DESC")
def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return profile.correlation_pairs(load(spark, d, "lineitem", *_PAIR_COLUMNS), _PAIR_COLUMNS)
