"""Cost regressions by feature set and by stratum, from Gram matrices; the statements eliminate columns in SQL."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.hashing import threshold
from cohortlake.operators import evaluation, gram, joins, ml, sampling
from cohortlake.operators.cost import stratum
from cohortlake.plans import claim_plans, feature_plans, ml_plans, views as v
from cohortlake.plans.registry import ORACLES, query
from cohortlake.session import materialize

TARGET = "total_cost"
SHARES = {"train": 0.64, "validation": 0.16, "test": 0.2}
TEXT = codes.TEXT_RECODES | codes.NUMBER_RECODES
LEVELS = {
    "ageCat": [name for name, _, _ in codes.AGE_BANDS], "sex": list(TEXT["sex"]), "race": list(TEXT["race"]), "disabled": ["yes", "no"],
    "enrollMonth": codes.MONTH_NAMES, "enrollYear": [str(v.BASE_YEAR + i) for i in range(7)], "state": v.STATES,
    **{c: list(TEXT[c]) for c in ml_plans.INDIVIDUAL},
}


def _population(set_name: str) -> str:
    return "adults" if set_name == "adults_only" else "all"


def _sets(stage1: bool) -> dict[str, tuple[list[str], list[str]]]:
    """Categorical and numeric columns of each named set; adults only is the widest set on adults."""
    named = {}
    for name in ml.feature_sets([], []):
        categorical, numeric = ml_plans.feature_set(name)
        named[name] = (categorical, [c for c in numeric if stage1 or c not in ml_plans.STAGE1])
    return named | {"adults_only": named["area_individual"]}


def _positions(named: dict, slots: Sequence[str]) -> dict[str, list[int]]:
    """Places in the design vector of each set's slots; the constant is 0."""
    def own(slot: str, columns: Sequence[str]) -> bool:
        return slot in columns or slot.split("=")[0] in columns

    return {name: [i for i, s in enumerate(slots, 1) if own(s, [*cat, *num])] for name, (cat, num) in named.items()}


def _slots(named: dict) -> dict:
    categorical = list(dict.fromkeys(c for cat, _ in named.values() for c in cat))
    numeric = list(dict.fromkeys(c for _, num in named.values() for c in num))
    found = {}
    for c in categorical:
        found |= gram.dummies(c, LEVELS[c])
    return found | {c: F.col(c) for c in numeric}


def feature_set_fits(table: DataFrame, stage1: bool) -> DataFrame:
    """One pass over the member table: every named set fitted on the training part and judged on the test part."""
    named = _sets(stage1)
    slots = _slots(named)
    split = sampling.hash_split(table, v.MEMBER, SHARES, "model").where(F.col("part") != "validation")
    adult = ~F.col("ageCat").isin([*codes.CHILD_BANDS, codes.MISSING])
    rows = gram.design(split.withColumn("adult", adult.cast("string")), slots, TARGET, ["part", "adult"])
    sums = gram.moments(rows, ["part", "adult"])
    size = len(slots) + 2

    def of(part: str, population: str):
        flags = ("true",) if population == "adults" else ("true", "false")
        return sum((sums[part, f] for f in flags if (part, f) in sums), start=gram.np.zeros((size, size)))

    out = []
    for name, columns in _positions(named, list(slots)).items():
        where = _population(name)
        fit = gram.fit_of(of("test", where), gram.solve(of("train", where), columns))
        categorical, numeric = named[name]
        out.append((name, len(categorical), len(numeric), fit["r2"], fit["mean_actual"], fit["mean_predicted"]))
    schema = "feature_set string, categorical int, numeric int, r2 double, mean_actual double, mean_predicted double"
    found = table.sparkSession.createDataFrame(out, schema)
    return found.withColumns({"r2": F.round("r2", 6), "mean_actual": F.round("mean_actual", 2), "mean_predicted": F.round("mean_predicted", 2)})


# --- statements ---------------------------------------------------------------

#: From ``start`` (name, m: rows of an augmented symmetric matrix) to ``solved`` (name, b: coefficients).
SOLVE_SQL = f"""
sweeps AS (
  SELECT name, 1 AS k, m, [m[i][i] for i in range(1, len(m) + 1)] AS own, CAST([] AS BOOLEAN[]) AS kept FROM start
  UNION ALL
  SELECT name, k + 1,
    CASE WHEN m[k][k] <= {gram.TOLERANCE!r} * own[k] OR own[k] <= 0 THEN m ELSE
      list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / m[k][k])
        ELSE list_transform(r, lambda x, j: x - r[k] * (m[k][j] / m[k][k])) END) END,
    own, list_append(kept, m[k][k] > {gram.TOLERANCE!r} * own[k] AND own[k] > 0)
  FROM sweeps WHERE k < len(m)),
solved AS (SELECT name, [CASE WHEN kept[i] THEN m[i][len(m)] ELSE 0 END for i in range(1, len(m))] AS b FROM sweeps WHERE k = len(m))"""


def _share_sql(word: str, shares: dict[str, float]) -> str:
    total, names = sum(shares.values()), list(shares)
    tests = [f"WHEN {word} < '{threshold(upto / total)}' THEN '{n}'" for n, upto in zip(names[:-1], accumulate(shares.values()))]
    return f"CASE {' '.join(tests)} ELSE '{names[-1]}' END"


def _dummies_sql(columns: Sequence[str]) -> list[str]:
    return [f"CASE WHEN \"{c}\" = '{x}' THEN 1.0 ELSE 0.0 END" for c in columns for x in LEVELS[c]]


def _frame_sql() -> str:
    filled = lambda name, columns: ", ".join(f"coalesce({name}.{c}, 0) AS {c}" for c in columns)
    rates = ", ".join(f"coalesce({c}, avg({c}) OVER (PARTITION BY area)) AS {c}" for c in ml_plans.AREA)
    means = ", ".join(f"coalesce({c}, avg({c}) OVER (), 0) AS {c}" for c in ml_plans.AREA)
    individual = ", ".join(f'recoded."{c}"' for c in ml_plans.INDIVIDUAL)
    word = "substr(md5(concat_ws('|', CAST(people.member_id AS VARCHAR), 'model')), 1, 8)"
    return f"""{v.MEMBERS_SQL}, {v.INDEX_SQL}, people AS (SELECT * FROM members JOIN idx USING (member_id)), {feature_plans.RATES_SQL},
first_rates AS (SELECT county, {rates} FROM rates), all_rates AS (SELECT county, {means} FROM first_rates),
recoded AS ({ORACLES['recode_categories']}), dx_block AS ({ORACLES['dx_category_counts']}), slope_block AS ({ORACLES['trend_slope']}),
rx_block AS ({ORACLES['rx_adherence']}), cost_block AS ({ORACLES['total_cost']}),
frame AS (
  SELECT people.member_id, people.age_cat AS "ageCat", people.sex, people.race, people.disabled, people.state,
    {v.sql_array(codes.MONTH_NAMES)}[(m - 1) % 12 + 1] AS "enrollMonth", CAST((m - 1) // 12 + {v.BASE_YEAR} AS VARCHAR) AS "enrollYear",
    {individual}, {filled('dx_block', ml_plans.COUNTS)}, {filled('slope_block', ml_plans.UTILISATION[:1])},
    {filled('rx_block', ml_plans.UTILISATION[1:])}, {", ".join(f"all_rates.{c}" for c in ml_plans.AREA)}, cost_block.total_cost,
    {_share_sql(word, SHARES)} AS part, people.age_cat NOT IN {v.sql_list([*codes.CHILD_BANDS, codes.MISSING])} AS adult
  FROM people JOIN all_rates ON nation_key = county LEFT JOIN recoded USING (member_id) LEFT JOIN dx_block USING (member_id)
  LEFT JOIN slope_block USING (member_id) LEFT JOIN rx_block USING (member_id) LEFT JOIN cost_block USING (member_id))"""


def feature_sets_sql() -> str:
    named = _sets(stage1=False)
    categorical = list(dict.fromkeys(c for cat, _ in named.values() for c in cat))
    numeric = list(dict.fromkeys(c for _, num in named.values() for c in num))
    slots = [f"{c}={x}" for c in categorical for x in LEVELS[c]] + numeric
    vector = ", ".join(["1.0", *_dummies_sql(categorical), *[f"CAST({c} AS DOUBLE)" for c in numeric], TARGET])
    size = len(slots) + 2
    lists = ", ".join(
        f"('{name}', '{_population(name)}', {len(named[name][0])}, {len(named[name][1])}, {[1, *[i + 1 for i in places], size]})"
        for name, places in _positions(named, slots).items())
    return f"""
WITH RECURSIVE {_frame_sql()},
rows_ AS (SELECT part, adult, CAST([{vector}] AS DOUBLE[]) AS z FROM frame WHERE part <> 'validation'),
cells AS (SELECT part, adult, i, j, sum(z[i] * z[j]) AS g FROM rows_, range(1, {size + 1}) t(i), range(1, {size + 1}) u(j) GROUP BY ALL),
sums AS (
  SELECT part, 'all' AS population, i, j, sum(g) AS g FROM cells GROUP BY ALL UNION ALL SELECT part, 'adults', i, j, g FROM cells WHERE adult),
sets(name, population, categorical, "numeric", places) AS (VALUES {lists}),
entries AS (
  SELECT name, part, a, b, g FROM (SELECT name, population, unnest(places) AS i, generate_subscripts(places, 1) AS a FROM sets)
  JOIN (SELECT name, unnest(places) AS j, generate_subscripts(places, 1) AS b FROM sets) USING (name) JOIN sums USING (population, i, j)),
matrices AS (
  SELECT name, part, list(r ORDER BY a) AS m FROM (SELECT name, part, a, list(g ORDER BY b) AS r FROM entries GROUP BY ALL) GROUP BY ALL),
start AS (SELECT name, m FROM matrices WHERE part = 'train'), {SOLVE_SQL},
judged AS (
  SELECT name, m[1][1] AS n, m[1][len(m)] AS s, m[len(m)][len(m)] AS q, list_dot_product(b, m[len(m)][:len(m) - 1]) AS c,
    list_dot_product(b, [list_dot_product(b, m[i][:len(m) - 1]) for i in range(1, len(m))]) AS e, list_dot_product(b, m[1][:len(m) - 1]) AS p
  FROM solved JOIN (SELECT * FROM matrices WHERE part = 'test') USING (name))
SELECT name AS feature_set, CAST(categorical AS INTEGER) AS categorical, CAST("numeric" AS INTEGER) AS "numeric",
  round(CASE WHEN q - s * s / n > 0 THEN 1 - (q - 2 * c + e) / (q - s * s / n) END, 6) AS r2, round(s / n, 2) AS mean_actual,
  round(p / n, 2) AS mean_predicted
FROM judged JOIN sets USING (name)"""


@query("gram_feature_sets", feature_sets_sql())
def gram_feature_sets(spark: SparkSession, d: str) -> DataFrame:
    """The feature sets without the stage-1 probabilities, which no statement can give."""
    return feature_set_fits(ml_plans.frame(spark, d), stage1=False)


@query("ml_feature_sets")
def ml_feature_sets(spark: SparkSession, d: str) -> DataFrame:
    """Cost regression on each named feature set, stage-1 probabilities among them: test R-squared side by side."""
    return feature_set_fits(ml_plans.frame(spark, d), stage1=True)


# --- strata -------------------------------------------------------------------

GROUPS = [*codes.DISEASE_GROUPS, *codes.DRUG_GROUPS]
CELLS = [name for name, *_ in codes.AGE_SEX_CELLS]
COST_SHARES = {"train": 0.8, "test": 0.2}
STRATA = ("adults", "kids", "disabled")
STRATUM_SQL = """CASE WHEN disabled = 'yes' THEN 'disabled' WHEN disabled = 'no' AND age_cat IN ('under10', '10To17') THEN 'kids'
    WHEN disabled = 'no' AND age_cat <> 'missing' THEN 'adults' END"""


def disease_table(spark: SparkSession, d: str) -> DataFrame:
    """Members with their stratum, disease groups, age-sex cells, cost and part, as a written table."""
    people = v.members(spark, d)
    placed = people.select("member_id", stratum(F.col("age_cat"), F.col("disabled")).alias("stratum"))
    groups = feature_plans.hierarchy_rules(spark, d).drop("age")
    costs = claim_plans.total_cost(spark, d).select("member_id", TARGET)
    joined = joins.assemble_inner([placed, groups, feature_plans.cells(spark, d), costs], v.MEMBER)
    split = sampling.hash_split(joined, v.MEMBER, COST_SHARES, "cost")
    return materialize(split.where("stratum is not null"), "disease-cost")


def stratum_fits(table: DataFrame) -> dict[str, "gram.np.ndarray"]:
    """Coefficients of each stratum, from one pass over the training rows."""
    slots = {c: F.col(c) for c in [*GROUPS, *CELLS]}
    sums = gram.moments(gram.design(table.where(F.col("part") == "train"), slots, TARGET, ["stratum"]), ["stratum"])
    return {name: gram.solve(sums[name,]) for name in STRATA if (name,) in sums}


_DISEASE_SQL = f"""groups_ AS ({ORACLES['hierarchy_rules']}), cells_ AS ({ORACLES['age_sex_cells']}), costs_ AS ({ORACLES['total_cost']}),
{v.MEMBERS_SQL}, table_ AS (
  SELECT {STRATUM_SQL} AS stratum, {_share_sql("substr(md5(concat_ws('|', CAST(members.member_id AS VARCHAR), 'cost')), 1, 8)", COST_SHARES)} AS part,
    CAST([1, {", ".join(f'"{c}"' for c in [*GROUPS, *CELLS])}, {TARGET}] AS DOUBLE[]) AS z
  FROM members JOIN groups_ USING (member_id) JOIN cells_ USING (member_id) JOIN costs_ USING (member_id)),
entries AS (
  SELECT stratum, i, j, sum(z[i] * z[j]) AS g FROM table_, range(1, {len(GROUPS) + len(CELLS) + 3}) t(i), range(1, {len(GROUPS) + len(CELLS) + 3}) u(j)
  WHERE part = 'train' AND stratum IS NOT NULL GROUP BY ALL),
start AS (SELECT stratum AS name, list(r ORDER BY i) AS m FROM (SELECT stratum, i, list(g ORDER BY j) AS r FROM entries GROUP BY ALL) GROUP BY ALL),
{SOLVE_SQL}"""


@query("ml_cost_by_stratum", f"""
WITH RECURSIVE {_DISEASE_SQL},
scored AS (SELECT stratum, z[len(z)] AS y, list_dot_product(b, z[:len(z) - 1]) AS p FROM table_ JOIN solved ON stratum = name WHERE part = 'test'),
known AS (SELECT *, avg(y) OVER (PARTITION BY stratum) AS m FROM scored)
SELECT stratum, round(avg(y), 2) AS mean_actual, round(avg(p), 2) AS mean_predicted, round(avg(y - p), 2) AS mean_difference,
  round(avg(abs(y - p)), 2) AS mean_absolute_difference, round(sum(y), 2) AS total_actual, round(sum(p), 2) AS total_predicted,
  round(1 - sum((y - p) * (y - p)) / nullif(sum((y - m) * (y - m)), 0), 6) AS r2
FROM known GROUP BY 1""")
def ml_cost_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    """Disease groups and age-sex cells against cost, fitted apart for each stratum, judged on its test part."""
    table = disease_table(spark, d)
    fits = stratum_fits(table)
    slots = {c: F.col(c) for c in [*GROUPS, *CELLS]}
    coefficients = F.lit(None).cast("array<double>")
    for name, b in fits.items():
        coefficients = F.when(F.col("stratum") == name, F.array(*[F.lit(float(x)) for x in b])).otherwise(coefficients)
    test = gram.design(table.where((F.col("part") == "test") & F.col("stratum").isin(list(fits))), slots, TARGET, ["stratum"])
    scored = test.select("stratum", F.element_at(gram.VECTOR, -1).alias("y"), gram.prediction(coefficients).alias("p"))
    values = evaluation.regression_metrics(scored, "y", "p", ["stratum"], digits=8)
    money = {c: F.round(c, 2) for c in values.columns if c not in ("stratum", "r2")}
    return values.withColumns({**money, "r2": F.round("r2", 6)})


@query("group_coefficients", f"""
WITH RECURSIVE {_DISEASE_SQL}
SELECT name AS stratum, {v.sql_array([gram.CONSTANT, *GROUPS, *CELLS])}[i] AS feature, round(b[i], 2) AS value, round(abs(b[i]), 2) AS importance
FROM solved, range(1, {len(GROUPS) + len(CELLS) + 2}) t(i)""")
def group_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Cost attributed to each disease group and age-sex cell, by stratum."""
    names = [gram.CONSTANT, *GROUPS, *CELLS]
    rows = [(s, n, float(x), abs(float(x))) for s, b in stratum_fits(disease_table(spark, d)).items() for n, x in zip(names, b)]
    found = spark.createDataFrame(rows, "stratum string, feature string, value double, importance double")
    return found.select("stratum", "feature", F.round("value", 2).alias("value"), F.round("importance", 2).alias("importance"))
