"""Member-month panel, coverage vectors and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.dates import month_index
from cohortlake.operators import panel
from cohortlake.plans import views as v
from cohortlake.plans.registry import query
from cohortlake.sources.tables import load

FULL_MONTHS = 2


MEMBER_YEAR = [*v.MEMBER, "year"]


def _panel(spark: SparkSession, d: str) -> DataFrame:
    summed, resolved = v.eligibility_columns()
    return panel.member_month_panel(v.wide_eligibility(spark, d), MEMBER_YEAR, summed, resolved)


@query("member_month_panel", f"""
    WITH {v.PANEL_SQL} SELECT * FROM panel""")
def member_month_panel(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d)


FLAGS_SQL = f"""flags AS (
  SELECT *, CASE WHEN medicaid_days > 0 THEN 'yes' WHEN medicaid_days = 0 THEN 'no' ELSE 'missing' END AS med_enroll,
    CASE WHEN chip_days > 0 THEN 'yes' WHEN chip_days = 0 THEN 'no' ELSE 'missing' END AS chip_enroll,
    CASE WHEN medicaid_days > 0 THEN 'yes' ELSE 'no' END AS enrolled,
    {v.sql_case('dual_code', codes.DUAL_STATUS)} AS dual,
    {v.sql_case('plan_code', {'yes': codes.MANAGED_CARE_PLANS}, 'no')} AS managed_care,
    {v.sql_case('chip_code', codes.COVERAGE_TYPE)} AS coverage_type
  FROM panel)"""


@query("enroll_flags", f"""
    WITH {v.PANEL_SQL}, {FLAGS_SQL} SELECT * FROM flags WHERE enrolled = 'yes'""")
def enroll_flags(spark: SparkSession, d: str) -> DataFrame:
    return panel.enroll_flags(_panel(spark, d)).where(F.col("enrolled") == "yes")


@query("month_pivot_flags", "SELECT o_custkey AS member_id, " + ", ".join(
    f"CAST(bool_or(month(o_orderdate) = {i}) AS INTEGER) AS m{i:02d}" for i in range(1, 13)
) + " FROM orders GROUP BY 1")
def month_flags(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders", "o_custkey", "o_orderdate").select(
        F.col("o_custkey").alias("member_id"), F.month("o_orderdate").alias("month"))
    return panel.month_pivot_flags(o, v.MEMBER, "month")


_MONTH_FLAG_SQL = ", ".join(
    f"CAST(max(CAST(month = {i + 1} AS INTEGER)) AS INTEGER) AS {n.lower()}_elig" for i, n in enumerate(codes.MONTH_NAMES)
)


@query("cohort_select", f"""
    WITH {v.MEMBERS_SQL}, {v.PANEL_SQL}, {FLAGS_SQL},
    summary AS (
      SELECT member_id, year, count(*) AS enrolled_months, count(*) FILTER (med_enroll = 'yes') AS medicaid_months, count(*) FILTER (dual = 'yes') AS medicare_months,
        count(*) FILTER (managed_care = 'yes') AS managed_care_months, CAST(sum(medicaid_days) AS BIGINT) AS total_days,
        {_MONTH_FLAG_SQL}
      FROM flags WHERE enrolled = 'yes' GROUP BY 1, 2)
    SELECT m.member_id, m.state, m.age_cat, s.* EXCLUDE (member_id),
      {v.sql_case('m.state', codes.REGIONS, codes.OTHER_REGION)} AS region
    FROM members m JOIN summary s USING (member_id)
    WHERE s.medicare_months = 0 AND m.age_cat <> 'over64' AND m.state IN {v.sql_list(codes.STUDY_STATES)}""")
def cohort(spark: SparkSession, d: str) -> DataFrame:
    from cohortlake.functions.recode import region

    people = v.members(spark, d).select("member_id", "state", "age_cat")
    summary = panel.annual_summary(panel.enroll_flags(_panel(spark, d)), MEMBER_YEAR)
    # eligibility carries the person alone; the state comes from the person's record
    with_state = summary.join(people.select("member_id", "state"), "member_id")
    chosen = panel.select_cohort(people, with_state, "member_id", "state", "age_cat")
    return chosen.withColumn("region", region(F.col("state")))



def mask_sql(base_year: int = v.BASE_YEAR) -> str:
    month = v.sql_months("o_orderdate", base_year)
    return f"""covered AS (
  SELECT DISTINCT o_custkey AS member_id, {month} AS i FROM orders WHERE {month} BETWEEN 1 AND 36),
firsts AS (SELECT member_id, min(i) AS first, count(*) AS total FROM covered GROUP BY 1),
panel36 AS (
  SELECT f.member_id, f.first, f.total, count(*) FILTER (c.i BETWEEN f.first + 1 AND f.first + 12) AS next12
  FROM firsts f JOIN covered c USING (member_id) GROUP BY 1, 2, 3)"""


MASK_SQL = mask_sql()


@query("enrollment_panel", f"""
    WITH {MASK_SQL} SELECT member_id, """ + ", ".join(
    f"CAST(count(*) FILTER (i = {i}) AS INTEGER) AS col{i}" for i in range(1, 37)
) + " FROM covered GROUP BY 1")
def enrollment_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.enrollment_panel(panel.coverage_mask(v.order_months(spark, d), v.MEMBER, "month_idx"), v.MEMBER)


@query("panel_year_counts", f"""
    WITH {MASK_SQL}
    SELECT count(*) FILTER (y1 > 0) AS members_year1, count(*) FILTER (y2 > 0) AS members_year2, count(*) AS members
    FROM (SELECT member_id, count(*) FILTER (i <= 12) AS y1, count(*) FILTER (i BETWEEN 13 AND 24) AS y2
      FROM covered GROUP BY 1)""")
def year_counts(spark: SparkSession, d: str) -> DataFrame:
    cols = enrollment_panel(spark, d)
    return cols.agg(
        F.count_if(panel.any_month(cols, 1, 12)).alias("members_year1"),
        F.count_if(panel.any_month(cols, 13, 24)).alias("members_year2"), F.count("*").alias("members"))


@query("first_enroll", f"""
    WITH {MASK_SQL}
    SELECT member_id, CAST(first AS INTEGER) AS first, CAST(CASE WHEN first <= 24 THEN next12 ELSE 0 END AS INTEGER) AS enroll_months,
      CAST(total AS INTEGER) AS total_months FROM panel36""")
def first_enroll(spark: SparkSession, d: str) -> DataFrame:
    mask = panel.coverage_mask(v.order_months(spark, d), v.MEMBER, "month_idx")
    return panel.first_enroll(mask).drop("mask")



def coverage_sql(base_year: int = v.BASE_YEAR) -> str:
    return f"""{mask_sql(base_year)},
coverage AS (
  SELECT member_id, CAST(first AS INTEGER) AS first, CAST(next12 AS INTEGER) AS enroll_months,
    CAST(total AS INTEGER) AS total_months, CAST(next12 >= {FULL_MONTHS} AS INTEGER) AS enrolled,
    CAST(next12 < {FULL_MONTHS} AS DOUBLE) AS lose_coverage,
    {v.sql_array(codes.MONTH_NAMES)}[(first - 1) % 12 + 1] AS enroll_month,
    CAST({base_year} + (first - 1) // 12 AS INTEGER) AS enroll_year
  FROM panel36 WHERE first <= 24)"""


def coverage(spark: SparkSession, d: str) -> DataFrame:
    mask = panel.coverage_mask(v.order_months(spark, d), v.MEMBER, "month_idx")
    return panel.coverage_loss(mask, v.BASE_YEAR, FULL_MONTHS).drop("mask")


@query("coverage_loss", f"WITH {coverage_sql()} SELECT * FROM coverage")
def coverage_loss(spark: SparkSession, d: str) -> DataFrame:
    return coverage(spark, d)


# the study starts a year later here, so that the year before it can be looked at
STUDY_YEAR = v.BASE_YEAR + 1
STAGE1_SQL = f"""{v.MEMBERS_SQL}, {coverage_sql(STUDY_YEAR)},
prior AS (SELECT o_custkey AS member_id, count(DISTINCT month(o_orderdate)) AS months FROM orders
  WHERE year(o_orderdate) = {STUDY_YEAR - 1} GROUP BY 1),
stage1 AS (
  SELECT c.*, coalesce(p.months, 0) AS prior_months, CASE WHEN p.months > 0 THEN 'yes' ELSE 'no' END AS prior_coverage,
    m.state, m.age_cat, m.sex, m.race, m.disabled
  FROM coverage c LEFT JOIN prior p USING (member_id) LEFT JOIN members m USING (member_id))"""


def stage1(spark: SparkSession, d: str) -> DataFrame:
    """Label, months covered in the year before the study, and demographics per member."""
    from cohortlake.operators.joins import assemble, spine_fill

    o = load(spark, d, "orders", "o_custkey", "o_orderdate")
    index = o.select(F.col("o_custkey").alias("member_id"), month_index(F.col("o_orderdate"), STUDY_YEAR).alias("month_idx"))
    mask = panel.coverage_mask(index, v.MEMBER, "month_idx")
    labelled = panel.coverage_loss(mask, STUDY_YEAR, FULL_MONTHS).drop("mask")
    # the twelve months before month 1 are months -11..0
    shifted = index.withColumn("month_idx", F.col("month_idx") + 12)
    prior = panel.coverage_mask(shifted, v.MEMBER, "month_idx", 12).select(
        "member_id", F.bit_count("mask").cast("long").alias("prior_months"))
    people = v.members(spark, d).select("member_id", "state", "age_cat", "sex", "race", "disabled")
    with_prior = spine_fill(labelled, prior, v.MEMBER).withColumn(
        "prior_coverage", F.when(F.col("prior_months") > 0, "yes").otherwise("no"))
    return assemble(with_prior, [people], v.MEMBER, fill=None)


@query("stage1_population", f"WITH {STAGE1_SQL} SELECT * FROM stage1")
def stage1_population(spark: SparkSession, d: str) -> DataFrame:
    return stage1(spark, d)


_BREAKDOWNS = ["enroll_year", "state", "race", "age_cat", "sex"]


@query("enrollment_rates", f"""
    WITH {STAGE1_SQL}, long AS (
      SELECT 'all' AS dimension, 'all' AS value, enrolled, enroll_months FROM stage1 """ + " ".join(
    f"UNION ALL SELECT '{c}', CAST({c} AS VARCHAR), enrolled, enroll_months FROM stage1" for c in _BREAKDOWNS
) + """) SELECT dimension, value, count(*) AS members, CAST(sum(enrolled) AS BIGINT) AS flagged,
      round(avg(enroll_months), 2) AS mean_enroll_months, round(sum(enrolled) / count(*) * 100, 2) AS percent
    FROM long GROUP BY 1, 2""")
def enrollment_rates(spark: SparkSession, d: str) -> DataFrame:
    from cohortlake.operators.profile import group_rates

    return group_rates(stage1(spark, d), _BREAKDOWNS, "enrolled", "enroll_months")


@query("months_distribution", f"""
    WITH {STAGE1_SQL} SELECT total_months, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent
    FROM stage1 GROUP BY 1""")
def months_distribution(spark: SparkSession, d: str) -> DataFrame:
    from cohortlake.operators.profile import percent_distribution

    return percent_distribution(stage1(spark, d).select("total_months"), "total_months", 1)
