"""Acute events, episodes and the visit hierarchy; the supplier is the member."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators import acute, episodes, joins, windows
from cohortlake.plans import views as v
from cohortlake.plans.registry import query
from cohortlake.sources.tables import load

REVENUE, PLACES, PROCEDURES = ["AF"], ["7"], ["11", "12", "13"]
ED_SQL = f"""(l_returnflag || l_linestatus IN {v.sql_list(REVENUE)} OR CAST(l_linenumber AS VARCHAR) IN {v.sql_list(PLACES)}
    OR CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) IN {v.sql_list(PROCEDURES)})"""
EVENT = ["member_id", "start_date", "end_date", "code"]


def _visits(spark: SparkSession, d: str) -> DataFrame:
    stays = v.intervals(spark, d, "l_partkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    flag = acute.ed_visit(
        F.concat("l_returnflag", "l_linestatus"), F.col("l_linenumber"), F.col("l_quantity").cast("int"),
        REVENUE, PLACES, PROCEDURES)
    return stays.withColumnRenamed("l_partkey", "code").withColumn("is_ed", flag)


@query("ed_visit_flag", f"""
    SELECT l_suppkey AS member_id, l_returnflag, CAST({ED_SQL} AS INTEGER) AS is_ed, count(*) AS n
    FROM lineitem GROUP BY 1, 2, 3""")
def ed_flag(spark: SparkSession, d: str) -> DataFrame:
    return _visits(spark, d).groupBy("member_id", "l_returnflag", "is_ed").agg(F.count("*").alias("n"))


@query("non_ed_lines", f"""
    SELECT l_orderkey AS claim_id, l_linenumber AS line_no FROM lineitem WHERE NOT {ED_SQL}""")
def non_ed(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    flag = acute.ed_visit(
        F.concat("l_returnflag", "l_linestatus"), F.col("l_linenumber"), F.col("l_quantity").cast("int"),
        REVENUE, PLACES, PROCEDURES)
    return raw.where(flag == 0).select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line_no"))


def _union(spark: SparkSession, d: str) -> DataFrame:
    visits = _visits(spark, d)
    stay = F.col("l_returnflag") == "R"
    return acute.acute_union(visits.where(stay), visits.where(~stay), EVENT, "is_ed")


ACUTE_SQL = f"""{v.INTERVALS_SQL},
acute AS (
  SELECT member_id, start_date, end_date, l_partkey AS code,
    CAST(l_returnflag <> 'R' AS INTEGER) AS ed_visit, CAST(l_returnflag = 'R' AS INTEGER) AS inpatient_visit
  FROM stays WHERE l_returnflag = 'R' OR {ED_SQL}),
listed AS (SELECT p_partkey, p_size / 200.0 + p_size / 200.0 + p_retailprice / 10000 > 0.5 AS ed_listed,
  p_type IN ('PROMO', 'SMALL') AS ip_listed FROM part),
flagged AS (
  SELECT acute.*, CAST(coalesce(ed_listed, FALSE) AS INTEGER) AS avoidable_ed,
    CAST(coalesce(ip_listed, FALSE) AS INTEGER) AS avoidable_ip FROM acute LEFT JOIN listed ON code = p_partkey)"""


@query("acute_union", f"WITH {ACUTE_SQL} SELECT * FROM acute")
def acute_union(spark: SparkSession, d: str) -> DataFrame:
    return _union(spark, d)


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part", "p_partkey", "p_size", "p_retailprice", "p_type")
    weights = part.select(
        F.col("p_partkey").alias("code"), (F.col("p_size") / 200).alias("ednp"), (F.col("p_size") / 200).alias("pct"),
        (F.col("p_retailprice") / 10000).alias("nonemergent"))
    ed_codes = acute.avoidable_ed_codes(weights, "code", ["ednp", "pct", "nonemergent"])
    ip_codes = part.where(F.col("p_type").isin("PROMO", "SMALL")).select(
        F.col("p_partkey").alias("code"), F.lit(1).alias("avoidable_ip")).distinct()
    events = acute.attach_code_flag(_union(spark, d), ed_codes, "code", "avoidable_ed")
    return acute.attach_code_flag(events, ip_codes, "code", "avoidable_ip")


@query("avoidable_flags", f"WITH {ACUTE_SQL} SELECT * FROM flagged")
def avoidable(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d)


def _numbered_sql(source: str, mode: str = "lag") -> str:
    w = "OVER (PARTITION BY member_id ORDER BY start_date, end_date"
    previous = (
        f"lag(end_date) {w})" if mode == "lag"
        else f"max(end_date) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    return f"""looked AS (
  SELECT *, lag(start_date) {w}) AS ps, {previous} AS pe, row_number() {w}) AS rn FROM {source}),
opened AS (SELECT *, CAST(pe IS NULL OR start_date > pe + 1 AS INTEGER) AS opens FROM looked),
numbered AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY member_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      AS BIGINT) AS episode,
    CASE WHEN rn = 1 THEN '1.First' WHEN opens = 1 THEN '2.New Episode' WHEN end_date > pe THEN '3.Regular Overlap'
      WHEN start_date = ps AND end_date < pe THEN '5.Same Start Date (SRO)'
      WHEN start_date > ps AND end_date < pe THEN '6.Embedded'
      WHEN start_date = ps AND end_date = pe THEN '7.Perfect Overlap' END AS overlap
  FROM opened)"""


@query("episodes", f"""
    WITH {v.INTERVALS_SQL}, {_numbered_sql('stays')} SELECT member_id, start_date, end_date, episode FROM numbered""")
def episode_rows(spark: SparkSession, d: str) -> DataFrame:
    stays = v.intervals(spark, d, "l_orderkey", "l_linenumber")
    return episodes.episodes(stays, v.MEMBER, "start_date", "end_date").select(*v.MEMBER, "start_date", "end_date", "episode")


@query("episodes_running_max", f"""
    WITH {v.INTERVALS_SQL}, {_numbered_sql('stays', 'max')}
    SELECT member_id, episode, min(start_date) AS start_date, max(end_date) AS end_date FROM numbered GROUP BY 1, 2""")
def episodes_running_max(spark: SparkSession, d: str) -> DataFrame:
    return episodes.episode_rollup(v.intervals(spark, d), v.MEMBER, "start_date", "end_date", mode="running_max")


@query("episode_overlap_class", f"""
    WITH {v.INTERVALS_SQL}, {_numbered_sql('stays')} SELECT member_id, start_date, end_date, overlap FROM numbered""")
def overlap_rows(spark: SparkSession, d: str) -> DataFrame:
    stays = v.intervals(spark, d, "l_orderkey", "l_linenumber")
    return episodes.episodes(stays, v.MEMBER, "start_date", "end_date").select(*v.MEMBER, "start_date", "end_date", "overlap")


@query("overlap_report", f"""
    WITH {v.INTERVALS_SQL}, {_numbered_sql('stays')} SELECT overlap, count(*) AS n FROM numbered GROUP BY 1""")
def overlap_report(spark: SparkSession, d: str) -> DataFrame:
    return episodes.overlap_report(v.intervals(spark, d), v.MEMBER, "start_date", "end_date")


HIERARCHY_SQL = f"""{ACUTE_SQL}, {_numbered_sql('flagged')},
rolled AS (
  SELECT member_id, episode, min(start_date) AS start_date, max(end_date) AS end_date, max(inpatient_visit) AS ip,
    max(CASE WHEN inpatient_visit = 1 AND avoidable_ip = 0 THEN 1 ELSE 0 END) AS ip_other,
    max(CASE WHEN inpatient_visit = 1 AND avoidable_ip = 1 THEN 1 ELSE 0 END) AS ip_avoid,
    max(CASE WHEN ed_visit = 1 AND avoidable_ed = 0 THEN 1 ELSE 0 END) AS ed_other,
    max(CASE WHEN ed_visit = 1 AND avoidable_ed = 1 THEN 1 ELSE 0 END) AS ed_avoid
  FROM numbered GROUP BY 1, 2),
ranked AS (
  SELECT *, ip_other AS non_avoid_ip, CASE WHEN ip_avoid = 1 AND ip_other = 0 THEN 1 ELSE 0 END AS avoid_ip,
    CASE WHEN ip = 0 THEN ed_other ELSE 0 END AS non_avoid_ed,
    CASE WHEN ip = 0 AND ed_other = 0 THEN ed_avoid ELSE 0 END AS avoid_ed FROM rolled),
outcomes AS (
  SELECT member_id, episode, start_date, end_date, non_avoid_ip, avoid_ip, non_avoid_ed, avoid_ed,
    greatest(non_avoid_ip, avoid_ip) AS all_cause_ip, greatest(non_avoid_ed, avoid_ed) AS all_cause_ed,
    greatest(non_avoid_ip, avoid_ip, non_avoid_ed, avoid_ed) AS all_cause_acute, greatest(avoid_ip, avoid_ed) AS avoid_acute
  FROM ranked),
windowed AS (
  SELECT s_suppkey AS spine, s_nationkey % 24 + 1 AS m, {v.sql_months('start_date')} AS sm, outcomes.*
  FROM supplier LEFT JOIN outcomes ON s_suppkey = member_id)"""


@query("acute_hierarchy", f"WITH {HIERARCHY_SQL} SELECT * FROM outcomes")
def acute_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return acute.acute_hierarchy(_flagged(spark, d), v.MEMBER, "start_date", "end_date")


def _acute_months(spark: SparkSession, d: str) -> DataFrame:
    return windows.monthly_totals(
        acute_hierarchy(spark, d), v.MEMBER, "start_date", v.BASE_YEAR, acute.acute_measures("start_date", "end_date"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.index_windows(v.supplier_index(spark, d), "index_month")


@query("acute_post_outcomes", f"WITH {HIERARCHY_SQL} SELECT spine AS member_id, " + ", ".join(
    f"CAST(coalesce(sum({o}) FILTER (sm BETWEEN m + 7 AND m + 12), 0) AS BIGINT) AS {o}_post" for o in acute.OUTCOMES
) + " FROM windowed GROUP BY 1")
def acute_post(spark: SparkSession, d: str) -> DataFrame:
    index = _windows(spark, d)
    totals = windows.window_totals(_acute_months(spark, d), index, v.MEMBER, acute.OUTCOMES, "post")
    return joins.spine_fill(index.select("member_id"), totals, v.MEMBER)


@query("pre_acute_features", f"""
    WITH {HIERARCHY_SQL}, pre AS (SELECT * FROM windowed WHERE sm BETWEEN m + 1 AND m + 6),
    totals AS (
      SELECT spine, CAST(sum(CASE WHEN all_cause_ip = 1 THEN end_date - start_date ELSE 0 END) AS BIGINT) AS days,
        CAST(sum(all_cause_acute) AS BIGINT) AS visits, CAST(sum(avoid_acute) AS BIGINT) AS avoidable FROM pre GROUP BY 1)
    SELECT s_suppkey AS member_id, coalesce(days, 0) AS total_inpatient_days, coalesce(visits, 0) AS total_all_cause_visits,
      coalesce(avoidable, 0) AS total_avoid_acute_visits,
      coalesce(CASE WHEN visits > 0 THEN round(avoidable / visits, 5) ELSE 0 END, 0) AS percent_non_emergent
    FROM supplier LEFT JOIN totals ON s_suppkey = spine""")
def pre_acute(spark: SparkSession, d: str) -> DataFrame:
    index = _windows(spark, d)
    measures = ["inpatient_days", "all_cause_acute", "avoid_acute"]
    totals = windows.window_totals(_acute_months(spark, d), index, v.MEMBER, measures, "pre")
    return joins.spine_fill(index.select("member_id"), acute.pre_acute_features(totals, v.MEMBER), v.MEMBER)


_SLOT_SQL = ", ".join(
    f"coalesce(sum(all_cause_acute) FILTER (sm = m + {k}), 0) AS y{k}" for k in range(1, 7))


@query("acute_trend", f"""
    WITH {HIERARCHY_SQL}, slots AS (SELECT spine, {_SLOT_SQL} FROM windowed GROUP BY 1),
    long AS (SELECT spine, 1 AS x, y1 AS y FROM slots """ + " ".join(
    f"UNION ALL SELECT spine, {k}, y{k} FROM slots" for k in range(2, 7)
) + """) SELECT spine AS member_id, round(regr_slope(y, x), 6) AS allcause_slope FROM long GROUP BY 1""")
def acute_trend(spark: SparkSession, d: str) -> DataFrame:
    index = _windows(spark, d)
    slots = windows.month_slots(_acute_months(spark, d), index, v.MEMBER, "all_cause_acute", "allcause")
    trend = slots.select("member_id", windows.slot_slope("allcause").alias("allcause_slope"))
    return joins.spine_fill(index.select("member_id"), trend, v.MEMBER, 0.0)


@query("pair_correlation", f"""
    WITH {HIERARCHY_SQL}, post AS (SELECT spine, coalesce(sum(all_cause_acute) FILTER (sm BETWEEN m + 7 AND m + 12), 0) AS a,
      coalesce(sum(avoid_acute) FILTER (sm BETWEEN m + 7 AND m + 12), 0) AS b FROM windowed GROUP BY 1)
    SELECT count(*) AS n, round(corr(a, b), 6) AS correlation FROM post""")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    from cohortlake.operators.profile import pair_correlation

    return pair_correlation(acute_post(spark, d), "all_cause_acute_post", "avoid_acute_post")


@query("stay_totals", f"""
    WITH {v.INTERVALS_SQL}, before_index AS (
      SELECT stays.* FROM stays JOIN supplier ON s_suppkey = member_id
      WHERE {v.sql_months('start_date')} BETWEEN s_nationkey % 24 + 2 AND s_nationkey % 24 + 7), {_numbered_sql('before_index')},
    merged AS (SELECT member_id, episode, max(end_date) - min(start_date) AS days FROM numbered GROUP BY 1, 2)
    SELECT s_suppkey AS member_id, count(episode) AS episodes, CAST(coalesce(sum(days), 0) AS BIGINT) AS stay_days
    FROM supplier LEFT JOIN merged ON s_suppkey = member_id GROUP BY 1""")
def stays(spark: SparkSession, d: str) -> DataFrame:
    """Stays that begin in the pre period, merged; their number and days."""
    inside = windows.prepost_window(v.intervals(spark, d), _windows(spark, d), v.MEMBER, "start_date", v.BASE_YEAR)
    totals = episodes.stay_totals(
        inside.where(F.col("pre") == 1).select("member_id", "start_date", "end_date"), v.MEMBER, "start_date", "end_date")
    return joins.spine_fill(v.supplier_index(spark, d).select("member_id"), totals, v.MEMBER)
