"""Header-line claims, observation windows, completeness and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.recode import present
from cohortlake.operators import cost, joins, windows
from cohortlake.plans import views as v
from cohortlake.plans.registry import query
from cohortlake.sources.tables import load

TYPES_SQL = v.sql_list(v.CLAIM_TYPES)
CLAIM = ["claim_id", "member_id"]
MONEY = "DECIMAL(18,2)"


@query("claim_header_line", f"""
    SELECT o_orderkey AS claim_id, o_custkey AS member_id, o_orderstatus AS claim_type, CAST(o_orderdate AS DATE) AS service_date,
      o_totalprice AS header_amount, l_linenumber AS line_no, l_extendedprice AS line_amount, l_returnflag
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus IN {TYPES_SQL}""")
def claim_header_line(spark: SparkSession, d: str) -> DataFrame:
    return joins.header_lines(v.headers(spark, d), v.lines(spark, d), ["claim_id"], "claim_type", v.CLAIM_TYPES)


def claim_totals(spark: SparkSession, d: str) -> DataFrame:
    """Claims with their lines summed first: one row per claim reaches the join."""
    per_claim = v.lines(spark, d).groupBy("claim_id").agg(
        F.count("*").alias("line_count"), F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.sum(F.col("line_amount").cast(cost.MONEY)).alias("paid"))
    return joins.header_lines(v.headers(spark, d), per_claim, ["claim_id"], "claim_type", v.CLAIM_TYPES)


def windowed_members(spark: SparkSession, d: str, index: DataFrame | None = None) -> DataFrame:
    return windows.index_windows(v.index_months(spark, d) if index is None else index, "index_month")


CLAIMS_SQL = f"""claims AS (
  SELECT o_custkey AS member_id, o_orderkey AS claim_id, CAST(o_orderdate AS DATE) AS service_date,
    {v.sql_months('o_orderdate')} AS sm, l.* FROM orders JOIN lineitem l ON o_orderkey = l_orderkey
  WHERE o_orderstatus IN {TYPES_SQL}), {v.INDEX_SQL}"""


@query("prepost_window", f"""
    WITH {v.INDEX_SQL}
    SELECT o_orderkey AS claim_id, o_custkey AS member_id, CAST(o_orderdate AS DATE) AS service_date,
      CAST({v.sql_months('o_orderdate')} AS INTEGER) AS service_month, CAST(m AS INTEGER) AS index_month,
      CAST(m + 1 AS INTEGER) AS start_month, CAST(m + 12 AS INTEGER) AS end_month,
      CAST(m + 1 AS INTEGER) AS pre_start, CAST(m + 6 AS INTEGER) AS pre_end,
      CAST(m + 7 AS INTEGER) AS post_start, CAST(m + 12 AS INTEGER) AS post_end,
      CAST({v.sql_months('o_orderdate')} - m <= 6 AS INTEGER) AS pre, CAST({v.sql_months('o_orderdate')} - m >= 7 AS INTEGER) AS post
    FROM orders JOIN idx ON o_custkey = member_id WHERE {v.sql_months('o_orderdate')} - m BETWEEN 1 AND 12""")
def prepost(spark: SparkSession, d: str) -> DataFrame:
    claims = v.headers(spark, d).select("claim_id", "member_id", "service_date")
    return windows.prepost_window(claims, windowed_members(spark, d), v.MEMBER, "service_date", v.BASE_YEAR)


def claim_months(spark: SparkSession, d: str, claims: DataFrame | None = None) -> DataFrame:
    measures = {"claims": F.lit(1), "line_count": F.col("line_count"), "returned": F.col("returned"), "paid": F.col("paid")}
    claims = claim_totals(spark, d) if claims is None else claims
    return windows.monthly_totals(claims, v.MEMBER, "service_date", v.BASE_YEAR, measures)


@query("post_outcomes", f"""
    WITH {CLAIMS_SQL},
    post AS (
      SELECT member_id, count(DISTINCT claim_id) AS claims_post, count(*) AS line_count_post,
        count(*) FILTER (l_returnflag = 'R') AS returned_post, CAST(sum(CAST(l_extendedprice AS {MONEY})) AS DOUBLE) AS paid_post
      FROM claims JOIN idx USING (member_id) WHERE sm BETWEEN m + 7 AND m + 12 GROUP BY 1)
    SELECT c_custkey AS member_id, coalesce(claims_post, 0) AS claims_post, coalesce(line_count_post, 0) AS line_count_post,
      coalesce(returned_post, 0) AS returned_post, coalesce(paid_post, 0) AS paid_post
    FROM customer LEFT JOIN post ON c_custkey = member_id""")
def post_outcomes(spark: SparkSession, d: str, months: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    totals = windows.window_totals(
        claim_months(spark, d) if months is None else months, windowed_members(spark, d, index), v.MEMBER,
        ["claims", "line_count", "returned", "paid"], "post",
    ).withColumn("paid_post", F.col("paid_post").cast("double"))
    spine = load(spark, d, "customer", "c_custkey").withColumnRenamed("c_custkey", "member_id")
    return joins.spine_fill(spine, totals, v.MEMBER)


_SLOTS_SQL = ", ".join(
    f"CAST(count(*) FILTER (sm = m + {k}) AS BIGINT) AS lines_month{k}" for k in range(1, 7))


@query("month_slots", f"""
    WITH {CLAIMS_SQL} SELECT member_id, {_SLOTS_SQL} FROM claims JOIN idx USING (member_id)
    WHERE sm BETWEEN m + 1 AND m + 6 GROUP BY 1""")
def slots(spark: SparkSession, d: str, months: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    months = claim_months(spark, d) if months is None else months
    return windows.month_slots(months, windowed_members(spark, d, index), v.MEMBER, "line_count", "lines")


@query("trend_slope", f"""
    WITH {CLAIMS_SQL},
    slot AS (SELECT member_id, sm - m AS x, count(*) AS y FROM claims JOIN idx USING (member_id)
      WHERE sm BETWEEN m + 1 AND m + 6 GROUP BY 1, 2),
    grid AS (SELECT s.member_id, g.x, coalesce(slot.y, 0) AS y FROM (SELECT DISTINCT member_id FROM slot) s
      CROSS JOIN (SELECT unnest(range(1, 7)) AS x) g LEFT JOIN slot ON slot.member_id = s.member_id AND slot.x = g.x)
    SELECT c_custkey AS member_id, coalesce(slope, 0) AS lines_slope FROM customer LEFT JOIN (
      SELECT member_id, round(regr_slope(y, x), 6) AS slope FROM grid GROUP BY 1) ON c_custkey = member_id""")
def slope(spark: SparkSession, d: str, months: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    trend = slots(spark, d, months, index).select("member_id", windows.slot_slope("lines").alias("lines_slope"))
    spine = load(spark, d, "customer", "c_custkey").withColumnRenamed("c_custkey", "member_id")
    return joins.spine_fill(spine, trend, v.MEMBER, 0.0)


# --- completeness and payment -------------------------------------------------

FIELDS = {
    "procedure": "procedure_code", "start": "service_date", "end": "ship_date", "drg": "drg_code",
    "diagnosis": "diagnosis_code", "service_npi": "l_suppkey", "service_specialty": "specialty_code",
    "billing_npi": "billing_npi", "billing_specialty": "billing_specialty",
}


def _gappy_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose codes are blank for some flag, status and quantity values."""
    raw = v.lines(spark, d, "l_suppkey", "l_quantity", "l_linestatus", "l_shipdate", "l_partkey")
    flag, status, quantity = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    return raw.select(
        "claim_id", "line_no", "line_amount",
        F.when(flag == "A", F.col("l_partkey")).alias("procedure_code"),
        F.to_date("l_shipdate").alias("ship_date"),
        F.when(quantity > 40, F.col("l_partkey")).alias("drg_code"),
        F.when((status == "F") | (flag == "N"), F.col("l_partkey")).alias("diagnosis_code"),
        F.when(quantity < 25, F.col("l_suppkey")).alias("l_suppkey"),
        F.when(flag == "R", F.col("l_suppkey")).alias("specialty_code"),
    )


@query("claim_missingness", f"""
    WITH {v.PERSONS_SQL}, claim AS (
      SELECT o_orderkey, any_value(state) AS state, max(CAST(l_returnflag = 'A' AS INTEGER)) AS p,
        max(CAST(l_quantity > 40 AS INTEGER)) AS g, max(CAST(l_linestatus = 'F' OR l_returnflag = 'N' AS INTEGER)) AS x,
        max(CAST(l_quantity < 25 OR l_returnflag = 'R' OR o_orderpriority = '1-URGENT' OR o_totalprice > 250000 AS INTEGER)) AS w
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN persons ON o_custkey = member_id
      WHERE o_orderstatus IN {TYPES_SQL} GROUP BY 1)
    SELECT coalesce(state, 'ALL') AS state, CAST(sum(p * g * x * w) AS BIGINT) AS "all",
      CAST(sum(g * x * w) AS BIGINT) AS "noProc", CAST(sum(x * w) AS BIGINT) AS "noProcDrg", count(*) AS total_claims
    FROM claim GROUP BY ROLLUP (state)""")
def missingness(spark: SparkSession, d: str) -> DataFrame:
    priority = load(spark, d, "orders", F.col("o_orderkey").alias("claim_id"), "o_orderpriority", "o_custkey",
                    "o_orderstatus", "o_totalprice", "o_orderdate")
    head = priority.where(F.col("o_orderstatus").isin(v.CLAIM_TYPES)).select(
        "claim_id", F.col("o_custkey").alias("member_id"), F.to_date("o_orderdate").alias("service_date"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).alias("billing_npi"),
        F.when(F.col("o_totalprice") > 250000, F.col("o_custkey")).alias("billing_specialty"))
    tiers = codes.COMPLETENESS_TIERS["inpatient"]
    # presence per claim is taken on each side before the join: the line side holds one row per claim
    line_fields = {f: c for f, c in FIELDS.items() if f not in ("start", "billing_npi", "billing_specialty")}
    line_flags = cost.claim_completeness(_gappy_lines(spark, d), ["claim_id"], line_fields, {})
    joined = head.join(line_flags, "claim_id")
    flags = joined.withColumns({f: present(F.col(FIELDS[f])) for f in ("start", "billing_npi", "billing_specialty")})
    claims = cost.claim_completeness(
        flags.withColumns({f: F.when(F.col(f) == 1, 1) for f in FIELDS}), ["claim_id", "member_id"],
        {f: f for f in FIELDS}, tiers)
    with_state = claims.join(v.persons(spark, d).select("member_id", "state"), "member_id")
    return cost.completeness_report(with_state, "state", list(tiers))


CLAIM_COST_SQL = f"""costed AS (
  SELECT o_orderkey AS claim_id, o_custkey AS member_id,
    sum(CASE WHEN o_orderstatus = 'O' THEN CAST(l_extendedprice AS {MONEY}) ELSE 0 END) AS mc,
    max(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS {MONEY}) ELSE 0 END) AS ffs,
    sum(CASE WHEN o_orderstatus = 'F' THEN CAST(l_extendedprice AS {MONEY}) ELSE 0 END) AS ffs_lines
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus IN {TYPES_SQL} GROUP BY 1, 2)"""


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in ("mc_total", "ffs_total", "total_cost")})


@query("claim_cost", f"""
    WITH {CLAIM_COST_SQL}
    SELECT claim_id, member_id, CAST(mc AS DOUBLE) AS mc_total, CAST(ffs AS DOUBLE) AS ffs_total,
      CAST(mc + ffs AS DOUBLE) AS total_cost, 'header' AS family FROM costed
    UNION ALL SELECT claim_id, member_id, CAST(mc AS DOUBLE), CAST(ffs_lines AS DOUBLE), CAST(mc + ffs_lines AS DOUBLE), 'line'
    FROM costed""")
def claim_costs(spark: SparkSession, d: str) -> DataFrame:
    header_paid = _plain(header_paid_claims(spark, d)).withColumn("family", F.lit("header"))
    line_paid = _plain(line_paid_claims(spark, d)).withColumn("family", F.lit("line"))
    return header_paid.unionByName(line_paid)


def _line_sums(spark: SparkSession, d: str, ffs_from_lines: bool, claims: DataFrame | None = None) -> DataFrame:
    """Costed claims with lines summed before the join, so a claim with very many lines
    meets its header as one row. Averaging a repeated header amount gives the amount itself."""
    joined = claim_totals(spark, d) if claims is None else claims
    ffs_source = "paid" if ffs_from_lines else "header_amount"
    return joined.withColumns(cost.payment_columns("claim_type", ffs_source, "paid", v.FFS, v.MC))


def header_paid_claims(spark: SparkSession, d: str) -> DataFrame:
    return cost.claim_cost(_line_sums(spark, d, False), CLAIM, "mean")


def line_paid_claims(spark: SparkSession, d: str) -> DataFrame:
    return cost.claim_cost(_line_sums(spark, d, True), CLAIM, "sum")


POST_COST_SQL = f"""{CLAIM_COST_SQL}, {v.INDEX_SQL},
post_costed AS (SELECT costed.* FROM costed JOIN orders ON claim_id = o_orderkey JOIN idx ON idx.member_id = costed.member_id
  WHERE {v.sql_months('o_orderdate')} BETWEEN m + 7 AND m + 12)"""


@query("total_cost", f"""
    WITH {POST_COST_SQL}
    SELECT c_custkey AS member_id, CAST(coalesce(sum(mc), 0) AS DOUBLE) AS mc_total,
      CAST(coalesce(sum(ffs), 0) AS DOUBLE) AS ffs_total, CAST(coalesce(sum(mc + ffs), 0) AS DOUBLE) AS total_cost
    FROM customer LEFT JOIN post_costed ON c_custkey = member_id GROUP BY 1""")
def total_cost(spark: SparkSession, d: str, claims: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """Cost of the claims of the post period, the target of the cost models. Other claims are left out before any is costed."""
    dates = v.headers(spark, d).select("claim_id", "member_id", "service_date")
    inside = windows.prepost_window(dates, windowed_members(spark, d, index), v.MEMBER, "service_date", v.BASE_YEAR)
    paid = joins.restrict_to(_line_sums(spark, d, False, claims), inside.where(F.col("post") == 1), ["claim_id"])
    per_member = _plain(cost.member_cost([cost.claim_cost(paid, CLAIM, "mean")], v.MEMBER))
    spine = load(spark, d, "customer", "c_custkey").withColumnRenamed("c_custkey", "member_id")
    return joins.spine_fill(spine, per_member, v.MEMBER, 0.0)


@query("payment_missingness", f"""
    WITH {v.PERSONS_SQL}, claim AS (
      SELECT o_orderkey, any_value(state) AS state, max(CAST(o_orderstatus = 'F' AND o_totalprice < 50000 AS INTEGER)) AS nf,
        max(CAST(o_orderstatus = 'O' AND l_quantity < 3 AS INTEGER)) AS nm,
        max(CAST(o_orderstatus = 'F' AS INTEGER)) AS f, max(CAST(o_orderstatus = 'O' AS INTEGER)) AS c
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN persons ON o_custkey = member_id
      WHERE o_orderstatus IN {TYPES_SQL} GROUP BY 1)
    SELECT state, CAST(sum(nf) AS BIGINT) AS missing_ffs, CAST(sum(nm) AS BIGINT) AS missing_mc,
      CAST(sum(f) AS BIGINT) AS ffs_claim, CAST(sum(c) AS BIGINT) AS mc_claim, count(*) AS total FROM claim GROUP BY 1""")
def payment_gaps(spark: SparkSession, d: str) -> DataFrame:
    # a claim lacks a line amount when any of its lines does: keep the null if there is one
    amount = F.when(F.col("l_quantity") >= 3, F.col("line_amount"))
    per_claim = v.lines(spark, d, "l_quantity").groupBy("claim_id").agg(
        F.when(F.count(amount) == F.count("*"), F.max(amount)).alias("line_amount"))
    joined = joins.header_lines(v.headers(spark, d), per_claim, ["claim_id"], "claim_type", v.CLAIM_TYPES)
    gaps = joined.withColumn("header_amount", F.when(F.col("header_amount") >= 50000, F.col("header_amount")))
    with_state = gaps.join(v.persons(spark, d).select("member_id", "state"), "member_id")
    return cost.payment_gaps(with_state, ["claim_id"], "state", "claim_type", "header_amount", "line_amount", v.FFS, v.MC)


@query("spend_by_state", f"""
    WITH {v.PERSONS_SQL}, {CLAIM_COST_SQL}
    SELECT state, CAST(sum(mc) AS DOUBLE) AS mc_total, CAST(sum(ffs) AS DOUBLE) AS ffs_total
    FROM costed JOIN persons USING (member_id) GROUP BY 1""")
def spend_by_state(spark: SparkSession, d: str) -> DataFrame:
    per_member = cost.member_cost([header_paid_claims(spark, d)], v.MEMBER)
    placed = per_member.join(v.persons(spark, d).select("member_id", "state"), "member_id")
    return placed.groupBy("state").agg(
        F.sum("mc_total").cast("double").alias("mc_total"), F.sum("ffs_total").cast("double").alias("ffs_total"))


@query("strata_split", f"""
    WITH {v.MEMBERS_SQL}
    SELECT member_id, CASE WHEN disabled = 'yes' THEN 'disabled'
        WHEN disabled = 'no' AND age_cat IN ('under10', '10To17') THEN 'kids'
        WHEN disabled = 'no' AND age_cat <> 'missing' THEN 'adults' END AS stratum,
      CASE WHEN disabled = 'yes' THEN 'disabled' WHEN disabled = 'no' AND age >= 18 THEN 'adults'
        WHEN disabled = 'no' AND age < 18 THEN 'kids' END AS stratum_by_age
    FROM members WHERE state IN {v.sql_list(codes.COST_STATES)}""")
def strata(spark: SparkSession, d: str) -> DataFrame:
    people = v.members(spark, d).where(F.col("state").isin(codes.COST_STATES))
    flag = F.when(F.col("disabled") == "yes", 1).when(F.col("disabled") == "no", 0)
    return people.select(
        "member_id", cost.stratum(F.col("age_cat"), F.col("disabled")).alias("stratum"),
        cost.stratum_by_age(F.floor("age"), flag).alias("stratum_by_age"))
