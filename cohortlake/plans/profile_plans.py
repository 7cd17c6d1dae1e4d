"""Scans, recodes, profiles and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.dates import month_index, trend_slope
from cohortlake.functions.recode import composite_flag, recode, region, row_sum, to_int
from cohortlake.operators import joins, profile
from cohortlake.plans import views as v
from cohortlake.plans.registry import query
from cohortlake.sources.tables import clean_code, drop_null_keys, load, stack_years, year_slice


@query("scan_project", """
    SELECT o_orderkey AS claim_id, o_custkey AS member_id, o_totalprice AS amount FROM orders""")
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return df.withColumnsRenamed({"o_orderkey": "claim_id", "o_custkey": "member_id", "o_totalprice": "amount"})


@query("drop_null_keys", """
    SELECT c_custkey AS member_id, c_nationkey AS county FROM customer WHERE c_acctbal >= 0""")
def null_keys(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    county = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey"))
    return drop_null_keys(c.select(F.col("c_custkey").alias("member_id"), county.alias("county")), ["member_id", "county"])


@query("monthly_scan", """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS line_count,
      count(DISTINCT l_orderkey) AS claims, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS paid
    FROM lineitem GROUP BY 1, 2""")
def monthly_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem", "l_orderkey", "l_shipdate", "l_extendedprice")
    year, month = F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")
    amount = F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
    # claims are counted from (year, month, claim) groups: no task holds a set of claim keys
    per_claim = lines.groupBy(year, month, "l_orderkey").agg(F.count("*").alias("n"), amount.alias("paid"))
    return per_claim.groupBy("year", "month").agg(
        F.sum("n").alias("line_count"), F.count("*").alias("claims"), F.sum("paid").cast("double").alias("paid")
    )


@query("stack_years", """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS claims,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def stacked(spark: SparkSession, d: str) -> DataFrame:
    """One frame per calendar year from the first to the last that the table holds."""
    orders = load(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    first, last = orders.agg(F.year(F.min("o_orderdate")), F.year(F.max("o_orderdate"))).first()
    years = range(first, last + 1) if first else [0]
    frames = {y: year_slice(orders, "o_orderdate", y) for y in years}
    return stack_years(frames).groupBy("year").agg(
        F.count("*").alias("claims"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"),
    )


@query("age_band", f"""
    WITH {v.PERSONS_SQL} SELECT member_id, {v.AGE_BAND_SQL} AS age_cat FROM persons""")
def age_bands(spark: SparkSession, d: str) -> DataFrame:
    return v.members(spark, d).select("member_id", "age_cat")


@query("recode_categories", f"""
    WITH {v.PERSONS_SQL}
    SELECT member_id,
      {v.sql_case('death_code', codes.TEXT_RECODES['death'])} AS death, {v.SEX_SQL} AS sex, {v.RACE_SQL} AS race,
      CASE WHEN english_code IN ('0', '1') THEN 'yes' WHEN english_code IN ('2', '3') THEN 'no' ELSE 'missing' END AS "speakEnglish",
      CASE WHEN married_code BETWEEN '01' AND '08' THEN 'yes' WHEN married_code BETWEEN '09' AND '14' THEN 'no'
        ELSE 'missing' END AS married,
      {v.sql_case('house_code', codes.TEXT_RECODES['houseSize'])} AS "houseSize",
      {v.sql_case('income_code', codes.TEXT_RECODES['fedPovLine'])} AS "fedPovLine",
      CASE citizen_code WHEN '1' THEN 'yes' WHEN '0' THEN 'no' ELSE 'missing' END AS "UsCitizen",
      CASE ssdi_code WHEN '1' THEN 'yes' WHEN '0' THEN 'no' ELSE 'missing' END AS ssdi,
      CASE ssi_code WHEN '1' THEN 'yes' WHEN '0' THEN 'no' ELSE 'missing' END AS ssi,
      CASE tanf_code WHEN '2' THEN 'yes' WHEN '0' THEN 'no' WHEN '1' THEN 'no' ELSE 'missing' END AS tanf
    FROM persons""")
def recodes(spark: SparkSession, d: str) -> DataFrame:
    source = {
        "death": "death_code", "sex": "sex_code", "married": "married_code", "houseSize": "house_code",
        "fedPovLine": "income_code", "UsCitizen": "citizen_code", "ssdi": "ssdi_code", "ssi": "ssi_code",
        "race": "race_code", "speakEnglish": "english_code", "tanf": "tanf_code",
    }
    text = [recode(F.col(source[n]), t).alias(n) for n, t in codes.TEXT_RECODES.items()]
    number = [recode(F.col(source[n]), t, numeric=True).alias(n) for n, t in codes.NUMBER_RECODES.items()]
    return v.persons(spark, d).select("member_id", *text, *number)


@query("composite_flag", f"WITH {v.PERSONS_SQL} SELECT member_id, {v.DISABLED_SQL} AS disabled FROM persons")
def disabled(spark: SparkSession, d: str) -> DataFrame:
    flags = [F.col(f"disability_{i}") for i in range(7)]
    return v.persons(spark, d).select("member_id", composite_flag(flags).alias("disabled"))


@query("region_recode", f"""
    WITH {v.PERSONS_SQL}
    SELECT {v.sql_case('state', codes.REGIONS, codes.OTHER_REGION)} AS region, count(*) AS n FROM persons GROUP BY 1""")
def regions(spark: SparkSession, d: str) -> DataFrame:
    return v.persons(spark, d).select(region(F.col("state")).alias("region")).groupBy("region").agg(F.count("*").alias("n"))


def _gappy(spark: SparkSession, d: str) -> DataFrame:
    """Customers left joined to their first-year spending, with empty and 'None' texts."""
    from cohortlake.functions.dates import before

    o = load(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate")
    early = o.where(before(F.col("o_orderdate"), "1996-01-01")).groupBy("o_custkey").agg(F.max("o_totalprice").alias("spend"))
    c = load(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    zip_code = F.when(F.col("c_mktsegment") == "BUILDING", "").when(
        F.col("c_mktsegment") == "HOUSEHOLD", "None").otherwise(F.col("c_mktsegment"))
    balance = F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return joins.enrich(c, early.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select(
        "c_custkey", zip_code.alias("zip_code"), balance.alias("balance"), "spend"
    )


@query("null_profile", """
    WITH early AS (SELECT o_custkey, max(o_totalprice) AS spend FROM orders WHERE year(o_orderdate) < 1996 GROUP BY 1),
    gaps AS (
      SELECT count(*) AS total, 0 AS c_custkey,
        count(*) FILTER (c_mktsegment IN ('BUILDING', 'HOUSEHOLD')) AS zip_code,
        count(*) FILTER (c_acctbal < 0) AS balance, count(*) FILTER (spend IS NULL) AS spend
      FROM customer LEFT JOIN early ON c_custkey = o_custkey)
    SELECT name AS column_name, CAST(missing AS BIGINT) AS missing, total, round(missing * 100.0 / total, 4) AS percent_missing
    FROM (SELECT 'c_custkey' AS name, c_custkey AS missing, total FROM gaps
      UNION ALL SELECT 'zip_code', zip_code, total FROM gaps
      UNION ALL SELECT 'balance', balance, total FROM gaps UNION ALL SELECT 'spend', spend, total FROM gaps)""")
def nulls(spark: SparkSession, d: str) -> DataFrame:
    return profile.null_profile(_gappy(spark, d), ["c_custkey", "zip_code", "balance", "spend"])


@query("frequency_table", """
    SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1""")
def frequencies(spark: SparkSession, d: str) -> DataFrame:
    return profile.frequency_table(load(spark, d, "orders", "o_orderpriority"), "o_orderpriority")


@query("percent_distribution", f"""
    WITH {v.MEMBERS_SQL}
    SELECT age_cat, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent
    FROM members GROUP BY 1""")
def percents(spark: SparkSession, d: str) -> DataFrame:
    return profile.percent_distribution(v.members(spark, d).select("age_cat"), "age_cat")


@query("group_rates", f"""
    WITH {v.MEMBERS_SQL},
    months AS (SELECT o_custkey AS member_id, count(DISTINCT {v.sql_months('o_orderdate')}) AS months FROM orders GROUP BY 1),
    flagged AS (SELECT members.*, coalesce(months, 0) AS months, CAST(coalesce(months, 0) >= 10 AS INTEGER) AS enrolled
      FROM members LEFT JOIN months USING (member_id)),
    long AS (SELECT 'all' AS dimension, 'all' AS value, * FROM flagged UNION ALL SELECT 'state', state, * FROM flagged
      UNION ALL SELECT 'age_cat', age_cat, * FROM flagged UNION ALL SELECT 'sex', sex, * FROM flagged
      UNION ALL SELECT 'race', race, * FROM flagged)
    SELECT dimension, value, count(*) AS members, CAST(sum(enrolled) AS BIGINT) AS flagged,
      round(avg(months), 2) AS mean_months, round(sum(enrolled) / count(*) * 100, 2) AS percent
    FROM long GROUP BY 1, 2""")
def rates(spark: SparkSession, d: str) -> DataFrame:
    months = v.order_months(spark, d).distinct().groupBy("member_id").agg(F.count("*").alias("months"))
    people = joins.spine_fill(v.members(spark, d), months, v.MEMBER)
    flagged = people.withColumn("enrolled", (F.col("months") >= 10).cast("int"))
    return profile.group_rates(flagged, ["state", "age_cat", "sex", "race"], "enrolled", "months")


@query("describe_numeric", """
    SELECT 'o_totalprice' AS column_name, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean,
      round(stddev_samp(o_totalprice), 4) AS stddev, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders""")
def described(spark: SparkSession, d: str) -> DataFrame:
    return profile.describe_numeric(load(spark, d, "orders", "o_totalprice"), ["o_totalprice"])


@query("distinct_counts", """
    SELECT 'l_partkey' AS column_name, count(DISTINCT l_partkey) AS n_distinct FROM lineitem
    UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem
    UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem""")
def distincts(spark: SparkSession, d: str) -> DataFrame:
    columns = ["l_partkey", "l_suppkey", "l_returnflag"]
    return profile.distinct_counts(load(spark, d, "lineitem", *columns), columns)


@query("dedup_first", """
    SELECT member_id, service_date, claim_id, amount FROM (
      SELECT o_custkey AS member_id, CAST(o_orderdate AS DATE) AS service_date, o_orderkey AS claim_id, o_totalprice AS amount,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedup(spark: SparkSession, d: str) -> DataFrame:
    claims = v.headers(spark, d).select("member_id", "service_date", "claim_id", F.col("header_amount").alias("amount"))
    return profile.keep_first(claims, ["member_id"], ["service_date", "claim_id"])


@query("demographic_resolve", """
    SELECT o_custkey AS member_id, max(o_orderstatus) AS status, max(o_orderpriority) AS priority FROM orders GROUP BY 1""")
def resolved(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority").withColumnsRenamed(
        {"o_custkey": "member_id", "o_orderstatus": "status", "o_orderpriority": "priority"})
    return profile.resolve_by_max(o, ["member_id"], ["status", "priority"])


@query("distinct_events", """
    SELECT DISTINCT l_suppkey AS provider, CAST(l_shipdate AS DATE) AS service_date, nullif(l_returnflag, 'N') AS code
    FROM lineitem WHERE l_returnflag <> 'N'""")
def events(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "lineitem", "l_suppkey", "l_shipdate", "l_returnflag").select(
        F.col("l_suppkey").alias("provider"), F.to_date("l_shipdate").alias("service_date"),
        F.nullif("l_returnflag", F.lit("N")).alias("code"))
    return profile.distinct_events(raw, ["provider", "service_date", "code"], ["code"])


@query("binary_outcome", """
    SELECT c_custkey AS member_id, CAST(count(o_orderkey) FILTER (o_orderstatus = 'P') > 0 AS INTEGER) AS outcome,
      CASE WHEN count(o_orderkey) FILTER (year(o_orderdate) < 1996) > 0 THEN 'yes' ELSE 'no' END AS prior_coverage
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def binary(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderdate")
    counts = o.groupBy(F.col("o_custkey").alias("member_id")).agg(
        F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
        F.count_if(F.year("o_orderdate") < 1996).alias("prior"))
    spine = load(spark, d, "customer", "c_custkey").withColumnRenamed("c_custkey", "member_id")
    return joins.spine_fill(spine, counts, v.MEMBER).select(
        "member_id", (F.col("pending") > 0).cast("int").alias("outcome"),
        F.when(F.col("prior") > 0, "yes").otherwise("no").alias("prior_coverage"))


@query("enrich_left", f"""
    WITH {v.PERSONS_SQL}
    SELECT o_orderkey AS claim_id, state, CAST(state IS NOT NULL AS INTEGER) AS demo_found
    FROM orders LEFT JOIN (SELECT * FROM persons WHERE age IS NOT NULL) ON o_custkey = member_id""")
def enriched(spark: SparkSession, d: str) -> DataFrame:
    known = v.persons(spark, d).where(F.col("age").isNotNull()).select("member_id", "state")
    claims = v.headers(spark, d).select("claim_id", "member_id")
    return joins.enrich(claims, known, v.MEMBER, "demo_found").select("claim_id", "state", "demo_found")


@query("cohort_semi", """
    SELECT o_orderkey AS claim_id, o_custkey AS member_id FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 6500)""")
def semi(spark: SparkSession, d: str) -> DataFrame:
    cohort = v.persons(spark, d).where(F.col("age").between(0, 65)).select("member_id")
    return joins.restrict_to(v.headers(spark, d).select("claim_id", "member_id"), cohort, v.MEMBER)


@query("crosstab", f"""
    WITH {v.SCORED_SQL}
    SELECT prediction, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1
    FROM scored GROUP BY 1""")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return profile.crosstab(v.scored(spark, d), "prediction", "label", {"label_0": 0, "label_1": 1})


@query("scalar_functions", f"""
    SELECT o_orderkey AS claim_id, o_orderstatus || substr(o_orderpriority, 1, 1) AS county,
      substr(o_orderpriority, 1, 3) AS prefix, 'x' || o_orderstatus AS unquoted, contains(o_orderpriority, 'LOW') AS has_low,
      CAST({v.sql_months('o_orderdate')} AS INTEGER) AS month_idx,
      CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
      CAST(o_orderdate AS DATE) + 30 AS supply_end, round(o_totalprice / 7, 2) AS rounded,
      CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands,
      CASE WHEN o_custkey > 0 THEN o_totalprice / o_custkey END AS ratio, abs(1000 - o_totalprice) AS gap,
      CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS kind,
      coalesce(nullif(o_orderstatus, 'P'), 'none') AS filled, CAST(nullif(o_orderstatus, 'P') IS NULL AS INTEGER) AS was_null,
      try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) + 1 AS priority_plus,
      try_cast(o_orderstatus AS INTEGER) AS bad_cast,
      CAST(round((year(o_orderdate) - month(o_orderdate)) * 0.5, 6) AS DOUBLE) AS slope,
      array_to_string([o_orderstatus, substr(o_orderpriority, 1, 1), CAST(o_custkey AS VARCHAR)], '/') AS joined_array,
      CAST(coalesce(o_custkey, 0) + coalesce(try_cast(o_orderstatus AS BIGINT), 0) + month(o_orderdate) AS BIGINT) AS row_total
    FROM orders""")
def scalars(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    price, status, priority, day = (F.col(c) for c in ("o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate"))
    known = F.nullif("o_orderstatus", F.lit("P"))
    return o.select(
        F.col("o_orderkey").alias("claim_id"), F.concat(status, F.substring(priority, 1, 1)).alias("county"),
        F.substring(priority, 1, 3).alias("prefix"),
        clean_code(F.concat(F.lit(" 'x"), status, F.lit("' "))).alias("unquoted"),
        priority.contains("LOW").alias("has_low"), month_index(day, v.BASE_YEAR).alias("month_idx"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"),
        F.date_add(day.cast("date"), 30).alias("supply_end"), F.round(price / 7, 2).alias("rounded"),
        F.floor(price / 1000).alias("thousands"),
        F.try_divide(price, F.col("o_custkey")).alias("ratio"), F.abs(1000 - price).alias("gap"),
        recode(status, {1: ["F"], 2: ["O"]}, 0).alias("kind"),
        F.coalesce(known, F.lit("none")).alias("filled"), known.isNull().cast("int").alias("was_null"),
        (to_int(F.substring(priority, 1, 1)) + 1).cast("int").alias("priority_plus"),
        to_int(status).cast("int").alias("bad_cast"),
        # slope through two points, one step apart
        F.round(trend_slope([F.month(day), F.year(day)]) / 2, 6).alias("slope"),
        F.array_join(F.array(status, F.substring(priority, 1, 1), F.col("o_custkey").cast("string")), "/").alias("joined_array"),
        row_sum([F.col("o_custkey"), to_int(status), F.month(day)]).cast("long").alias("row_total"),
    )
