"""Files written from the given tables and read back, completeness of the other claim families, and
cohorts of people with records in several states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import codes, sql
from cohortlake.operators import cost, panel, profile
from cohortlake.plans import feature_plans, views as v
from cohortlake.plans.registry import query
from cohortlake.session import new_path
from cohortlake.sources import tables
from cohortlake.sources.tables import load

# --- sources and sinks --------------------------------------------------------


@query("month_partition_read", """
    SELECT CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS line_count,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS paid
    FROM lineitem WHERE month(l_shipdate) IN (1, 2, 3, 11) GROUP BY 1""")
def month_partition_read(spark: SparkSession, d: str) -> DataFrame:
    """Lines written by month of all years; four months are opened, the other folders are not. The rebalance gathers
    a month's rows in few files and splits a month that exceeds the advised partition size."""
    path = new_path(spark, "months")
    lines = load(spark, d, "lineitem", "l_orderkey", "l_extendedprice", F.month("l_shipdate").alias("month"))
    tables.save_table(lines.where("month is not null").hint("rebalance", "month"), path, ["month"])
    some = tables.month_partitions(spark, path, [1, 2, 3, 11], ["l_extendedprice"])
    return some.groupBy("month").agg(
        F.count("*").alias("line_count"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("paid"))


def _list_of_codes(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part", "p_brand", "p_size", "p_type")
    code = F.concat(F.lit("'0"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.substring("p_brand", 7, 2), F.lit("'"))
    return p.select(code.alias("Code"), F.concat(F.lit(" '"), "p_type", F.lit("' ")).alias("Category"))


_CODES_SQL = "SELECT DISTINCT '0' || lpad(CAST(p_size AS VARCHAR), 3, '0') || substr(p_brand, 7, 2) AS code, p_type AS category FROM part"


@query("code_list_csv", _CODES_SQL)
def code_list_csv(spark: SparkSession, d: str) -> DataFrame:
    """A quoted code list with leading zeros, as comma-separated text and back."""
    path = new_path(spark, "codes-csv")
    tables.save_report(_list_of_codes(spark, d), path)
    return tables.read_code_list(spark, path, {"Code": "code", "Category": "category"}, quote_mark="'")


@query("code_list_tab", _CODES_SQL)
def code_list_tab(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "codes-tab")
    _list_of_codes(spark, d).write.csv(path, header=True, sep="\t")
    return tables.read_code_list(spark, path, {"Code": "code", "Category": "category"}, separator="\t", quote_mark="'")


@query("area_export", f"""
    WITH {feature_plans.RATES_SQL} SELECT CAST(county AS VARCHAR) AS county, CAST(area AS VARCHAR) AS state,
      round(rich_rate, 4) AS rich, round(debt_rate, 4) AS debt FROM rates""")
def area_export(spark: SparkSession, d: str) -> DataFrame:
    """County rates with gaps, as an export file and back."""
    path = new_path(spark, "area")
    rates = feature_plans.area_rates(spark, d).select(
        F.col("area").alias("STATE"), F.col("county").alias("COUNTYFIPS"), F.col("rich_rate").alias("RICH"), F.col("debt_rate").alias("DEBT"))
    tables.save_report(rates, path)
    back = tables.read_area_rates(spark, path, {"RICH": "rich", "DEBT": "debt"})
    return back.withColumns({c: F.round(c, 4) for c in ("rich", "debt")})


@query("table_sink", """
    SELECT o_custkey AS member_id, count(*) AS claims, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM orders GROUP BY 1""")
def table_sink(spark: SparkSession, d: str) -> DataFrame:
    """A stage table, written twice (the second replaces the first) and read back."""
    path = new_path(spark, "table")
    orders = load(spark, d, "orders", F.col("o_custkey").alias("member_id"), "o_totalprice")
    tables.save_table(orders.select("member_id"), path)
    tables.save_table(orders.groupBy("member_id").agg(
        F.count("*").alias("claims"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount")), path)
    return spark.read.parquet(path)


@query("month_replace", """
    SELECT CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS line_count,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN month(l_shipdate) = 2 THEN 2 ELSE 1 END) AS DOUBLE) AS paid
    FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1""")
def month_replace(spark: SparkSession, d: str) -> DataFrame:
    """A table by month of which a corrected February replaces the stored one; the other folders stay as they are."""
    path = new_path(spark, "replaced")
    price = F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    lines = load(spark, d, "lineitem", price, F.month("l_shipdate").alias("month")).where("month is not null")
    tables.save_table(lines.hint("rebalance", "month"), path, ["month"])
    corrected = lines.where("month = 2").withColumn("price", F.col("price") * 2).hint("rebalance")
    tables.replace_partitions(corrected.select(F.col("price").cast("decimal(18,2)"), "month"), path, ["month"])
    return spark.read.parquet(path).groupBy("month").agg(
        F.count("*").alias("line_count"), F.sum("price").cast("double").alias("paid"))


@query("bucketed_join", """
    SELECT c_custkey AS member_id, c_nationkey AS county, claims, amount FROM customer
    JOIN (SELECT o_custkey, count(*) AS claims, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
      FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def bucketed_join(spark: SparkSession, d: str) -> DataFrame:
    """Two blocks stored in buckets of the member; their join needs no exchange however large they are."""
    people = load(spark, d, "customer", F.col("c_custkey").alias("member_id"), F.col("c_nationkey").alias("county"))
    claims = load(spark, d, "orders", F.col("o_custkey").alias("member_id"), "o_totalprice").groupBy("member_id").agg(
        F.count("*").alias("claims"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = []
    for label, block in (("people", people), ("claims", claims)):
        path = new_path(spark, label)
        # one file per bucket: rows meet their bucket before the write
        block = block.repartition(buckets, *v.MEMBER)
        stored.append(tables.save_bucketed(block, path.rsplit("/", 1)[-1].replace("-", "_"), path, v.MEMBER, buckets))
    return stored[0].join(stored[1], v.MEMBER)


@query("sql_text_block", f"""
    WITH {v.MEMBERS_SQL}
    SELECT {v.sql_case('m.state', codes.REGIONS, codes.OTHER_REGION)} AS region, {v.sql_months('o_orderdate')}::INTEGER AS month_idx,
      count(*) AS claims, count(DISTINCT m.member_id) AS members, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM orders JOIN members m ON o_custkey = m.member_id
    WHERE {v.sql_months('o_orderdate')} BETWEEN 13 AND 24 GROUP BY 1, 2""")
def sql_text_block(spark: SparkSession, d: str, first: int = 13, last: int = 24) -> DataFrame:
    """Claims by region and study month from SQL text over views, session functions and named parameters."""
    sql.register(spark)
    return spark.sql("""
        WITH placed AS (
          SELECT o_custkey AS member_id, study_month(CAST(o_orderdate AS DATE), :base_year) AS month_idx,
            CAST(o_totalprice AS DECIMAL(18,2)) AS price
          FROM {orders}),
        per_member AS (
          SELECT member_id, month_idx, count(*) AS n, sum(price) AS price FROM placed
          WHERE month_idx BETWEEN :first AND :last GROUP BY member_id, month_idx)
        SELECT region_of(state) AS region, month_idx, sum(n) AS claims, count(*) AS members, CAST(sum(price) AS DOUBLE) AS amount
        FROM per_member JOIN {members} USING (member_id) GROUP BY ALL""",
        args={"base_year": v.BASE_YEAR, "first": first, "last": last},
        orders=load(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice"),
        members=v.members(spark, d).select("member_id", "state"))


# --- completeness of the other families ---------------------------------------


def _present_sql(required, fields: dict[str, str]) -> str:
    tests = ["(" + " OR ".join(f"bool_or({fields[f]})" for f in r) + ")" if isinstance(r, list) else f"bool_or({fields[r]})" for r in required]
    return " AND ".join(tests)


# what of a line is filled, and its column in Spark
PRESENT = {
    "procedure": "l_returnflag = 'A'", "start": "TRUE", "end": "l_shipdate IS NOT NULL", "revenue": "l_linestatus = 'F'",
    "diagnosis": "l_linestatus = 'F' OR l_returnflag = 'N'", "service_npi": "l_quantity < 25", "service_specialty": "l_returnflag = 'R'",
    "billing_npi": "l_linenumber = 1 AND l_tax > 0.05", "billing_specialty": "l_discount > 0.08", "fill_date": "l_shipdate IS NOT NULL",
    "ndc": "l_partkey IS NOT NULL", "days_supply": "l_quantity > 10", "brand": "l_returnflag <> 'N'", "prescriber_npi": "l_quantity > 30",
}
FAMILIES = ["long_term", "other_services", "pharmacy"]


def _family_sql(family: str) -> str:
    tiers = codes.COMPLETENESS_TIERS[family]
    measures = ", ".join(f"CAST(CASE WHEN {_present_sql(r, PRESENT)} THEN 1 ELSE 0 END AS BIGINT) AS t{i}" for i, r in enumerate(tiers.values()))
    long = " UNION ALL ".join(f"SELECT state, '{family}' AS family, '{n}' AS tier, t{i} AS met FROM c_{family}" for i, n in enumerate(tiers))
    return f"""c_{family} AS (SELECT l_orderkey, any_value(state) AS state, {measures} FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN persons ON o_custkey = member_id GROUP BY 1), l_{family} AS ({long})"""


@query("completeness_by_family", f"""
    WITH {v.PERSONS_SQL}, {", ".join(map(_family_sql, FAMILIES))}
    SELECT family, coalesce(state, 'ALL') AS state, tier, CAST(sum(met) AS BIGINT) AS claims, count(*) AS total_claims
    FROM ({" UNION ALL ".join(f"SELECT * FROM l_{f}" for f in FAMILIES)}) GROUP BY GROUPING SETS ((family, tier, state), (family, tier))""")
def completeness_by_family(spark: SparkSession, d: str) -> DataFrame:
    """Claims that meet each tier of the long-term, other-services and pharmacy families."""
    raw = load(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_shipdate", "l_linestatus", "l_quantity", "l_linenumber", "l_tax",
               "l_discount", "l_partkey")
    filled = raw.select("l_orderkey", *[F.when(F.expr(test), 1).alias(f) for f, test in PRESENT.items()])
    tiers = {f"{family}.{tier}": fields for family in FAMILIES for tier, fields in codes.COMPLETENESS_TIERS[family].items()}
    claims = cost.claim_completeness(filled, ["l_orderkey"], {f: f for f in PRESENT}, tiers)
    owner = load(spark, d, "orders", F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("member_id"))
    placed = claims.join(owner, "l_orderkey").join(v.persons(spark, d).select("member_id", "state"), "member_id")
    renamed = placed.withColumnsRenamed({n: n.replace(".", "__") for n in tiers})
    names = [n.replace(".", "__") for n in tiers]
    report = cost.completeness_report(renamed, "state", names)
    long = report.unpivot(["state", "total_claims"], names, "measure", "claims")
    family, tier = F.split("measure", "__")[0], F.split("measure", "__")[1]
    return long.select(family.alias("family"), "state", tier.alias("tier"), F.col("claims").cast("bigint").alias("claims"), "total_claims")


@query("any_present_share", """
    SELECT count(*) FILTER (l_returnflag = 'A' OR l_quantity < 10) AS filled,
      round(avg(CAST(l_returnflag = 'A' OR l_quantity < 10 AS INTEGER)) * 100, 4) AS percent_filled FROM lineitem""")
def any_present(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_partkey", "l_suppkey")
    gappy = lines.select(
        F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("service_code"),
        F.when(F.col("l_quantity") < 10, F.col("l_suppkey")).alias("billing_code"))
    return profile.any_present_share(gappy, ["service_code", "billing_code"])


# --- people with records in several states ------------------------------------


@query("cohort_full_year", f"""
    WITH {v.PERSONS_SQL}, listed AS (
      SELECT DISTINCT c_custkey AS member_id, {v.sql_array(v.STATES)}[(c_nationkey + k) % 25 + 1] AS state, age_cat
      FROM customer JOIN (SELECT member_id, {v.AGE_BAND_SQL} AS age_cat FROM persons) b ON b.member_id = c_custkey, range(0, 3) t(k)
      WHERE k <= c_custkey % 3),
    one AS (SELECT member_id, min(state) AS state, any_value(age_cat) AS age_cat FROM listed GROUP BY 1),
    months AS (SELECT o_custkey AS member_id, count(DISTINCT month(o_orderdate)) AS enrolled_months FROM orders GROUP BY 1)
    SELECT member_id, state, age_cat, enrolled_months FROM one JOIN months USING (member_id)
    WHERE state IN {v.sql_list(codes.STUDY_STATES)} AND age_cat <> 'over64' AND enrolled_months = 12""")
def cohort_full_year(spark: SparkSession, d: str) -> DataFrame:
    """People listed in up to three states keep the first; only full years stay. A month counts if any year has an order in it."""
    people = v.members(spark, d).select("member_id", "nation_key", "age_cat")
    shift = F.explode(F.sequence(F.lit(0), (F.col("member_id") % 3).cast("int")))
    listed = people.withColumn("k", shift).select("member_id", v.state_code((F.col("nation_key") + F.col("k")) % 25).alias("state"), "age_cat")
    orders = load(spark, d, "orders", F.col("o_custkey").alias("member_id"), F.month("o_orderdate").alias("month")).distinct()
    months = orders.groupBy("member_id").agg(F.count("*").alias("enrolled_months"))
    summary = listed.select("member_id", "state").distinct().join(months, "member_id").withColumn("medicare_months", F.lit(0))
    chosen = panel.select_cohort(listed, summary, "member_id", "state", "age_cat", full_months=12)
    return chosen.select("member_id", "state", "age_cat", "enrolled_months")
