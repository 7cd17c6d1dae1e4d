"""Claims concepts read from the supplied tables, in Spark and as SQL fragments.

person            customer (or supplier, where many events per person are needed)
claim header      orders; type code o_orderstatus, F pays per service, O is managed care
claim line        lineitem
code list         part, supplier
scored set        labels joined to documents
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.dates import month_index
from cohortlake.functions.recode import age_band, composite_flag, recode
from cohortlake.sources.tables import load

BASE_YEAR = 1995
FFS, MC = ["F"], ["O"]
CLAIM_TYPES = [*FFS, *MC]
MEMBER = ["member_id"]

# 25 nations stand for 22 study states and 3 others
STATES = codes.STUDY_STATES[:22] + ["CA", "NY", "TX"]
DISABILITY_STEPS = [11, 13, 17, 19, 23, 29, 31]


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_array(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_months(date: str, base_year: int = BASE_YEAR) -> str:
    return f"((year({date}) - {base_year}) * 12 + month({date}))"


def sql_case(source: str, table: dict, default: str = "missing") -> str:
    branches = " ".join(f"WHEN {source} IN {sql_list(v)} THEN '{k}'" for k, v in table.items())
    return f"CASE {branches} ELSE '{default}' END"


def state_code(nation: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), nation + 1)


def persons(spark: SparkSession, d: str) -> DataFrame:
    """One raw demographic record per customer, codes as text."""
    c = load(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")

    def code(column: Column, modulus: int, width: int = 1) -> Column:
        return F.lpad((column % modulus).cast("string"), width, "0")

    flags = [
        F.when(key % 7 == 0, None).otherwise((key % s == 0).cast("int")).alias(f"disability_{i}") if i == 0
        else (key % s == 0).cast("int").alias(f"disability_{i}")
        for i, s in enumerate(DISABILITY_STEPS)
    ]
    return c.select(
        key.alias("member_id"), state_code(nation).alias("state"), nation.alias("nation_key"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100).alias("age"),
        F.col("c_mktsegment").alias("segment"),
        code(key, 3).alias("death_code"), F.substring("c_mktsegment", 1, 1).alias("sex_code"),
        code(nation, 9, 2).alias("race_code"), code(nation, 5).alias("english_code"),
        code(key, 16, 2).alias("married_code"), code(key, 10, 2).alias("house_code"),
        code(key, 11, 2).alias("income_code"), code(key, 3).alias("citizen_code"),
        code(key, 4).alias("ssdi_code"), code(key, 5).alias("ssi_code"), code(key, 4).alias("tanf_code"),
        *flags,
    )


_FLAG_SQL = ", ".join(
    f"CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % {s} = 0 AS INTEGER) END AS disability_{i}" if i == 0
    else f"CAST(c_custkey % {s} = 0 AS INTEGER) AS disability_{i}"
    for i, s in enumerate(DISABILITY_STEPS)
)
PERSONS_SQL = f"""persons AS (
  SELECT c_custkey AS member_id, {sql_array(STATES)}[c_nationkey + 1] AS state, c_nationkey AS nation_key,
    CASE WHEN c_acctbal >= 0 THEN c_acctbal / 100 END AS age, c_mktsegment AS segment,
    CAST(c_custkey % 3 AS VARCHAR) AS death_code, substr(c_mktsegment, 1, 1) AS sex_code,
    lpad(CAST(c_nationkey % 9 AS VARCHAR), 2, '0') AS race_code, CAST(c_nationkey % 5 AS VARCHAR) AS english_code,
    lpad(CAST(c_custkey % 16 AS VARCHAR), 2, '0') AS married_code,
    lpad(CAST(c_custkey % 10 AS VARCHAR), 2, '0') AS house_code,
    lpad(CAST(c_custkey % 11 AS VARCHAR), 2, '0') AS income_code, CAST(c_custkey % 3 AS VARCHAR) AS citizen_code,
    CAST(c_custkey % 4 AS VARCHAR) AS ssdi_code, CAST(c_custkey % 5 AS VARCHAR) AS ssi_code,
    CAST(c_custkey % 4 AS VARCHAR) AS tanf_code, {_FLAG_SQL}
  FROM customer)"""

AGE_BAND_SQL = """CASE WHEN age < 10 THEN 'under10' WHEN age < 18 THEN '10To17' WHEN age < 30 THEN '18To29'
    WHEN age < 40 THEN '30To39' WHEN age < 50 THEN '40To49' WHEN age < 65 THEN '50To64'
    WHEN age >= 65 THEN 'over64' ELSE 'missing' END"""
RACE_SQL = """CASE CAST(race_code AS INTEGER) WHEN 1 THEN 'white' WHEN 2 THEN 'black' WHEN 3 THEN 'asian'
    WHEN 4 THEN 'native' WHEN 5 THEN 'hawaiian' WHEN 6 THEN 'multiracial' WHEN 7 THEN 'hispanic'
    ELSE 'missing' END"""
DISABLED_SQL = (
    "CASE WHEN " + " OR ".join(f"disability_{i} = 1" for i in range(7)) + " THEN 'yes' WHEN "
    + " AND ".join(f"disability_{i} = 0" for i in range(7)) + " THEN 'no' ELSE 'missing' END"
)
SEX_SQL = "CASE sex_code WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' ELSE 'missing' END"
MEMBERS_SQL = f"""{PERSONS_SQL},
members AS (
  SELECT member_id, state, nation_key, age, {AGE_BAND_SQL} AS age_cat, {SEX_SQL} AS sex, {RACE_SQL} AS race,
    {DISABLED_SQL} AS disabled FROM persons)"""


def members(spark: SparkSession, d: str) -> DataFrame:
    """Recoded demographics per customer."""
    p = persons(spark, d)
    return p.select(
        "member_id", "state", "nation_key", "age", age_band(F.col("age")).alias("age_cat"),
        recode(F.col("sex_code"), codes.TEXT_RECODES["sex"]).alias("sex"),
        recode(F.col("race_code"), codes.NUMBER_RECODES["race"], numeric=True).alias("race"),
        composite_flag([F.col(f"disability_{i}") for i in range(7)]).alias("disabled"),
    )


def headers(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("member_id"),
        F.col("o_orderstatus").alias("claim_type"), F.col("o_totalprice").alias("header_amount"),
        F.to_date("o_orderdate").alias("service_date"),
    )


def lines(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """Claim lines: claim, line number, amounts and any further raw columns."""
    columns = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", *extra]
    raw = load(spark, d, "lineitem", *dict.fromkeys(columns))
    return raw.withColumnsRenamed(
        {"l_orderkey": "claim_id", "l_linenumber": "line_no", "l_extendedprice": "line_amount"}
    )


def index_months(spark: SparkSession, d: str) -> DataFrame:
    """Index month per customer: the month of the first order."""
    o = load(spark, d, "orders", "o_custkey", "o_orderdate")
    return o.groupBy(F.col("o_custkey").alias("member_id")).agg(
        F.min(month_index(F.col("o_orderdate"), BASE_YEAR)).alias("index_month")
    )


INDEX_SQL = f"""idx AS (
  SELECT o_custkey AS member_id, min({sql_months('o_orderdate')}) AS m FROM orders GROUP BY 1)"""


def order_months(spark: SparkSession, d: str) -> DataFrame:
    """Covered months: every month in which a customer has an order."""
    o = load(spark, d, "orders", "o_custkey", "o_orderdate")
    return o.select(
        F.col("o_custkey").alias("member_id"), month_index(F.col("o_orderdate"), BASE_YEAR).alias("month_idx")
    )


def wide_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Annual records of all years per customer and order priority: twelve columns per attribute.

    Several records per customer, as the source files have, so that combining
    duplicates matters.
    """
    o = load(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").where("o_orderdate is not null")
    month, status = F.month("o_orderdate"), F.col("o_orderstatus")
    priority = F.lpad(F.substring("o_orderpriority", 1, 1), 2, "0")
    columns = []
    for i in range(1, 13):
        here = month == i
        columns += [
            F.sum(F.when(here, F.when(status == "P", 0).otherwise(1))).alias(f"med_{i:02d}"),
            F.sum(F.when(here & (status == "P"), 1)).alias(f"chip_{i:02d}"),
            F.max(F.when(here, F.when(status == "F", "00").otherwise(priority))).alias(f"dual_{i:02d}"),
            F.max(F.when(here, F.concat(F.lit("0"), (F.dayofmonth("o_orderdate") % 10).cast("string"))))
            .alias(f"plan_{i:02d}"),
            F.max(F.when(here, (F.dayofmonth("o_orderdate") % 6).cast("string"))).alias(f"cov_{i:02d}"),
        ]
    return o.groupBy(F.col("o_custkey").alias("member_id"), F.year("o_orderdate").alias("year"), "o_orderpriority").agg(*columns)


def eligibility_columns() -> tuple[dict, dict]:
    def twelve(p: str) -> list[str]:
        return [f"{p}_{i:02d}" for i in range(1, 13)]

    return (
        {"medicaid_days": twelve("med"), "chip_days": twelve("chip")},
        {"dual_code": twelve("dual"), "plan_code": twelve("plan"), "chip_code": twelve("cov")},
    )


#: The same panel written as months times members and years left joined to orders.
PANEL_SQL = """months AS (SELECT unnest(range(1, 13)) AS month),
people AS (SELECT DISTINCT o_custkey AS member_id, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderdate IS NOT NULL),
panel AS (
  SELECT p.member_id, p.year, CAST(m.month AS INTEGER) AS month,
    CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderkey IS NOT NULL THEN 1 END) AS BIGINT) AS medicaid_days,
    CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS BIGINT) AS chip_days,
    max(CASE WHEN o_orderstatus = 'F' THEN '00' ELSE '0' || substr(o_orderpriority, 1, 1) END) AS dual_code,
    max('0' || CAST(day(o_orderdate) % 10 AS VARCHAR)) AS plan_code,
    max(CAST(day(o_orderdate) % 6 AS VARCHAR)) AS chip_code
  FROM people p CROSS JOIN months m
  LEFT JOIN orders ON o_custkey = p.member_id AND year(o_orderdate) = p.year AND month(o_orderdate) = m.month
  GROUP BY ALL)"""


def supplier_index(spark: SparkSession, d: str) -> DataFrame:
    """Supplier as the member of the acute-care queries, with an index month in 1..24."""
    s = load(spark, d, "supplier", "s_suppkey", "s_nationkey")
    return s.select(F.col("s_suppkey").alias("member_id"), (F.col("s_nationkey") % 24 + 1).alias("index_month"))


def intervals(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """Stays: supplier as member, ship date to ship date plus zero to four days."""
    raw = load(spark, d, "lineitem", *dict.fromkeys(["l_suppkey", "l_shipdate", "l_quantity", *extra]))
    start = F.to_date("l_shipdate")
    return raw.select(
        F.col("l_suppkey").alias("member_id"), start.alias("start_date"),
        F.date_add(start, (F.col("l_quantity") % 5).cast("int")).alias("end_date"), *extra,
    )


INTERVALS_SQL = """stays AS (
  SELECT l_suppkey AS member_id, CAST(l_shipdate AS DATE) AS start_date,
    CAST(l_shipdate AS DATE) + CAST(l_quantity % 5 AS INTEGER) AS end_date, lineitem.* FROM lineitem)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Scored set: label = quality, score = text length, class = longer than 1500, group = language."""
    lab = load(spark, d, "labels", "doc_id", "quality")
    doc = load(spark, d, "documents", "doc_id", "lang", "n_chars")
    return lab.join(doc, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.col("n_chars").alias("score"),
        (F.col("n_chars") > 1500).cast("int").alias("prediction"), F.col("lang").alias("grp"),
    )


SCORED_SQL = """scored AS (
  SELECT l.doc_id, quality AS label, n_chars AS score, CAST(n_chars > 1500 AS INTEGER) AS prediction, lang AS grp
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
