"""Crosswalks, pivoted counts, adherence, area rates, disease groups and assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import codes
from cohortlake.functions.recode import age_sex_cells
from cohortlake.operators import acute, assembly, features, joins, windows
from cohortlake.plans import claim_plans, views as v
from cohortlake.plans.acute_plans import ED_SQL, PLACES, PROCEDURES, REVENUE
from cohortlake.plans.registry import query
from cohortlake.session import materialize
from cohortlake.sources.tables import load

PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
UNLISTED_BRANDS = ["Brand#13", "Brand#21"]
PREFIX = 8


def _spine(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer", "c_custkey").withColumnRenamed("c_custkey", "member_id")


def member_lines(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Claim lines with their member; raw line columns kept by name."""
    raw = load(spark, d, "lineitem", *dict.fromkeys(["l_orderkey", *columns]))
    owner = load(spark, d, "orders", F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("member_id"))
    return raw.join(owner, "l_orderkey").drop("l_orderkey")


@query("crosswalk_exact", """
    SELECT l_orderkey AS claim_id, l_linenumber AS line_no, l_suppkey AS code, s_nationkey AS category
    FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 1000) ON l_suppkey = s_suppkey""")
def crosswalk_exact(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "lineitem", F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line_no"),
                  F.col("l_suppkey").alias("code"))
    listed = load(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").where(F.col("s_acctbal") > 1000)
    crosswalk = listed.select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("category"))
    return features.crosswalk_exact(events, crosswalk, "code", "category")


def in_pre(events: DataFrame, spark: SparkSession, d: str, date: str) -> DataFrame:
    """Events of the half-year after the index month; no feature may see what comes later."""
    inside = windows.prepost_window(events, claim_plans.windowed_members(spark, d), v.MEMBER, date, v.BASE_YEAR)
    return inside.where(F.col("pre") == 1).select(*events.columns)


LINE_COLUMNS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
CODE_AND_FILL = ["l_partkey", "l_quantity", "l_returnflag"]  # what diagnosis counts and adherence read of a line


def placed_lines(spark: SparkSession, d: str, columns: Sequence[str] = LINE_COLUMNS, index: DataFrame | None = None) -> DataFrame:
    """Claim lines with the member, type and date of their claim and the member's index month."""
    lines = load(spark, d, "lineitem", F.col("l_orderkey").alias("claim_id"), *columns, F.to_date("l_shipdate").alias("fill_date"))
    heads = v.headers(spark, d).select("claim_id", "member_id", "claim_type", "service_date")
    index = v.index_months(spark, d) if index is None else index
    return windows.indexed_lines(lines, heads, index, ["claim_id"], v.MEMBER, "index_month")


def pre_lines(spark: SparkSession, d: str, columns: Sequence[str] = LINE_COLUMNS, index: DataFrame | None = None) -> DataFrame:
    """Those lines whose claim or whose shipment is in the pre period, as a written table: several blocks
    read it, and the whole line table meets the claims once for all of them. Only listed columns cross the network."""
    inside = [windows.in_pre_months("index_month", date, v.BASE_YEAR) for date in ("service_date", "fill_date")]
    return materialize(placed_lines(spark, d, columns, index).where(inside[0] | inside[1]), "pre-lines")


def _in_pre_indexed(lines: DataFrame, date: str) -> DataFrame:
    return windows.prepost_indexed(lines, "index_month", date, v.BASE_YEAR).where(F.col("pre") == 1)


def _pre_sql(date: str) -> str:
    return f"{v.sql_months(date)} BETWEEN m + 1 AND m + 6"


def _part_codes(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_type")
    code = F.concat_ws("-", "p_brand", F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return p.select("p_partkey", code.alias("code"), "p_brand", "p_type")


def code_list(spark: SparkSession, d: str) -> DataFrame:
    """Category list that covers some codes whole, some by prefix only, and some brands not at all."""
    p = _part_codes(spark, d)
    return p.where((F.col("p_type") != "STANDARD") & (F.substring("code", -2, 2) > "25")
                   & ~F.col("p_brand").isin(UNLISTED_BRANDS)).select("code", F.col("p_type").alias("category"))


CODES_SQL = f"""part_codes AS (
  SELECT p_partkey, p_brand || '-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS code, p_brand, p_type, p_size FROM part),
code_list AS (
  SELECT code, max(p_type) AS category FROM part_codes
  WHERE p_type <> 'STANDARD' AND p_size > 25 AND p_brand NOT IN {v.sql_list(UNLISTED_BRANDS)} GROUP BY 1),
by_prefix AS (SELECT substr(code, 1, {PREFIX}) AS prefix, max(category) AS category FROM code_list GROUP BY 1),
resolved AS (
  SELECT c.code, coalesce(e.category, b.category) AS category
  FROM (SELECT DISTINCT code FROM part_codes) c LEFT JOIN code_list e USING (code)
  LEFT JOIN by_prefix b ON substr(c.code, 1, {PREFIX}) = b.prefix)"""


@query("crosswalk_prefix", f"""
    WITH {CODES_SQL}
    SELECT code, category, count(*) AS n FROM lineitem JOIN part_codes ON l_partkey = p_partkey JOIN resolved USING (code)
    GROUP BY 1, 2""")
def crosswalk_prefix(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem", F.col("l_partkey").alias("p_partkey"))
    # rows are counted per part before the part's code is looked up
    events = lines.groupBy("p_partkey").agg(F.count("*").alias("n")).join(
        _part_codes(spark, d).select("p_partkey", "code"), "p_partkey")
    placed = features.crosswalk_prefix(events, code_list(spark, d), "code", "category", PREFIX)
    return placed.groupBy("code", "category").agg(F.sum("n").alias("n"))


def _pre_codes(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """Member, claim date and code of the lines of the pre period."""
    lines = placed_lines(spark, d) if lines is None else lines
    inside = _in_pre_indexed(lines.where(F.col("claim_type").isin(v.CLAIM_TYPES)), "service_date")
    coded = inside.select("member_id", "service_date", F.col("l_partkey").alias("p_partkey"))
    return coded.join(_part_codes(spark, d).select("p_partkey", "code"), "p_partkey").select(
        "member_id", "service_date", "code")


def _count_columns_sql(values, prefix: str, source: str = "category", unmatched: bool = True) -> str:
    columns = [f"count(*) FILTER ({source} = '{x}') AS {prefix}{x}" for x in values]
    if unmatched:
        columns.append(f"count(*) FILTER ({source} IS NULL) AS {prefix}unmatched")
    return ", ".join(columns)


def _filled_sql(values, prefix: str, unmatched: bool = True) -> str:
    names = [f"{prefix}{x}" for x in values] + ([f"{prefix}unmatched"] if unmatched else [])
    return ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)


DX_SQL = f"""{CODES_SQL}, {claim_plans.CLAIMS_SQL},
dx_events AS (
  SELECT DISTINCT member_id, service_date, code FROM claims JOIN idx USING (member_id)
  JOIN part_codes ON l_partkey = p_partkey WHERE sm BETWEEN m + 1 AND m + 6),
dx AS (SELECT member_id, {_count_columns_sql(PART_TYPES, 'dx_')} FROM dx_events JOIN resolved USING (code) GROUP BY 1)"""


@query("dx_category_counts", f"""
    WITH {DX_SQL} SELECT c_custkey AS member_id, {_filled_sql(PART_TYPES, 'dx_')}
    FROM customer LEFT JOIN dx ON c_custkey = member_id""")
def dx_counts(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    return features.category_counts(
        _pre_codes(spark, d, lines), _spine(spark, d), code_list(spark, d), v.MEMBER, "service_date", "code", "category",
        PART_TYPES, PREFIX, "dx_")


@query("pivot_counts", f"""
    WITH {v.INDEX_SQL}, fills AS (
      SELECT DISTINCT o_custkey AS member_id, CAST(l_shipdate AS DATE) AS fill_date, l_partkey FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN idx ON o_custkey = member_id
      WHERE {_pre_sql('l_shipdate')} AND l_partkey IS NOT NULL),
    rx AS (SELECT member_id, {_count_columns_sql(PART_TYPES, 'rx_', 'p_type')} FROM fills
      LEFT JOIN (SELECT * FROM part WHERE p_size <= 45) ON l_partkey = p_partkey GROUP BY 1)
    SELECT c_custkey AS member_id, {_filled_sql(PART_TYPES, 'rx_')} FROM customer LEFT JOIN rx ON c_custkey = member_id""")
def rx_counts(spark: SparkSession, d: str) -> DataFrame:
    fills = member_lines(spark, d, "l_partkey", "l_shipdate").select(
        "member_id", F.to_date("l_shipdate").alias("fill_date"), F.col("l_partkey").alias("drug")).where("drug is not null")
    listed = load(spark, d, "part", F.col("p_partkey").alias("drug"), F.col("p_type").alias("drug_class"), "p_size")
    crosswalk = listed.where(F.col("p_size") <= 45).select("drug", "drug_class")
    placed = features.crosswalk_exact(in_pre(fills.distinct(), spark, d, "fill_date"), crosswalk, "drug", "drug_class")
    counts = features.pivot_wide(placed, v.MEMBER, "drug_class", PART_TYPES, "rx_")
    return joins.spine_fill(_spine(spark, d), counts, v.MEMBER)


PROCEDURE_SQL = f"""proc_events AS (
  SELECT DISTINCT o_custkey AS member_id, CAST(o_orderdate AS DATE) AS service_date, l_partkey FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN idx ON o_custkey = member_id
  WHERE l_returnflag <> 'R' AND NOT {ED_SQL} AND {_pre_sql('o_orderdate')}),
proc AS (SELECT member_id, {_count_columns_sql(PART_TYPES, 'pc_', 'p_type')} FROM proc_events
  LEFT JOIN (SELECT * FROM part WHERE p_size <= 45) ON l_partkey = p_partkey GROUP BY 1)"""


def outpatient_lines(spark: SparkSession, d: str, *columns: str, lines: DataFrame | None = None) -> DataFrame:
    """Distinct lines of outpatient claims of the pre period that are no emergency visit, with their claim's member and date."""
    raw = _in_pre_indexed(placed_lines(spark, d) if lines is None else lines, "service_date")
    emergency = acute.ed_visit(
        F.concat("l_returnflag", "l_linestatus"), F.col("l_linenumber"), F.col("l_quantity").cast("int"), REVENUE, PLACES, PROCEDURES)
    mine = raw.where((F.col("l_returnflag") != "R") & (emergency == 0))
    return mine.select("claim_id", "member_id", "service_date", *columns).distinct()


@query("proc_category_counts", f"""
    WITH {v.INDEX_SQL}, {PROCEDURE_SQL} SELECT c_custkey AS member_id, {_filled_sql(PART_TYPES, 'pc_')}
    FROM customer LEFT JOIN proc ON c_custkey = member_id""")
def proc_counts(spark: SparkSession, d: str) -> DataFrame:
    """Procedure categories of outpatient, non-emergency claims in the pre period."""
    coded = outpatient_lines(spark, d, "l_partkey").select("member_id", "service_date", F.col("l_partkey").alias("procedure"))
    listed = load(spark, d, "part", F.col("p_partkey").alias("procedure"), F.col("p_type").alias("category"), "p_size")
    crosswalk = listed.where(F.col("p_size") <= 45).select("procedure", "category")
    placed = features.crosswalk_exact(coded.distinct(), crosswalk, "procedure", "category")
    counts = features.pivot_wide(placed, v.MEMBER, "category", PART_TYPES, "pc_")
    return joins.spine_fill(_spine(spark, d), counts, v.MEMBER)


SPECIALTIES = ["B0", "B1", "B2", "S0", "S1", "S2", "S3", "S4"]
SPECIALTY_SQL = f"""spec_events AS (
  SELECT DISTINCT o_custkey AS member_id, CAST(o_orderdate AS DATE) AS service_date,
    coalesce(CASE WHEN l_linestatus = 'F' THEN 'S' || CAST(l_suppkey % 5 AS VARCHAR) END,
      CASE WHEN l_returnflag <> 'A' THEN 'B' || CAST(l_partkey % 3 AS VARCHAR) END) AS specialty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN idx ON o_custkey = member_id
  WHERE l_returnflag <> 'R' AND NOT {ED_SQL} AND {_pre_sql('o_orderdate')}),
spec AS (SELECT member_id, {_count_columns_sql(SPECIALTIES, 'sp_', 'specialty', False)} FROM spec_events
  WHERE specialty IS NOT NULL GROUP BY 1)"""


@query("provider_coalesce", f"""
    WITH {v.INDEX_SQL}, {SPECIALTY_SQL} SELECT c_custkey AS member_id, {_filled_sql(SPECIALTIES, 'sp_', False)}
    FROM customer LEFT JOIN spec ON c_custkey = member_id""")
def provider_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.provider_counts(
        _specialists(spark, d), _spine(spark, d), v.MEMBER, "service_date", "service", "billing", SPECIALTIES, "sp_")


def _specialists(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    raw = outpatient_lines(spark, d, "l_linestatus", "l_returnflag", "l_suppkey", "l_partkey", lines=lines)
    return raw.select(
        "member_id", "service_date",
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string"))).alias("service"),
        F.when(F.col("l_returnflag") != "A", F.concat(F.lit("B"), (F.col("l_partkey") % 3).cast("string"))).alias("billing"),
    )


RX_SQL = f"""per_drug AS (
  SELECT o_custkey AS member_id, l_partkey, count(*) AS fills, min(CAST(l_shipdate AS DATE)) AS first_fill,
    max(CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER)) AS supply_end, sum(CAST(l_quantity AS INTEGER)) AS supplied,
    count(*) FILTER (l_returnflag = 'A') AS generic
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN idx ON o_custkey = member_id WHERE {_pre_sql('l_shipdate')}
  GROUP BY 1, 2),
rx_member AS (
  SELECT member_id, CAST(sum(fills) AS BIGINT) AS number_of_fills, count(*) AS number_of_unique_med,
    round(sum(generic) / sum(fills), 4) AS percent_generic,
    round(sum(supplied) / nullif(sum(supply_end - first_fill), 0), 4) AS percent_med_adherence FROM per_drug GROUP BY 1)"""


@query("rx_adherence", f"""
    WITH {v.INDEX_SQL}, {RX_SQL} SELECT c_custkey AS member_id, coalesce(number_of_fills, 0) AS number_of_fills,
      coalesce(number_of_unique_med, 0) AS number_of_unique_med, coalesce(percent_generic, 0) AS percent_generic,
      coalesce(percent_med_adherence, 0) AS percent_med_adherence
    FROM customer LEFT JOIN rx_member ON c_custkey = member_id""")
def rx_adherence(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    block = features.rx_adherence(_fills(spark, d, lines), v.MEMBER, "drug", "fill_date", "days", "generic")
    return joins.spine_fill(_spine(spark, d), block, v.MEMBER)


def _fills(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """Drug fills of the pre period: lines by their ship date."""
    inside = _in_pre_indexed(placed_lines(spark, d) if lines is None else lines, "fill_date")
    return inside.select(
        "member_id", F.col("l_partkey").alias("drug"), "fill_date",
        F.col("l_quantity").cast("int").alias("days"), (F.col("l_returnflag") == "A").cast("int").alias("generic"))


# --- area rates and imputation ------------------------------------------------

RATES_SQL = """rates AS (
  SELECT n_nationkey AS county, n_regionkey AS area,
    avg(s_acctbal) FILTER (s_acctbal > 5000) AS rich_rate, avg(s_acctbal) FILTER (s_acctbal < 1000) AS poor_rate,
    avg(s_acctbal) FILTER (s_acctbal < 0) AS debt_rate
  FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


def area_rates(spark: SparkSession, d: str) -> DataFrame:
    """County rates with gaps: averages over subsets of suppliers."""
    s = load(spark, d, "supplier", "s_nationkey", "s_acctbal")
    balance = F.col("s_acctbal")
    stats = s.groupBy(F.col("s_nationkey").alias("county")).agg(
        F.avg(F.when(balance > 5000, balance)).alias("rich_rate"),
        F.avg(F.when(balance < 1000, balance)).alias("poor_rate"),
        F.avg(F.when(balance < 0, balance)).alias("debt_rate"))
    n = load(spark, d, "nation", F.col("n_nationkey").alias("county"), F.col("n_regionkey").alias("area"))
    return n.join(stats, "county", "left")


@query("area_features", f"""
    WITH {RATES_SQL} SELECT county, area, round(rich_rate, 4) AS rich_rate,
      round(rich_rate + poor_rate + debt_rate, 4) AS combined_rate FROM rates""")
def area_features(spark: SparkSession, d: str) -> DataFrame:
    combined = features.area_features(
        area_rates(spark, d), ["county", "area", "rich_rate"], {"combined_rate": ["rich_rate", "poor_rate", "debt_rate"]})
    return combined.withColumns({c: F.round(c, 4) for c in ("rich_rate", "combined_rate")})


_IMPUTED = ["rich_rate", "poor_rate", "debt_rate"]


@query("impute_group_mean", f"""
    WITH {RATES_SQL}, placed AS (
      SELECT c_custkey AS member_id, c_mktsegment || '-' || CAST(area AS VARCHAR) AS grp, rich_rate, poor_rate, debt_rate
      FROM customer JOIN rates ON c_nationkey = county),
    first_fill AS (SELECT member_id, grp, """ + ", ".join(
    f"coalesce({c}, avg({c}) OVER (PARTITION BY grp)) AS {c}" for c in _IMPUTED) + """ FROM placed)
    SELECT member_id, grp, """ + ", ".join(f"round(coalesce({c}, avg({c}) OVER ()), 4) AS {c}" for c in _IMPUTED) + """
    FROM first_fill""")
def impute(spark: SparkSession, d: str) -> DataFrame:
    people = load(spark, d, "customer", F.col("c_custkey").alias("member_id"), F.col("c_nationkey").alias("county"), "c_mktsegment")
    placed = people.join(area_rates(spark, d), "county").select(
        "member_id", F.concat_ws("-", "c_mktsegment", F.col("area").cast("string")).alias("grp"), *_IMPUTED)
    filled = features.impute_group_mean(placed, "grp", _IMPUTED)
    return filled.withColumns({c: F.round(c, 4) for c in _IMPUTED})


# --- disease groups -----------------------------------------------------------


def _group_list(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    """Code list: every part, one group each, names padded with blanks as in the source lists."""
    p = load(spark, d, "part", "p_partkey", "p_size")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_size") % len(names) + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("code"), F.concat(F.lit(" "), name, F.lit(" ")).alias("disease_group"))


def _indicators(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    events = member_lines(spark, d, "l_partkey").withColumnRenamed("l_partkey", "code")
    return features.group_indicators(events, _group_list(spark, d, names), v.MEMBER, "code", "disease_group", names)


def _indicator_sql(name: str, names: list[str]) -> str:
    columns = ", ".join(f'CAST(max(CASE WHEN p_size % {len(names)} = {i} THEN 1 ELSE 0 END) AS INTEGER) AS "{n}"'
                        for i, n in enumerate(names))
    return f"""{name} AS (SELECT o_custkey AS member_id, {columns} FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


DISEASE_SQL = _indicator_sql("disease", codes.DISEASE_GROUPS)
DRUG_SQL = _indicator_sql("drug", codes.DRUG_GROUPS)


@query("cdps_groups", f"WITH {DISEASE_SQL} SELECT * FROM disease")
def cdps_groups(spark: SparkSession, d: str) -> DataFrame:
    return _indicators(spark, d, codes.DISEASE_GROUPS)


def _cells_sql() -> str:
    parts = []
    for name, low, high, male in codes.AGE_SEX_CELLS:
        tests = [f"floor(age) BETWEEN {low if low is not None else -1000} AND {high if high is not None else 1000}"]
        if male is not None:
            tests.append(f"sex = '{'male' if male else 'female'}'")
        parts.append(f"CASE WHEN {' AND '.join(tests)} THEN 1 ELSE 0 END AS {name}")
    return ", ".join(parts)


@query("age_sex_cells", f"WITH {v.MEMBERS_SQL} SELECT member_id, {_cells_sql()} FROM members")
def cells(spark: SparkSession, d: str) -> DataFrame:
    male = F.when(F.col("sex") == "male", 1).when(F.col("sex") == "female", 0)
    return v.members(spark, d).select("member_id", *age_sex_cells(F.col("age"), male))


def _rules_sql() -> str:
    names = [*codes.DISEASE_GROUPS, *codes.DRUG_GROUPS]
    filled = ", ".join(f'coalesce("{n}", 0) AS "{n}"' for n in names)
    step = f"""SELECT m.member_id, coalesce(CAST(floor(age) AS INTEGER), 0) AS age, {filled} FROM members m
      LEFT JOIN disease USING (member_id) LEFT JOIN drug USING (member_id)"""
    ctes = [f"r0 AS ({step})"]
    for i, (target, value, condition) in enumerate(codes.GROUP_RULES):
        ctes.append(f"r{i + 1} AS (SELECT * REPLACE (CASE WHEN {condition} THEN {value} ELSE {target} END AS {target}) FROM r{i})")
    return f"WITH {v.MEMBERS_SQL}, {DISEASE_SQL}, {DRUG_SQL}, {', '.join(ctes)} SELECT * FROM r{len(codes.GROUP_RULES)}"


@query("hierarchy_rules", _rules_sql())
def hierarchy_rules(spark: SparkSession, d: str) -> DataFrame:
    people = v.members(spark, d).select("member_id", F.floor("age").cast("int").alias("age"))
    drugs = _indicators(spark, d, codes.DRUG_GROUPS)
    joined = joins.assemble(people, [cdps_groups(spark, d), drugs], v.MEMBER).na.fill(0)
    return features.apply_rules(joined)


@query("spine_fill", """
    SELECT c_custkey AS member_id, count(o_orderkey) AS orders, count(o_orderkey) FILTER (o_orderstatus = 'F') AS finished
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def spine_fill(spark: SparkSession, d: str) -> DataFrame:
    block = load(spark, d, "orders", "o_custkey", "o_orderstatus").groupBy(F.col("o_custkey").alias("member_id")).agg(
        F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    return joins.spine_fill(_spine(spark, d), block, v.MEMBER)


@query("assemble_features", f"""
    WITH {v.MEMBERS_SQL}, {DX_SQL}, {RX_SQL}, {SPECIALTY_SQL}
    SELECT m.member_id, m.state, m.age_cat, {_filled_sql(PART_TYPES, 'dx_')}, {_filled_sql(SPECIALTIES, 'sp_', False)},
      coalesce(number_of_fills, 0) AS number_of_fills, coalesce(number_of_unique_med, 0) AS number_of_unique_med,
      coalesce(percent_generic, 0) AS percent_generic, coalesce(percent_med_adherence, 0) AS percent_med_adherence
    FROM members m LEFT JOIN dx USING (member_id) LEFT JOIN rx_member USING (member_id) LEFT JOIN spec USING (member_id)""")
def assemble(spark: SparkSession, d: str) -> DataFrame:
    """Three blocks as tall rows that one aggregate per member sums."""
    people, lines = v.members(spark, d).select("member_id", "state", "age_cat"), pre_lines(spark, d)
    codes_placed = features.category_events(
        _pre_codes(spark, d, lines), code_list(spark, d), v.MEMBER, "service_date", "code", "category", PREFIX)
    seen = features.provider_events(_specialists(spark, d, lines), v.MEMBER, "service_date", "service", "billing")
    drugs = features.drug_totals(_fills(spark, d, lines), v.MEMBER, "drug", "fill_date", "days", "generic")
    totals = {c: c for c in features.DRUG_TOTALS} | {"number_of_unique_med": F.lit(1)}
    blocks = [
        assembly.counted(codes_placed, v.MEMBER, "category", PART_TYPES, "dx_"),
        assembly.counted(seen, v.MEMBER, "specialty", SPECIALTIES, "sp_", None),
        assembly.summed(drugs, v.MEMBER, totals),
    ]
    joined = assembly.assemble(people, blocks, v.MEMBER, features.adherence_shares())
    return joined.withColumnRenamed("fills", "number_of_fills").drop("generic", "supplied", "span")


DRUG_CLASSES = "p_brand || ' ' || p_type || ' ' || p_size"


@query("sparse_category_counts", f"""
    WITH {v.INDEX_SQL}, listed AS (
      SELECT p_partkey, CASE WHEN p_size <= 45 THEN {DRUG_CLASSES} END AS drug_class FROM part),
    slots AS (
      SELECT drug_class, CAST(row_number() OVER (ORDER BY drug_class) - 1 AS INTEGER) AS slot
      FROM (SELECT DISTINCT drug_class FROM listed WHERE drug_class IS NOT NULL)
      UNION ALL SELECT 'unmatched', CAST(count(DISTINCT drug_class) AS INTEGER) FROM listed),
    cells AS (
      SELECT member_id, slot, count(*) AS n FROM (
        SELECT DISTINCT o_custkey AS member_id, CAST(l_shipdate AS DATE) AS fill_date, l_partkey FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN idx ON o_custkey = member_id
        WHERE {_pre_sql('l_shipdate')} AND l_partkey IS NOT NULL)
      LEFT JOIN listed ON l_partkey = p_partkey JOIN slots ON coalesce(listed.drug_class, 'unmatched') = slots.drug_class
      GROUP BY 1, 2)
    SELECT c_custkey AS member_id, CAST(count(slot) AS INTEGER) AS n_categories, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_events,
      coalesce(string_agg(slot || ':' || n, ' ' ORDER BY slot), '') AS counts
    FROM customer LEFT JOIN cells ON c_custkey = member_id GROUP BY 1""")
def sparse_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts over all classes of the drug list, one sparse row a member, written as slot:count."""
    fills = _fills(spark, d).where("drug is not null").select("member_id", "drug", "fill_date").distinct()
    listed = load(spark, d, "part", "p_partkey", "p_size", "p_brand", "p_type").where("p_size <= 45").select(
        F.col("p_partkey").alias("drug"), F.expr(DRUG_CLASSES).alias("drug_class"))
    placed = features.crosswalk_exact(fills, listed, "drug", "drug_class")
    block = assembly.sparse_counts(placed, v.MEMBER, "drug_class", assembly.category_index(listed, "drug_class"))
    joined = _spine(spark, d).join(block, v.MEMBER, "left")
    entry = lambda x: F.concat_ws(":", x["slot"].cast("string"), x["n"].cast("string"))
    return joined.select(
        "member_id", F.coalesce(F.size("counts"), F.lit(0)).alias("n_categories"),
        F.coalesce(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]), F.lit(0).cast("bigint")).alias("n_events"),
        F.coalesce(F.array_join(F.transform("counts", entry), " "), F.lit("")).alias("counts"))


@query("assemble_inner", """
    SELECT c_custkey AS member_id, orders, finished, supplied FROM customer
    JOIN (SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1) a
      ON a.o_custkey = c_custkey
    JOIN (SELECT o_custkey, CAST(sum(l_quantity) AS BIGINT) AS supplied FROM orders JOIN lineitem ON l_orderkey = o_orderkey
      GROUP BY 1) b ON b.o_custkey = c_custkey""")
def assemble_inner(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders", "o_custkey", "o_orderstatus").groupBy(F.col("o_custkey").alias("member_id")).agg(
        F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    supplied = member_lines(spark, d, "l_quantity").groupBy("member_id").agg(
        F.sum("l_quantity").cast("long").alias("supplied"))
    return joins.assemble_inner([_spine(spark, d), orders, supplied], v.MEMBER)
