"""The registered queries of the package, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlake.llm import (
    decontaminate, lines, merkle, mixing, negatives, neighbours, quality, search, simhash, store, substrings, toxicity, urls, warc,
)
from cohortlake.llm.mix_weights import REST, WEIGHTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op7_winnow_decontaminate")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query("op3_simhash_vantage_tree")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_recompression_substrings")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.deduplicate(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_boosted_tree_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_levenshtein_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


MIX_SQL = """
WITH target(g, w) AS (VALUES ('src0', 0.15::DOUBLE), ('src1', 0.10), ('src2', 0.10), ('src3', 0.05), ('', 0.60)),
grouped AS (
  SELECT *, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN source ELSE '' END AS g,
    coalesce(CAST(doc_id AS VARCHAR), text, '') AS key
  FROM documents),
sizes AS (SELECT g, sum(length(text))::DOUBLE AS n FROM grouped GROUP BY g HAVING sum(length(text)) > 0),
rates AS (
  SELECT g, w / sum(w) OVER () * sum(n) OVER () / n AS r FROM sizes JOIN target USING (g)),
steps AS (
  SELECT g, k, floor(sum(exp(-r + k * ln(r) - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) * 4503599627370496.0) AS level
  FROM rates, range(0, 200) t(k)),
drawn AS (SELECT *, CAST('0x' || substr(md5('mix|' || key), 1, 13) AS BIGINT) AS u FROM grouped)
SELECT doc_id, text, lang, source, n_chars, CAST(k + 1 AS INTEGER) AS copy,
  substr(md5('mix|' || key || '|' || (k + 1)), 1, 16) AS place
FROM drawn d JOIN steps s ON d.g = s.g AND s.level <= u AND s.level < 4503599627370496.0
"""


@query("op2_poisson_mixing", MIX_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), WEIGHTS, REST)


LINES_SQL = """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS w
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM split WHERE len(l) >= 3)),
later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS n FROM windows
    WHERE trim(replace(w, chr(10), '')) <> '')
  WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS line FROM later, range(0, 3) t(k)),
each_line AS (SELECT doc_id, unnest(l) AS line_text, generate_subscripts(l, 1) - 1 AS line FROM split),
rest AS (
  SELECT e.doc_id, string_agg(line_text, chr(10) ORDER BY line) AS text, count(*) AS n
  FROM each_line e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.line = g.line GROUP BY e.doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NOT NULL THEN coalesce(r.text, '') END AS text,
  CAST(coalesce(len(l), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(l), 0) - coalesce(r.n, 0) AS INTEGER) AS n_removed
FROM split s LEFT JOIN rest r ON s.doc_id = r.doc_id
"""


@query("op9_line_windows", LINES_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return lines.deduplicate(table(spark, folder, "documents").select("doc_id", "text"), counts=True)


@query("op1_warc_ranges")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write(table(spark, folder, "pages"), store.folder(spark, "warc"))
    return warc.read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


TOP_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id))
WHERE rank <= 20
"""


@query("op4_segment_top_k", TOP_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_path_templates", urls.sql())
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id))
WHERE rank <= 20
"""


@query("op11_block_matrix_neighbours", NEAREST_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


MINING_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


@query("op13_shared_list_negatives", MINING_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every seventh row are moved on by one first, as the contract says."""
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def without_breaks() -> dict[str, Column]:
    """Texts without line breaks where 2 divides the unsigned CRC-32 of the decimal id."""
    cut = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(cut, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


@query("op12_butterfly_merkle")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"), changed=without_breaks())


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
