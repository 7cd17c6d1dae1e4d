"""From raw documents to a mixed training corpus, one written table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlake.llm import decontaminate, lines, mixing, quality, simhash
from cohortlake.llm.mix_weights import REST, WEIGHTS
from cohortlake.llm.store import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees accept; labels of the held-out part are not learned from."""
    return quality.accepted(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; n_chars follows the text."""
    return lines.with_length(lines.deduplicate(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of fingerprints that link at two or fewer differing bits."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, or hardly any."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents, sources in proportion to their weights, in shuffled order."""
    return mixing.mix(docs, WEIGHTS, REST)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
]

#: The classifier and the fingerprints have no SQL form; tests compare run() with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
