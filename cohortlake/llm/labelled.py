"""Held-out marks and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in one part; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, rows: int) -> DataFrame:
    """(text, label) of about ``rows`` labelled documents, or all if fewer, none of them held out.

    Chosen by a hash of the id, so the same on every run; labels other than 0 and 1 are left out.
    The sampled ids are what is broadcast: no more than about ``rows``.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    known = known.where(~held_out("id", parts, part))
    total = known.count()
    some = known if total <= rows else known.where(F.xxhash64("id") < -(2**63) + 2**64 * rows // total)
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("text", "label")
