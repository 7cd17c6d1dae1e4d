"""Join shapes used across feature building."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apart(df: DataFrame) -> DataFrame:
    """Give a small aggregated table a shuffle of its own before a join.

    The skew-join rule splits a hot key only between plain exchanges. A side that was just
    aggregated on the join key is already partitioned by it and would get none.
    """
    return df.hint("rebalance")


def header_lines(headers: DataFrame, lines: DataFrame, keys: Sequence[str], type_column: str,
                 kept_types: Sequence[str]) -> DataFrame:
    """Claim header to claim line inner join on the claim key.

    The type filter is applied to the headers before the join. Month belongs in
    ``keys`` when both sides carry it.
    """
    return headers.where(F.col(type_column).isin(list(kept_types))).join(lines, list(keys), "inner")


def restrict_to(df: DataFrame, cohort: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in the cohort; never multiplies rows."""
    return df.join(cohort.select(*keys), list(keys), "left_semi")


def enrich(df: DataFrame, other: DataFrame, keys: Sequence[str], indicator: str | None = None) -> DataFrame:
    """Left join that keeps every row, with an optional 0/1 match column."""
    right = other.withColumn(indicator, F.lit(1)) if indicator else other
    joined = df.join(right, list(keys), "left")
    return joined.na.fill(0, subset=[indicator]) if indicator else joined


def spine_fill(spine: DataFrame, block: DataFrame, keys: Sequence[str], value: float = 0) -> DataFrame:
    """Every member once, with the block's numeric columns filled where it has no row."""
    filled = [c for c in block.columns if c not in keys]
    return spine.join(block, list(keys), "left").na.fill(value, subset=filled)


def assemble(spine: DataFrame, blocks: Sequence[DataFrame], keys: Sequence[str], fill: float | None = 0) -> DataFrame:
    """Left-join feature blocks to the spine.

    All joins share the member key: every block is already partitioned by it, so each
    join reuses the partitioning of its inputs.
    """
    joined = reduce(lambda left, right: left.join(right, list(keys), "left"), blocks, spine)
    if fill is None:
        return joined
    names = [c for b in blocks for c in b.columns if c not in keys]
    return joined.na.fill(fill, subset=names)


def assemble_inner(blocks: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join of blocks on the member key."""
    return reduce(lambda left, right: left.join(right, list(keys), "inner"), blocks)


def union_sources(frames: Mapping[str, DataFrame], columns: Sequence[str], tag: str = "source") -> DataFrame:
    """UNION ALL by name of several sources with a source column."""
    tagged = [df.select(*columns).withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, tagged)
