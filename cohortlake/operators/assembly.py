"""Sparse category counts, and feature blocks put together by one aggregate per member.

A block here is tall: one narrow row (keys, position of a feature, value) for each thing that
adds to a feature. Blocks in this form are stacked and summed together, so that however many
there are, their rows cross the network once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cohortlake.operators.features import UNMATCHED
from cohortlake.operators.joins import apart

SLOT, VALUE = "__slot", "__value"


class Block(NamedTuple):
    """Tall rows (keys, position in ``names``, value) and the type of the totals."""

    rows: DataFrame
    names: tuple[str, ...]
    kind: str


def counted(events: DataFrame, keys: Sequence[str], category: str, values: Sequence[str], prefix: str = "",
            unmatched: str | None = UNMATCHED) -> Block:
    """Events per listed category; rows without one under ``unmatched``, other categories nowhere."""
    place = F.array_position(F.lit(list(values)), F.col(category)) - 1
    if unmatched:
        place = F.coalesce(place, F.lit(len(values)).cast("bigint"))
    rows = events.select(*keys, place.cast("int").alias(SLOT), F.lit(1.0).alias(VALUE)).where(F.col(SLOT) >= 0)
    return Block(rows, tuple(f"{prefix}{x}" for x in [*values, *([unmatched] if unmatched else [])]), "bigint")


def summed(rows: DataFrame, keys: Sequence[str], totals: Mapping[str, Column | str], kind: str = "bigint") -> Block:
    """Totals by name; what a row adds to each is an expression, and null adds nothing.

    Values travel as doubles: integers are exact up to 2**53.
    """
    parts = [F.struct(F.lit(i).alias(SLOT), (F.col(x) if isinstance(x, str) else x).cast("double").alias(VALUE))
             for i, x in enumerate(totals.values())]
    return Block(rows.select(*keys, F.inline(F.array(*parts))).where(F.col(VALUE).isNotNull()), tuple(totals), kind)


def assemble(spine: DataFrame, blocks: Sequence[Block], keys: Sequence[str],
             derived: Mapping[str, Column] | None = None, fill: float | None = 0) -> DataFrame:
    """The spine with every block's totals, then ``derived`` columns computed from them.

    One combined aggregate sums the stacked rows of all blocks, map-side first, and meets the
    spine in the partitioning it leaves. Rows with a null key meet no spine row, as in a join.
    """
    names = [n for b in blocks for n in b.names]
    if len(set(names)) < len(names) or set(names) & set(spine.columns):
        raise ValueError("two features of one name")
    stacked, sums, start = [], [], 0
    for b in blocks:
        stacked.append(b.rows.select(*keys, (F.col(SLOT) + start).alias(SLOT), VALUE))
        sums += [F.sum(F.when(F.col(SLOT) == start + i, F.col(VALUE))).cast(b.kind).alias(n) for i, n in enumerate(b.names)]
        start += len(b.names)
    totals = reduce(DataFrame.unionAll, stacked).groupBy(*keys).agg(*sums)
    for name, value in (derived or {}).items():
        totals = totals.withColumn(name, value)
    joined = spine.join(totals, list(keys), "left")
    return joined if fill is None else joined.na.fill(fill, subset=[*names, *(derived or {})])


def category_index(crosswalk: DataFrame, category: str, unmatched: str | None = UNMATCHED) -> DataFrame:
    """(category, slot): the sorted categories of a crosswalk from 0, then ``unmatched``."""
    listed = F.array_sort(F.collect_set(F.col(category)))
    if unmatched:
        listed = F.concat(F.array_remove(listed, unmatched), F.array(F.lit(unmatched)))
    return crosswalk.agg(listed.alias("__all")).select(F.posexplode("__all").alias("slot", category))


def sparse_counts(events: DataFrame, keys: Sequence[str], category: str, index: DataFrame, name: str = "counts",
                  unmatched: str | None = UNMATCHED) -> DataFrame:
    """Keys and an ascending array of (slot, n), with as many entries as the member has categories.

    Events are first counted by member and category, map-side, so a member's array is made from one
    row per category however many events there are. Categories that the index lacks take no part; rows
    without one count as ``unmatched``.
    """
    named = F.coalesce(F.col(category), F.lit(unmatched)) if unmatched else F.col(category)
    cells = events.groupBy(*keys, named.alias(category)).agg(F.count("*").alias("n"))
    placed = cells.join(apart(index), category)
    return placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "n"))).alias(name))


def sparse_vector(counts: str, categories: Sequence[str], name: str, prefix: str = "") -> Column:
    """An array of (slot, n) as a sparse vector that learners and the encoder take; null gives no entries.

    ``categories`` are the index's, in its order; they become the attribute names. The vector is read from
    its stored form by the JSON reader, so no Python worker is started.
    """
    entries = F.coalesce(F.col(counts), F.expr("cast(array() as array<struct<slot:int,n:bigint>>)"))
    stored = F.struct(
        F.lit(0).alias("type"), F.lit(len(categories)).alias("size"), F.transform(entries, lambda x: x["slot"]).alias("indices"),
        F.transform(entries, lambda x: x["n"].cast("double")).alias("values"),
    )
    vector = F.from_json(F.to_json(F.struct(stored.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"]
    attributes = [{"idx": i, "name": f"{prefix}{c}"} for i, c in enumerate(categories)]
    return vector.alias(name, metadata={"ml_attr": {"attrs": {"numeric": attributes}, "num_attrs": len(categories)}})
