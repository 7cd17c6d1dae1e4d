"""Mixing sources to target weights by Poisson replication.

A document of source s is taken Poisson(r) times, r = weight * total / size of s, with size in
characters: then sources come out in proportion to their weights, and a document's count does not depend
on any other row. The count inverts the Poisson distribution at a number drawn by md5 from
seed and key, so retries and other partitionings repeat it. Copies are dealt out and ordered
by a second hash: a global shuffle whose partitions are even whatever the sources or ids are.

Sources without a weight of their own, and null sources, form one group with ``rest``. A group
without characters cannot meet a weight; its weight goes to the others and its documents are
not taken. The key is the id, or the text where the id is null; rows of equal key are drawn alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 52


def poisson_levels(mean: float) -> list[int]:
    """Cumulative probabilities times 2**BITS, as far as they are below 1."""
    if mean <= 0:
        return []
    levels, total, k = [], 0.0, 0
    while k <= mean + 40 * math.sqrt(mean) + 60:
        total += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
        level = math.floor(total * 2**BITS)
        if level >= 2**BITS:
            break
        levels.append(level)
        k += 1
    return levels


def rates(docs: DataFrame, weights: dict[str, float], rest: float, *, source: str = "source", text: str = "text", epochs: float = 1.0) -> dict[str | None, float]:
    """Mean number of copies for each weighted source, and under None for all others."""
    group = F.when(F.col(source).isin(*weights), F.col(source)) if weights else F.lit(None).cast("string")
    sizes = {r["g"]: r["n"] or 0 for r in docs.groupBy(group.alias("g")).agg(F.sum(F.length(text)).alias("n")).collect()}
    wanted = {g: w for g, w in {**weights, None: rest}.items() if sizes.get(g, 0) > 0}
    total, share = sum(sizes.values()) * epochs, sum(wanted.values())
    return {g: w / share * total / sizes[g] for g, w in wanted.items()} if share else {}


def number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def free_name(name: str, taken: set[str]) -> str:
    """``name``, with underscores behind it while it is among the lower-cased names ``taken``."""
    while name.lower() in taken:
        name += "_"
    return name


def mix(
    docs: DataFrame, weights: dict[str, float], rest: float, *, seed: str = "mix", epochs: float = 1.0,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", copy: str = "copy", place: str = "place",
) -> DataFrame:
    """The columns of ``docs``, the number of the copy from 1, and its place in the shuffled order (hex).

    A column of ``docs`` keeps its name: the new columns get underscores behind theirs until no column is called so.
    """
    taken = {c.lower() for c in docs.columns}
    copy = free_name(copy, taken)
    place = free_name(place, taken | {copy.lower()})
    found = rates(docs, weights, rest, source=source, text=text, epochs=epochs)
    levels = F.array(*map(F.lit, poisson_levels(found.get(None, 0.0)))).cast("array<bigint>")
    for name in weights:
        own = F.array(*map(F.lit, poisson_levels(found.get(name, 0.0)))).cast("array<bigint>")
        levels = F.when(F.col(source) == name, own).otherwise(levels)
    key = F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))
    draw = number(F.concat(F.lit(f"{seed}|"), key))
    # no levels: a rate of zero
    count = F.size(F.filter(levels, lambda x: x <= draw))
    copies = docs.withColumn(copy, F.explode(F.sequence(F.lit(0), count))).where(F.col(copy) > 0)
    placed = copies.withColumn(place, F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key, F.lit("|"), F.col(copy).cast("string"))), 1, 16))
    return placed.repartition(F.col(place)).sortWithinPartitions(place)
