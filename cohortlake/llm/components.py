"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.store import drop, stage

MAX_ROUNDS = 64


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the least node it is linked to.

    Links are taken both ways; repeated links, links to oneself and null ends change nothing.
    Each round hangs every node's larger neighbours, then its smaller ones, on the least
    neighbour, until all links point to the least node. Minima are written before they are
    joined back: both sides of the join are then plain scans, whose hot keys adaptive execution splits.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    )
    edges, mark = _stage(edges)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        larger = _large_star(edges)
        after, now = _stage(_small_star(larger))
        drop(edges, larger)
        edges, mark, before = after, now, mark
        if now == before:
            break
    else:
        raise RuntimeError("links did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )


def _stage(edges: DataFrame) -> tuple[DataFrame, tuple]:
    staged = stage(edges.distinct(), "links")
    row = staged.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    ).first()
    return staged, tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
    least = stage(both.groupBy("x").agg(F.least("x", F.min("y")).alias("m")), "least")
    hung = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    out = stage(hung.distinct(), "links")
    drop(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    hung = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v")))
