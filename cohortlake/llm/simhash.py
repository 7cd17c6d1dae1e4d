"""Near-duplicates by SimHash, linked through a vantage-point tree over the fingerprints.

Fingerprint: over the shingles of ``shingle`` space-joined words of the text (A-Z lower-cased,
words split at ASCII white space, repeats included; fewer words: the whole sequence), a bit
is 1 if it is set in over half of the XXH64 hashes (seed 42). Texts that are null or without
words have fingerprint zero. Two fingerprints link at ``distance`` or fewer differing bits;
a component is everything reachable over links, named by its smallest doc_id.

Equal fingerprints are one node, so copies are never compared. The tree is fitted on about
``sample`` fingerprints, or all if fewer, chosen by hash. A node sends the fingerprints within its radius,
and those that the triangle bound lets come within ``distance`` of one there, to its inner branch and those
beyond the radius to its outer branch: two linked fingerprints reach a common leaf. A leaf
whose share of the sample is large is cut into blocks, and each pair of blocks is a shard of
its own. Beyond ``leaves`` times ``leaf`` fingerprints the sample can tell no more leaves apart and shards grow with
the table; a task then splits its shard by a tree of its own, so that work goes with its rows times ``leaf``. Shards return their groups of connected fingerprints, each member paired with the smallest one,
never all pairs.

Rows without doc_id get a fingerprint, and the component of an equal fingerprint of a row with
an id, if any; they link nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.components import connected
from cohortlake.llm.store import drop, stage
from cohortlake.llm.words import binary_texts

SHINGLE, DISTANCE, SAMPLE, LEAF, LEAVES = 3, 2, 1 << 16, 1000, 1 << 14


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit number."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n - shingle + 1
        )
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed number."""

    def scan(batches):
        for batch in batches:
            values = [fingerprint(t, shingle) for t in binary_texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, fp bigint")


class Tree:
    """A vantage-point tree as arrays; a child below zero is leaf -child - 1."""

    def __init__(self, sample: np.ndarray, total: int, distance: int, leaf: int, leaves: int):
        self.distance = distance
        self.point, self.radius, self.inner, self.outer, self.blocks = [], [], [], [], []
        self.scale = max(total / max(len(sample), 1), 1.0)
        self.leaf = max(leaf, total // leaves)
        self._grow(sample)

    def _grow(self, points: np.ndarray) -> int:
        todo = [(points, None)]
        root = None
        while todo:
            points, where = todo.pop()
            split = self._split(points) if len(points) * self.scale > self.leaf and len(points) >= 8 else None
            if split is None:
                size = len(points) * self.scale
                self.blocks.append(max(1, round(size / (4 * self.leaf))) if size > 4 * self.leaf else 1)
                name = -len(self.blocks)
            else:
                name = len(self.point)
                vantage, radius, away = split
                self.point.append(vantage)
                self.radius.append(radius)
                self.inner.append(0)
                self.outer.append(0)
                todo.append((points[away <= radius + self.distance], (self.inner, name)))
                todo.append((points[away > radius], (self.outer, name)))
            if where is None:
                root = name
            else:
                where[0][where[1]] = name
        self.root = root
        return root

    def _split(self, points: np.ndarray):
        """The vantage point, of a few, and radius that leave the least to compare; none if no split helps."""
        best, least = None, 0.85 * len(points) ** 2
        for vantage in points[:: max(1, len(points) // 8)][:8]:
            away = np.bitwise_count(points ^ vantage)
            below = np.cumsum(np.bincount(away, minlength=65 + self.distance))
            for radius in range(64):
                inside, outside = int(below[radius + self.distance]), len(points) - int(below[radius])
                work = inside**2 + outside**2
                if outside and work < least:
                    best, least = (vantage, radius, away), work
        return best

    def shards(self, fps: np.ndarray):
        """(position, shard) for every shard that a fingerprint belongs to."""
        at, shard = [], []
        todo = [(self.root, np.arange(len(fps)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node >= 0:
                away = np.bitwise_count(fps[rows] ^ self.point[node])
                todo.append((self.inner[node], rows[away <= self.radius[node] + self.distance]))
                todo.append((self.outer[node], rows[away > self.radius[node]]))
                continue
            leaf = -node - 1
            blocks = self.blocks[leaf]
            own = (fps[rows] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
            for other in range(blocks):
                pair = np.minimum(own, other) * blocks + np.maximum(own, other)
                at.append(rows)
                shard.append((np.int64(leaf) << 32) + pair)
        return np.concatenate(at or [np.empty(0, np.int64)]), np.concatenate(shard or [np.empty(0, np.int64)])


def groups(fps: np.ndarray, distance: int) -> list[np.ndarray]:
    """Positions of the fingerprints that links connect, a list for each group of two or more."""
    n, step = len(fps), max(1, (1 << 21) // max(len(fps), 1))
    some = np.zeros(n, bool)
    for low in range(0, n, step):
        near = np.bitwise_count(fps[low : low + step, None] ^ fps[None, :]) <= distance
        some[low : low + step] = near.sum(axis=1) > 1
    rest, found = np.flatnonzero(some), []
    while len(rest):
        front, rest, members = rest[:1], rest[1:], [rest[:1]]
        while len(front) and len(rest):
            now, front = front[:step], front[step:]
            hit = (np.bitwise_count(fps[now][:, None] ^ fps[rest][None, :]) <= distance).any(axis=0)
            members.append(rest[hit])
            front, rest = np.concatenate((front, rest[hit])), rest[~hit]
        found.append(np.concatenate(members))
    return found


def pieces(fps: np.ndarray, distance: int, leaf: int) -> list[np.ndarray]:
    """Positions in sets of about ``leaf`` such that two linked fingerprints share a set: a tree of the shard's own."""
    if len(fps) <= 4 * leaf:
        return [np.arange(len(fps))]
    order = np.argsort(fps)
    tree = Tree(fps[order[:: -(-len(fps) // SAMPLE)]], len(fps), distance, leaf, len(fps))
    at, shard = tree.shards(fps)
    by = np.argsort(shard, kind="stable")
    return np.split(at[by], np.flatnonzero(np.diff(shard[by])) + 1)


def links(nodes: DataFrame, *, distance: int = DISTANCE, sample: int = SAMPLE, leaf: int = LEAF, leaves: int = LEAVES) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) that connect exactly what links of ``distance`` or fewer bits connect."""
    total = nodes.count()
    some = nodes if total <= sample else nodes.where(F.xxhash64("fp") < -(2**63) + 2**64 * sample // total)
    chosen = some.select("fp").toPandas()["fp"].to_numpy(np.int64)
    chosen = np.sort(chosen.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
    tree = Tree(chosen, total, distance, leaf, leaves)
    parts = {k: (np.array(v) if isinstance(v, list) and k != "blocks" else v) for k, v in vars(tree).items()}
    shared = nodes.sparkSession.sparkContext.broadcast(parts)

    def route(batches):
        tree = Tree.__new__(Tree)
        tree.__dict__.update(shared.value)
        for batch in batches:
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            at, shard = tree.shards(fps)
            rows = pa.Table.from_batches([batch]).take(pa.array(at)).append_column("shard", pa.array(shard))
            yield from rows.to_batches()

    def connect(rows: pd.DataFrame) -> pd.DataFrame:
        node, fps = rows["node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        found = [np.sort(node[at[x]]) for at in pieces(fps, distance, leaf) for x in groups(fps[at], distance)]
        return pd.DataFrame({
            "a": np.concatenate([np.repeat(x[:1], len(x) - 1) for x in found] or [node[:0]]),
            "b": np.concatenate([x[1:] for x in found] or [node[:0]]),
        })

    routed = nodes.select("node", "fp").mapInArrow(route, "node bigint, fp bigint, shard bigint")
    return routed.groupBy("shard").applyInPandas(connect, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE,
    sample: int = SAMPLE, leaf: int = LEAF, leaves: int = LEAVES,
) -> DataFrame:
    """One row per document: doc_id, fp, component_id. Other columns of ``docs`` are not read."""
    prints = stage(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    nodes = stage(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")).select("node", "fp"), "nodes")
    found = connected(links(nodes, distance=distance, sample=sample, leaf=leaf, leaves=leaves))
    names = stage(
        nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "names"
    )
    drop(nodes)
    return prints.join(names, "fp", "left").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, the one with the smallest id; columns as they are.

    Of several rows with that id the one whose text, then whose columns as JSON, come first stays. Rows without id stay.
    """
    groups = stage(near_duplicates(docs, doc_id=doc_id, text=text, **options), "groups")
    gone = stage(groups.where("doc_id > component_id").select(F.col("doc_id").alias("__id")).distinct(), "gone")
    # by shuffle at every size: no plan that a growing table of ids would change
    kept = docs.join(gone.hint("merge"), F.col(doc_id) == F.col("__id"), "left_anti")
    many = stage(groups.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).count().where("count > 1").select("__id"), "many")
    if many.isEmpty():
        return kept
    order = [F.col(text).asc_nulls_first(), F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).asc()]
    place = F.row_number().over(Window.partitionBy(doc_id).orderBy(*order))
    several = kept.join(many, F.col(doc_id) == F.col("__id"), "left_semi").withColumn("__n", place).where("`__n` = 1").drop("__n")
    return kept.join(many, F.col(doc_id) == F.col("__id"), "left_anti").unionByName(several)
