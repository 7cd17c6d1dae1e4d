"""Hard negatives for contrastive training: anchor clusters that share candidate lists, walked to certified termination.

Components become floor(scale * x) and scores are integer inner products; a higher score comes first, ties by smaller id.
An anchor's positives are its first ``positives`` other rows of its label; for each of them, its negatives are the first
``negatives`` rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.

Anchors are clustered by direction: centroids are fitted on about ``SAMPLE`` anchors chosen by hash, and every anchor joins
the nearest. Small clusters share a block, a cluster of many members is dealt into several; candidates are dealt into blocks, and
each pair of blocks is a cell. With the largest angle t between a centroid and its members in the cell, no member a can score more than
|a| |x| cos(max(0, angle(x, centroid) - t)) with a row x. Candidates are sorted by that bound once per cluster and cell, and every member
walks the list in steps. It stops where the bound falls below all that could still change its result: the last of its
positives so far, or for negatives, for each positive, the least allowed score and the last negative so far. What it has not
seen is then certified to be worse. Cells' lists are merged by rank.

Of rows with equal vector and label only the smallest ids can be chosen, so no more are compared. Rows with a null id, label
or vector, or any null or non-finite component take no part; shorter vectors count as padded with zeros. Repeated rows (equal
id, label and vector) count once; rows of one id with different labels or vectors are separate candidates, and
as an anchor such an id stands for the first of them by label and vector. No anchor finds its own id. An anchor
without another row of its label, or a positive without a row in its range, has no result rows. Scores times 100 must fit 63
bits. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.search import sound
from cohortlake.llm.store import stage
from cohortlake.llm.vectors import best_of, block_of, blocks_for, every, matrix, worst_kept

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
SAMPLE, CLUSTERS, PER_CLUSTER, ROUNDS, MEMBERS, STEP = 1 << 13, 256, 32, 8, 2048, 1024


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    length = lengths(x)
    return x / np.where(length > 0, length, 1.0)[:, None]


def centroids(sample: np.ndarray, clusters: int = CLUSTERS) -> np.ndarray:
    """Directions that k-means by angle finds, from the first rows of the sample on."""
    points = unit(sample)
    centres = points[: max(1, min(clusters, len(points) // PER_CLUSTER))]
    for _ in range(ROUNDS):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        moved = unit(sums)
        centres = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, moved, centres)
    return centres


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact."""
    big = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(left.shape[1], 1) >= 2**53
    return left @ right.T if big else (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)


class Shared:
    """Candidates of a cell, sorted by what any member of the anchor cluster could score with them.

    ``directions`` are those of the rows, computed once for all clusters of a cell.
    """

    def __init__(self, members: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, centre: np.ndarray, directions=None):
        length, directions = (lengths(rows), unit(rows)) if directions is None else directions
        angle = lambda x: np.arccos(np.clip(x @ centre, -1.0, 1.0))
        # a zero row has bound zero at any angle, a zero member scores zero
        widest = angle(unit(members[np.abs(members).sum(axis=1) > 0])).max(initial=0.0)
        bound = length * np.cos(np.maximum(angle(directions) - widest - 1e-6, 0.0)) + 1e-9 * length
        order = np.argsort(-bound, kind="stable")
        self.rows, self.ids, self.labels, self.bound = rows[order], ids[order], labels[order], bound[order]
        self.looked = 0

    def only(self, label) -> Shared:
        """The part of the list with one label, in its order."""
        part, keep = object.__new__(Shared), self.labels == label
        part.rows, part.ids, part.labels, part.bound, part.looked = self.rows[keep], self.ids[keep], self.labels[keep], self.bound[keep], 0
        return part

    def walk(self, members: np.ndarray, bars, step: int = STEP):
        """Yield (positions of the members still walking, a slice of the list, their scores there) until all have stopped.

        ``bars`` gives the least score that could still matter to each member; it is asked before every step.
        """
        reach = lengths(members)
        walking = np.arange(len(members))
        for low in range(0, len(self.rows), step):
            bar = bars()[walking]
            walking = walking[~(reach[walking] * self.bound[low] < bar - 1e-9 * np.where(np.isfinite(bar), np.abs(bar), 0.0))]
            if not len(walking):
                return
            part = slice(low, min(low + step, len(self.rows)))
            self.looked += len(walking) * (part.stop - part.start)
            yield walking, part, scores(members[walking], self.rows[part])


class Best:
    """The k best entries of each of some groups."""

    def __init__(self, groups: int, k: int):
        self.groups, self.k = groups, k
        self.group, self.ids, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.bar = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(group):
            return
        group, ids, score = np.r_[self.group, group], np.r_[self.ids, ids], np.r_[self.score, score]
        keep = best_of(group, score, ids, self.k)
        self.group, self.ids, self.score = group[keep], ids[keep], score[keep]
        self.bar = worst_kept(self.group, self.score.astype(np.float64), self.k, self.groups)


def closest(shared: Shared, members: np.ndarray, own: np.ndarray, labels: np.ndarray, k: int) -> Best:
    """The first k rows of each member's label, its own id left out."""
    best = Best(len(members), k)
    for label in np.unique(labels):
        who = np.flatnonzero(labels == label)
        part = shared.only(label)
        for walking, rows, score in part.walk(members[who], lambda: best.bar[who]):
            at = who[walking]
            i, j = np.nonzero((score >= best.bar[at][:, None]) & (part.ids[rows][None, :] != own[at][:, None]))
            best.add(at[i], part.ids[rows][j], score[i, j])
        shared.looked += part.looked
    return best


def hardest(shared: Shared, members: np.ndarray, labels: np.ndarray, positive: np.ndarray, k: int, low: int, high: int) -> Best:
    """For each member and column of ``positive`` (scores, -1 where there is none), the first k rows of other labels in range; the
    group of member m and column c is m * columns + c."""
    columns = positive.shape[1]
    best = Best(positive.size, k)
    none = np.where(positive < 0, np.inf, low * positive / 100.0)

    def bars():
        return np.maximum(best.bar.reshape(-1, columns), none).min(axis=1, initial=np.inf)

    for walking, rows, score in shared.walk(members, bars):
        # what no column of the member can use goes at once
        i, j = np.nonzero(score >= bars()[walking][:, None])
        ids, value, who = shared.ids[rows][j], score[i, j], walking[i]
        other = shared.labels[rows][j] != labels[who]
        for c in range(columns):
            p = positive[who, c]
            fits = other & (p >= 0) & (100 * value >= low * p) & (100 * value <= high * p) & (value >= best.bar[who * columns + c])
            best.add(who[fits] * columns + c, ids[fits], value[fits])
    return best


def packed(sizes: dict[int, int], members: int) -> tuple[dict[int, tuple[int, int]], int]:
    """(first block, blocks) of every cluster, and the number of blocks: about ``members`` to a block, small clusters together."""
    out, blocks, room = {}, 0, 0
    for cluster in sorted(sizes, key=lambda c: (sizes[c], c)):
        size = sizes[cluster]
        if size <= room:
            out[cluster], room = (blocks - 1, 1), room - size
        else:
            own = -(-size // members)
            out[cluster], blocks, room = (blocks, own), blocks + own, members - size if own == 1 else 0
    return out, blocks


def _ranked(df: DataFrame, by: list[str], ids: str, score: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), ids))).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE, clusters: int = CLUSTERS,
    members: int = MEMBERS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1, among the negatives of one positive), negative_id, positive_score, negative_score."""
    usable = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & sound(F.col(vector))
    rows = vectors.where(usable).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("a"),
    )
    rows = stage(rows.groupBy("vec_id", "label", "v").agg(F.max("a").alias("a")), "vectors")
    total, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    place = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    others = rows.withColumn("n", place(["v", "label"], ["vec_id"])).where(F.col("n") <= max(positives, negatives) + 1).drop("n", "a")
    anchors = rows.where("a").withColumn("n", place(["vec_id"], ["label", "v"])).where("n = 1").drop("n", "a")

    # clusters of anchors, each dealt into blocks of about `members`
    asked = anchors.count()
    sampled = anchors if asked <= SAMPLE else anchors.where(F.xxhash64("vec_id") < -(2**63) + 2**64 * SAMPLE // asked)
    sampled = sampled.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").toArrow()
    centres = np.zeros((1, width or 0))
    if len(sampled):
        found = matrix(sampled.column("v"))
        centres = centroids(np.pad(found, ((0, 0), (0, (width or 0) - found.shape[1]))), clusters)
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            points = matrix(batch.column(2))
            own = (unit(points) @ shared.value[:, : points.shape[1]].T).argmax(axis=1) if len(points) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "cluster"])

    placed = stage(anchors.mapInArrow(assign, "vec_id bigint, label bigint, v array<bigint>, cluster bigint"), "anchors")
    dealt, down = packed({r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}, members)
    across = blocks_for(rows, total, width or 0, down)
    block = F.lit(0).cast("bigint")
    for cluster, (start, blocks) in dealt.items():
        block = F.when(F.col("cluster") == cluster, start + F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).otherwise(block)
    nothing = lambda kind: F.lit(None).cast(kind)
    right = others.select(
        every(max(down, 1)).alias("i"), block_of("vec_id", across).alias("j"), nothing("bigint").alias("cluster"), "vec_id", "label", "v",
        nothing("array<bigint>").alias("positive"),
    )

    def cells(asking: DataFrame) -> DataFrame:
        left = asking.select(block.alias("i"), every(across).alias("j"), "cluster", "vec_id", "label", "v", "positive")
        return left.unionByName(right).groupBy("i", "j")

    def lists(cell: pa.Table):
        """For each cluster of the cell: its list, and its members' vectors, ids, labels and positives."""
        cluster = cell.column("cluster").combine_chunks()
        asks = cluster.is_valid().to_numpy(zero_copy_only=False)
        own, given = cluster.fill_null(-1).to_numpy(), cell.column("positive")
        ids, labels, v = cell.column("vec_id").to_numpy(), cell.column("label").to_numpy(), matrix(cell.column("v")).astype(np.int64)
        rows = v[~asks]
        directions = lengths(rows), unit(rows)
        for name in np.unique(own[asks]):
            who = np.flatnonzero(own == name)
            shared_list = Shared(v[who], rows, ids[~asks], labels[~asks], shared.value[name, : v.shape[1]], directions)
            yield shared_list, v[who], ids[who], labels[who], given.take(pa.array(who)).to_pylist()

    def near(cell: pa.Table) -> pa.Table:
        found = [pa.table({c: pa.array([], pa.int64()) for c in ("anchor_id", "vec_id", "score")})]
        for listed, a, ids, labels, _ in lists(cell):
            best = closest(listed, a, ids, labels, positives)
            found.append(pa.table({"anchor_id": ids[best.group], "vec_id": best.ids, "score": best.score}))
        return pa.concat_tables(found)

    def far(cell: pa.Table) -> pa.Table:
        found = [pa.table({c: pa.array([], pa.int64()) for c in ("anchor_id", "nth", "vec_id", "score")})]
        for listed, a, ids, labels, given in lists(cell):
            positive = np.full((len(given), positives), -1, np.int64)
            for i, some in enumerate(given):
                positive[i, : len(some)] = np.maximum(some, -1)
            best = hardest(listed, a, labels, positive, negatives, low, high)
            found.append(pa.table({
                "anchor_id": ids[best.group // positives], "nth": best.group % positives + 1, "vec_id": best.ids, "score": best.score,
            }))
        return pa.concat_tables(found)

    first = cells(placed.withColumn("positive", F.lit(None).cast("array<bigint>"))).applyInArrow(near, "anchor_id bigint, vec_id bigint, score bigint")
    chosen = stage(_ranked(first, ["anchor_id"], "vec_id", "score", positives), "positives")
    listed = chosen.groupBy("anchor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("positive"))
    walked = placed.join(listed, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    found = cells(walked).applyInArrow(far, "anchor_id bigint, nth bigint, vec_id bigint, score bigint")
    found = _ranked(found, ["anchor_id", "nth"], "vec_id", "score", negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    pairs = chosen.select(
        F.col("anchor_id").alias("of"), F.col("rank").cast("bigint").alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return found.join(pairs, (F.col("anchor_id") == F.col("of")) & (F.col("nth") == F.col("at"))).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
