"""Exact top-k by inner product, pruned by segment statistics at several resolutions.

Components x become floor(scale * x). A vector is cut into segments; with the mean m and deviation s of a
segment of length n, |q - x|^2 is at least the sum over segments of n * ((mq - mx)^2 + (sq - sx)^2). The
score is (|q|^2 + |x|^2 - |q - x|^2) / 2, so the bound caps it from above. Few long segments
come first; what they leave is bounded by finer ones, and survivors are scored exactly.

Queries and candidates are dealt into blocks; a task compares one block of queries with one of
candidates and returns its best k per query, with the k-th best so far as the bar. A last
step picks k of those. Of equal vectors only the smallest k + 1 ids can be among the best, so
a block looks at no more of them. Vectors that are null, hold null or
non-finite components, or have no id take no part; shorter vectors count as padded with zeros. Scores
must fit 63 bits. Rows of equal id are separate candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.store import stage

K, SCALE, QUERIES, CANDIDATES = 20, 64, 2048, 8192
LEVELS = (4, 16)


def sound(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations, such that products of two rows sum to the bound's cross term."""
    n = -(-x.shape[1] // segments)
    parts = np.pad(x, ((0, 0), (0, n * segments - x.shape[1]))).reshape(len(x), segments, n)
    mean = parts.mean(axis=2)
    deviation = np.sqrt(np.maximum((parts**2).mean(axis=2) - mean**2, 0))
    return np.concatenate((mean, deviation), axis=1) * np.sqrt(n)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, levels=LEVELS):
    """(query position, row position, score) of the k best rows for each query, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    _, same = np.unique(rows, axis=0, return_inverse=True)
    by = np.argsort(same.ravel(), kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(same.ravel()[by]) > 0]) if len(by) else np.empty(0, np.int64)
    nth = np.arange(len(by)) - np.repeat(heads, np.diff(np.r_[heads, len(by)]))
    keep = np.sort(by[nth <= k])
    rows, ids, order = rows[keep], ids[keep], order[keep]
    big = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(rows.shape[1], 1) >= 2**53
    qf, xf = queries.astype(np.float64), rows.astype(np.float64)
    marks = [(statistics(qf, s), statistics(xf, s)) for s in levels]
    # statistics are rounded: a bound must stay a bound
    slack = 1e-9 * (1 + np.sqrt((qf**2).sum(axis=1)))[:, None] * (1 + np.sqrt((xf**2).sum(axis=1)).max(initial=0))
    found = []
    # scores of a first slice of rows set the bar
    for i in range(len(queries)):
        own = ids == query_ids[i]
        bar, have_rows, have_scores = -np.inf, np.empty(0, np.int64), np.empty(0, np.int64)
        for low in range(0, len(rows), 2048):
            at = np.arange(low, min(low + 2048, len(rows)))
            at = at[~own[at]]
            for q, x in marks:
                if bar > -np.inf:
                    at = at[x[at] @ q[i] + slack[i] >= bar]
            if not len(at):
                continue
            score = (rows[at] @ queries[i]) if big else (xf[at] @ qf[i]).astype(np.int64)
            have_rows, have_scores = np.r_[have_rows, at], np.r_[have_scores, score]
            if len(have_rows) > k:
                top = np.lexsort((have_rows, -have_scores))[:k]
                have_rows, have_scores = have_rows[top], have_scores[top]
            if len(have_rows) >= k:
                bar = have_scores.min()
        found.append((np.full(len(have_rows), i), order[have_rows], have_scores))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def top_k(
    vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE,
    queries: int = QUERIES, candidates: int = CANDIDATES, levels=LEVELS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for each row that ``is_query`` selects."""
    rows = vectors.where(F.col(vec_id).isNotNull() & sound(F.col(vector))).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"),
    )
    rows = stage(rows, "vectors")
    total, asked = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    across, down = max(1, -(-total // candidates)), max(1, -(-asked // queries))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("bigint")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = rows.where("q").select("vec_id", "v", block(down).alias("i"), all_of(across).alias("j"), F.lit(True).alias("asks"))
    right = rows.select("vec_id", "v", block(across).alias("j"), all_of(down).alias("i"), F.lit(False).alias("asks"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        width = max(cell["v"].map(len).max(), 1)
        if (cell["v"].map(len) == width).all():
            values = np.array(cell["v"].tolist(), np.int64).reshape(len(cell), -1)
        else:
            values = np.array([np.pad(v, (0, width - len(v))) for v in cell["v"]], np.int64).reshape(len(cell), -1)
        asks, ids = cell["asks"].to_numpy(), cell["vec_id"].to_numpy()
        i, j, score = best(values[asks], ids[asks], values[~asks], ids[~asks], k, levels)
        return pd.DataFrame({"query_id": ids[asks][i], "vec_id": ids[~asks][j], "score": score})

    cells = left.unionByName(right).groupBy("i", "j").applyInPandas(compare, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
