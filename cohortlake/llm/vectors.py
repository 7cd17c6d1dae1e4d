"""What the operators on vectors share: Arrow lists as matrices, bounded best lists, blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values (rows times width) that one block of vectors may hold, and rows that it holds at least if there are so many.
VALUES, ROWS = 1 << 21, 1024


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The lists of a column as rows; shorter ones are padded with zeros."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), values.dtype)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each group, best first: highest score, then smallest id."""
    order = np.lexsort((ids, -score, group))
    ordered = group[order]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else np.empty(0, np.int64)
    nth = np.arange(len(order)) - np.repeat(heads, np.diff(np.r_[heads, len(order)]))
    return order[nth < k]


def worst_kept(group: np.ndarray, score: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The score that a new entry of each group must reach: that of its k-th entry, or minus infinity if it has fewer."""
    bar = np.full(groups, np.inf)
    np.minimum.at(bar, group, score)
    bar[np.bincount(group, minlength=groups) < k] = -np.inf
    return bar


def block_of(row_id: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(row_id), F.lit(blocks)).cast("bigint")


def every(blocks: int) -> Column:
    """One row for each block number."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))


def blocks_for(df: DataFrame, rows: int, width: int, others: int = 1, values: int = VALUES) -> int:
    """Blocks that keep each within ``values``, more where that leaves fewer cells than the session's cores would like."""
    needed = -(-rows // max(ROWS, values // max(width, 1)))
    wanted = min(-(-3 * df.sparkSession.sparkContext.defaultParallelism // max(others, 1)), rows // ROWS)
    return max(1, needed, wanted)
