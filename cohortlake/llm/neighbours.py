"""Nearest neighbours by largest inner product: a block matrix join over int8 codes, exact results.

A vector x is coded as int8: its scale s is its largest absolute component over 127, its code c is x / s rounded, and
e = x - s c is what coding leaves over. For a query q and a candidate x the inner product differs from sq sx (cq . cx) by
at most |sq cq| |ex| + |eq| |x| (Cauchy-Schwarz, with the lengths of what was really left over, not of the worst case).

Queries and candidates are dealt into blocks and each pair of blocks is a cell. In a cell, tiles of integer products (in
float32, which holds them exactly, at most 1024 components at a time) give an upper and a lower bound for every
pair. The k-th best lower bound of the first tile, and later the k-th best exact score so far, is the bar; pairs whose upper
bound reaches it are recomputed in double precision from the original vectors, summed from the first component to the last,
and merged into the query's k best. A last step merges the cells' lists with one heap of k entries per query. Nothing is
approximate about the result: recall is 1.

Of candidates with equal vectors only the smallest k + 1 ids can be among the best, so no more are compared. Vectors that
are null, empty, zero, or hold null or non-finite components, and rows without id, take no part; shorter vectors count as
padded with zeros. Repeated rows (equal id and vector) count once; rows of one id with different vectors
are separate candidates, and such an id asks with the least of its vectors (in array order). No row finds its own id.
Scores must be finite in double precision. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.search import sound
from cohortlake.llm.store import stage
from cohortlake.llm.vectors import best_of, block_of, blocks_for, every, matrix, worst_kept

K, TILE_QUERIES, TILE_ROWS, EXACT = 20, 512, 4096, 1024
FOUND = "query_id bigint, vec_id bigint, score double"
#: Share of |q| |x| by which float32 arithmetic on the bounds may be off, several times over.
SLACK = 4e-6


class Codes:
    """int8 codes of rows, scaled as a whole by a power of two so that float32 holds their lengths."""

    def __init__(self, x: np.ndarray):
        self.unit = 2.0 ** -int(np.frexp(np.abs(x).max(initial=0.0))[1])
        x = x * self.unit
        scale = np.abs(x).max(axis=1, initial=0.0) / 127
        self.scale = np.where(scale > 0, scale, 1.0)
        self.codes = np.rint(x / self.scale[:, None]).astype(np.int8)
        self.rest = np.sqrt(((x - self.codes * self.scale[:, None]) ** 2).sum(axis=1))
        self.length = np.sqrt((x**2).sum(axis=1))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of int8 rows as float32 (exact where the sums are below 2**24, rounded once per slice beyond)."""
    total = None
    for low in range(0, max(left.shape[1], 1), EXACT):
        part = left[:, low : low + EXACT].astype(np.float32) @ right[:, low : low + EXACT].astype(np.float32).T
        total = part if total is None else total + part
    return total


def exact(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (i, j), summed from the first component to the last; the arguments hold one component a row."""
    out = np.zeros(len(i))
    for low in range(0, len(i), 1 << 17):
        a, b, part = i[low : low + (1 << 17)], j[low : low + (1 << 17)], out[low : low + (1 << 17)]
        for x, y in zip(left, right):
            part += x[a] * y[b]
    return out


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int = K):
    """(query position, row position, score) of the k best rows of each query, and how many pairs were recomputed."""
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(x.astype(np.float64), ((0, 0), (0, width - x.shape[1]))) for x in (queries, rows))
    coded, by_component = Codes(rows), np.ascontiguousarray(rows.T)
    found, recomputed = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
    for top in range(0, len(queries), TILE_QUERIES):
        asked, own = queries[top : top + TILE_QUERIES], query_ids[top : top + TILE_QUERIES]
        q, parts = Codes(asked), np.ascontiguousarray(asked.T)
        lengths = np.sqrt((q.codes.astype(np.float64) ** 2).sum(axis=1))
        # both bounds are those of the product over the query's scale
        edge = np.stack((lengths, q.rest / q.scale, SLACK * (q.length / q.scale + lengths)), axis=1).astype(np.float32)
        group, at, score = (x[:0] for x in found[0])
        bar = np.full(len(asked), -np.inf)
        for low in range(0, len(rows), TILE_ROWS):
            part = slice(low, min(low + TILE_ROWS, len(rows)))
            middle = products(q.codes, coded.codes[part]) * coded.scale[part].astype(np.float32)
            reach = edge @ np.stack((coded.rest[part], coded.length[part], coded.length[part])).astype(np.float32) + np.float32(1e-30)
            order = np.argsort(ids[part], kind="stable")
            first, last = (np.searchsorted(ids[part][order], own, side) for side in ("left", "right"))
            for i in np.flatnonzero(first < last):
                middle[i, order[first[i] : last[i]]] = -np.inf
            if low == 0 and middle.shape[1] >= k:
                bar = np.partition(middle - reach, -k, axis=1)[:, -k].astype(np.float64) * q.scale
                bar = bar / q.unit / coded.unit
            limit = (bar * q.unit * coded.unit / q.scale).astype(np.float32)
            i, j = np.nonzero((middle + reach >= limit[:, None]) & (middle > -np.inf))
            recomputed += len(i)
            value = exact(parts, by_component, i, j + low)
            group, at, score = np.r_[group, i], np.r_[at, j + low], np.r_[score, value]
            keep = best_of(group, score, ids[at], k)
            group, at, score = group[keep], at[keep], score[keep]
            bar = np.maximum(bar, worst_kept(group, score, k, len(asked)))
        found.append((group + top, at, score))
    return *(np.concatenate(x) for x in zip(*found)), recomputed


def merged(lists: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of each query's lists, by a heap of k entries."""

    def merge(batches):
        now, heap, out = None, [], []

        def settle():
            for rank, (score, less) in enumerate(sorted(heap, reverse=True), 1):
                out.append((now, rank, -less, score))

        for batch in batches:
            for query, row, score in zip(*(c.to_pylist() for c in batch.columns)):
                if query != now:
                    settle()
                    now, heap = query, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -row))
                elif (score, -row) > heap[0]:
                    heapq.heapreplace(heap, (score, -row))
            if len(out) > 1 << 15:
                yield _ranked(out)
                out.clear()
        settle()
        yield _ranked(out)

    return lists.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    columns = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "rank", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other rows of each row that ``is_query`` selects."""
    element = vectors.schema[vector].dataType.elementType.typeName()
    kind = "array<float>" if element == "float" else "array<double>"
    usable = F.col(vec_id).isNotNull() & sound(F.col(vector)) & F.exists(vector, lambda x: x != 0)
    rows = vectors.where(usable).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    rows = stage(rows.groupBy("vec_id", "v").agg(F.max("q").alias("q")), "vectors")
    total, asked, width = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1)), F.max(F.size("v"))).first()
    down = blocks_for(rows, asked, width or 0)
    across = blocks_for(rows, total, width or 0, down)
    first = lambda by, order, n: F.row_number().over(Window.partitionBy(by).orderBy(order)) <= n
    asking = rows.where("q").withColumn("first", first("vec_id", "v", 1)).where("first")
    others = rows.withColumn("first", first("v", "vec_id", k + 1)).where("first")
    left = asking.select("vec_id", "v", block_of("vec_id", down).alias("i"), every(across).alias("j"), F.lit(True).alias("asks"))
    right = others.select("vec_id", "v", every(down).alias("i"), block_of("vec_id", across).alias("j"), F.lit(False).alias("asks"))

    def compare(cell: pa.Table) -> pa.Table:
        asks = cell.column("asks").to_numpy()
        ids, values = cell.column("vec_id").to_numpy(), matrix(cell.column("v"))
        i, j, score, _ = nearest(values[asks], ids[asks], values[~asks], ids[~asks], k)
        return pa.table({"query_id": ids[asks][i], "vec_id": ids[~asks][j], "score": score})

    return merged(left.unionByName(right).groupBy("i", "j").applyInArrow(compare, FOUND), k)
