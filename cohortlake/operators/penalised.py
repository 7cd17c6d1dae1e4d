"""Penalised logistic regression: a whole grid of penalties from a few passes over the data.

Each pass adds up, for every point of the grid that has not settled, the loss, its gradient and its second derivatives (a weighted
Gram matrix) at the point's current coefficients. The quadratic that these make, with the penalty, is then minimised on p x p
numbers by a search over signs, starting from the current coefficients. Passes are those of the slowest point, not one series
per point. A step that raises the objective is halved. The penalty is reg * (mix * |b|_1 + (1 - mix) / 2 * |b|^2) on coefficients
of columns divided by their deviations, the constant left out, as Spark's learner has it; columns without deviation get zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators import gram, ml
from cohortlake.operators.evaluation import CELLS, metric_columns

TOLERANCE, PASSES, STEPS = 1e-8, 60, 4


def vectors(encoded: DataFrame, label: str) -> DataFrame:
    """Constant, encoded features and label as one array, as :mod:`gram` reads it."""
    ends = [F.array(F.lit(1.0)), vector_to_array(ml.FEATURES), F.array(F.col(label).cast("double"))]
    return encoded.where(F.col(label).isNotNull()).select(F.concat(*ends).alias(gram.VECTOR))


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def sums_at(rows: DataFrame, coefficients: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Per point (row of ``coefficients``): loss, gradient and upper triangle of the second derivatives, added over all rows."""
    points, size = coefficients.shape
    upper = np.triu_indices(size)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((points, 1 + size + len(upper[0])))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _values(batch)
            x, y = (z[:, :-1] - centre) / scale, z[:, -1]
            eta = x @ coefficients.T
            p = 1 / (1 + np.exp(-eta))
            total[:, 0] += (np.logaddexp(0, eta) - y[:, None] * eta).sum(axis=0)
            total[:, 1 : 1 + size] += (p - y[:, None]).T @ x
            for k, w in enumerate((p * (1 - p)).T):
                total[k, 1 + size :] += ((x * w[:, None]).T @ x)[upper]
        yield pa.RecordBatch.from_arrays([pa.array(range(points), pa.int64()), pa.array(total.tolist())], names=["point", "sums"])

    parts = rows.mapInArrow(add_up, "point bigint, sums array<double>").select("point", F.posexplode("sums").alias("at", "value"))
    added = parts.groupBy("point", "at").agg(F.sum("value").alias("value")).groupBy("point").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("sums"))
    return np.array([r["sums"] for r in added.orderBy("point").collect()])


def minimise(gradient: np.ndarray, second: np.ndarray, start: np.ndarray, l1: float, l2: float, free: np.ndarray) -> np.ndarray:
    """The b of least gradient'(b - start) + (b - start)' second (b - start) / 2 + l1 |b|_1 + l2 |b|^2 / 2; no penalty on b[0].

    With the signs of the columns in use fixed, the best b solves a linear system. Where the way there crosses zeros, the best
    of the crossings and the end is taken; once the columns in use are optimal, the one outside that violates most comes in.
    """
    columns = np.flatnonzero(free)
    penalised = columns != 0
    h = second[np.ix_(columns, columns)]
    c = h @ start[columns] - gradient[columns]
    # collinear columns: a ridge far below every penalty makes the answer one
    h = h + np.diag(np.where(penalised, l2, 0.0) + 1e-10 * h.diagonal().mean())
    cost, slack = l1 * penalised, 1e-11 + 1e-9 * l1
    b = start[columns].copy()
    sign = np.where(penalised, np.sign(b), 0.0)
    used = (b != 0) | ~penalised
    value = lambda x: x @ h @ x / 2 - c @ x + cost @ np.abs(x)
    for _ in range(STEPS * len(columns)):
        at = np.flatnonzero(used)
        end = b.copy()
        end[at] = np.linalg.solve(h[np.ix_(at, at)], c[at] - cost[at] * sign[at])
        crossed = at[penalised[at] & (b[at] * end[at] < 0)]
        if len(crossed) or (end[at] * sign[at] < 0).any():
            ways = [b + t * (end - b) for t in b[crossed] / (b[crossed] - end[crossed])]
            for way, j in zip(ways, crossed):
                way[j] = 0.0
            b = min([*ways, end], key=value)
        else:
            b = end
        used = (b != 0) | ~penalised
        sign = np.where(penalised, np.sign(b), 0.0)
        slope = h @ b - c
        if np.abs((slope + cost * sign)[used]).max(initial=0.0) > slack:
            continue
        excess = np.where(used, -np.inf, np.abs(slope) - cost)
        worst = int(excess.argmax())
        if excess[worst] <= slack:
            break
        used[worst], sign[worst] = True, -np.sign(slope[worst])
    out = start.copy()
    out[columns] = b
    return out


def fit_grid(rows: DataFrame, points: Sequence[Mapping[str, float]], passes: int = PASSES) -> tuple[np.ndarray, int]:
    """Coefficients (constant first, on the columns as they are) of every point (reg, mix), and the passes they took."""
    moments = gram.moments(rows, [])[()]
    n, sums, squares = moments[0, 0], moments[0, :-1], moments.diagonal()[:-1]
    centre = sums / n
    deviation = np.sqrt(np.maximum(squares - n * centre**2, 0) / max(n - 1, 1))
    free = deviation > 1e-9 * np.maximum(np.abs(centre), 1e-300)
    free[0], centre[0], deviation[0] = True, 0.0, 1.0
    scale = np.where(free, deviation, 1.0)
    l1 = np.array([p["reg"] * p["mix"] for p in points])
    l2 = np.array([p["reg"] * (1 - p["mix"]) for p in points])
    now = np.zeros((len(points), len(centre)))
    rate = np.clip(moments[0, -1] / n, 1e-9, 1 - 1e-9)
    now[:, 0] = np.log(rate / (1 - rate))
    before, objective, open_ = now.copy(), np.full(len(points), np.inf), np.arange(len(points))
    used, upper = 0, np.triu_indices(len(centre))
    while len(open_) and used < passes:
        found, used = sums_at(rows, now[open_], centre, scale) / n, used + 1
        still = []
        for k, row in zip(open_, found):
            penalty = l1[k] * np.abs(now[k, 1:]).sum() + l2[k] / 2 * (now[k, 1:] ** 2).sum()
            if row[0] + penalty > objective[k] + 1e-12 * abs(objective[k]):
                now[k] = (now[k] + before[k]) / 2
                if np.abs(now[k] - before[k]).max() >= TOLERANCE:
                    still.append(k)
                continue
            objective[k], before[k] = row[0] + penalty, now[k].copy()
            second = np.zeros((len(centre),) * 2)
            second[upper] = row[1 + len(centre) :]
            second += np.triu(second, 1).T
            now[k] = minimise(row[1 : 1 + len(centre)], second, now[k], l1[k], l2[k], free)
            if np.abs(now[k] - before[k]).max() >= TOLERANCE:
                still.append(k)
        open_ = np.array(still, np.int64)
    out = now / scale
    out[:, 0] -= (now[:, 1:] / scale[1:]) @ centre[1:]
    return out, used


def grid_outcomes(rows: DataFrame, coefficients: np.ndarray) -> DataFrame:
    """point, tp, tn, fp, fn of every row of ``coefficients``, from one pass."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = _values(batch)
                yes, good = z[:, :-1] @ coefficients.T > 0, (z[:, -1] == 1)[:, None]
                cells = [(yes & good), (~yes & ~good), (yes & ~good), (~yes & good)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(coefficients)), pa.int64()), *[pa.array(c.sum(axis=0)) for c in cells]], names=["point", *CELLS])

    return rows.mapInArrow(count, ", ".join(f"{c} bigint" for c in ("point", *CELLS))).groupBy("point").agg(*[F.sum(c).alias(c) for c in CELLS])


def choose(train: DataFrame, validation: DataFrame, label: str, points: Sequence[Mapping[str, float]]) -> tuple[dict, list[float | None]]:
    """The point with the best correlation coefficient on validation (the first of equal ones), and all values; encoded sets."""
    coefficients, _ = fit_grid(vectors(train, label), points)
    cells = grid_outcomes(vectors(validation, label), coefficients).select("point", metric_columns()["mcc"].alias("mcc"))
    found = {r["point"]: r["mcc"] for r in cells.collect()}
    values = [found.get(k) for k in range(len(points))]
    best = max(range(len(points)), key=lambda k: (-np.inf if values[k] is None else values[k], -k))
    return dict(points[best]), values
