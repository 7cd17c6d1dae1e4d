"""Least squares from one Gram matrix per group.

One pass adds up z z' of every row, z being the constant, the design columns and the target: per group p(p+1)/2 sums,
whatever the rows. Any regression on some of the columns, its coefficients, and on another group its R-squared,
follow from sub-matrices of p x p without another pass. Tasks add up their own rows with numpy; the partial sums
meet by (group, position). What comes to the driver are the sums of a few groups, bounded by the square of the columns.

Columns are eliminated in the order given. One whose remaining square is at most ``TOLERANCE`` of its own
sum of squares is determined by earlier ones and gets coefficient zero (among them the last dummy of each category, beside the
constant), so collinear designs have one defined answer. Rows with a null or non-finite target or design value take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9
CONSTANT = "(constant)"
VECTOR = "z"


def dummies(column: str, levels: Sequence[str]) -> dict[str, Column]:
    """A 0/1 column per level; null and unlisted values are zero in all."""
    return {f"{column}={x}": F.coalesce((F.col(column) == x).cast("double"), F.lit(0.0)) for x in levels}


def levels_of(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The values of each column, most frequent first, ties alphabetical; one aggregate for all columns."""
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counts = long.where("value is not null").groupBy("column", "value").count().orderBy("column", F.desc("count"), "value")
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in counts.collect():
        found[row["column"]].append(row["value"])
    return found


def design(df: DataFrame, slots: Mapping[str, Column], target: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and the vector ``z`` of constant, slots and target, for rows where all of these are known."""
    values = [F.lit(1.0), *slots.values(), F.col(target)]
    known = F.forall(VECTOR, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(*keep, F.array(*[c.cast("double") for c in values]).alias(VECTOR)).where(known)


def moments(rows: DataFrame, group: Sequence[str]) -> dict[tuple, np.ndarray]:
    """The symmetric matrix of sums of z z' for each group of a design."""
    group = list(group)
    keys = rows.select(*[F.col(c).cast("string") for c in group], VECTOR)
    schema = ", ".join([*[f"`{c}` string" for c in group], "sums array<double>"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(group))))) or [()] * len(z)
            order = {name: i for i, name in enumerate(dict.fromkeys(names))}
            own = np.fromiter((order[n] for n in names), np.int64, len(names))
            for name, i in order.items():
                part = z[own == i]
                sums[name] = sums.get(name, 0) + part.T @ part
        if sums:
            upper = np.triu_indices(len(next(iter(sums.values()))))
            columns = [pa.array([n[i] for n in sums], pa.string()) for i in range(len(group))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m[upper].tolist() for m in sums.values()])], names=[*group, "sums"])

    parts = keys.mapInArrow(add_up, schema)
    added = parts.select(*group, F.posexplode("sums").alias("at", "value")).groupBy(*group, "at").agg(F.sum("value").alias("value"))
    packed = added.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("sums"))
    return {tuple(row[c] for c in group): _square(row["sums"]) for row in packed.collect()}


def _square(sums: Sequence[float]) -> np.ndarray:
    size = int((np.sqrt(8 * len(sums) + 1) - 1) / 2)
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = sums
    return out + np.triu(out, 1).T


def solve(matrix: np.ndarray, columns: Sequence[int] | None = None) -> np.ndarray:
    """Coefficients of the constant and the slots, zero for slots outside ``columns`` (positions, the constant is 0)
    and for those that earlier ones determine."""
    size = len(matrix) - 1
    used = list(range(size)) if columns is None else sorted({0, *columns})
    part = matrix[np.ix_([*used, size], [*used, size])].copy()
    own, kept = part.diagonal().copy(), []
    for k in range(len(used)):
        if part[k, k] <= TOLERANCE * own[k] or own[k] <= 0:
            continue
        row = part[k] / part[k, k]
        part -= np.outer(part[:, k], row)
        part[k] = row
        kept.append(k)
    out = np.zeros(size)
    out[np.array(used)[kept]] = part[kept, -1]
    return out


def fit_of(matrix: np.ndarray, coefficients: np.ndarray) -> dict[str, float | None]:
    """Rows, means and R-squared of coefficients on the rows that the matrix sums up."""
    rows, total, square = matrix[0, 0], matrix[0, -1], matrix[-1, -1]
    if not rows:
        return {"rows": 0, "r2": None, "mean_actual": None, "mean_predicted": None}
    spread = square - total * total / rows
    missed = square - 2 * coefficients @ matrix[:-1, -1] + coefficients @ matrix[:-1, :-1] @ coefficients
    return {
        "rows": int(rows), "r2": float(1 - missed / spread) if spread > 0 else None, "mean_actual": float(total / rows),
        "mean_predicted": float(coefficients @ matrix[:-1, 0] / rows),
    }


def prediction(coefficients: Column) -> Column:
    """The product of a row's design vector, its target left out, and a coefficient array."""
    products = F.zip_with(F.slice(VECTOR, F.lit(1), F.size(VECTOR) - 1), coefficients, lambda x, b: x * b)
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
