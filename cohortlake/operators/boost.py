"""Gradient boosting of second order, grown level by level from histograms that Spark adds up.

For each tree, rows carry the first and second derivative (g, h) of the loss at their margin. A node's best split is found from
the sums of g, h and rows per (node, feature, bin): tasks add up their rows, Spark adds up the tasks', and a node's sums are then
judged in one small group. Nodes of at most ``LOCAL`` rows are grown to the end where their rows meet: one group
is one node's rows, which that bound keeps small. After each tree the margins are written to a table of their own, so a lost
executor replays one tree at most. The driver holds the trees.

Values are binned by quantiles, at most ``BINS`` of them; a value equal to ``missing`` (or null) has no bin and takes the side of each
split that gains more. With G, H the sums of a node and T(G) = G drawn towards zero by ``alpha``, its weight is -T(G) / (H + lambda)
and its score T(G)^2 / (H + lambda); a split gains the children's scores less its own. Nodes are split while that is positive, each
child has ``child`` of H at least, and depth allows; then splits that gain less than ``gamma`` are taken back from the leaves up. Of
equal gains the earlier feature, the lower bin, and missing values to the low side win. Rows are drawn per tree and
columns per tree and per level by hash, so a rerun fits the same trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.hashing import below, threshold, word
from cohortlake.session import materialize, superseded

BINS, LOCAL, WHOLE, CELLS, LEAST_GAIN = 63, 8192, 1 << 26, 1 << 17, 1e-6
KINDS = {"feature": np.int32, "bound": np.uint8, "missing_low": np.bool_, "low": np.int32, "high": np.int32, "gain": np.float64, "value": np.float64}
ROWS = "key bigint, y double, bins binary, margin double"


@dataclass(frozen=True)
class Settings:
    """Named as the reference's learners name them, less their prefixes."""

    trees: int = 20
    step: float = 0.1
    depth: int = 6
    subsample: float = 1.0
    by_tree: float = 1.0
    by_level: float = 1.0
    alpha: float = 0.0
    lambda_: float = 1.0
    gamma: float = 0.0
    child: float = 0.0
    logistic: bool = True
    salt: str = "boost"


@dataclass
class Tree:
    """Nodes as lists; a leaf has feature -1. ``low`` takes bins up to ``bound``, and missing values where ``missing_low``."""

    feature: list = field(default_factory=list)
    bound: list = field(default_factory=list)
    missing_low: list = field(default_factory=list)
    low: list = field(default_factory=list)
    high: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def leaf(self, value: float) -> int:
        for name, x in zip(vars(self), (-1, 0, True, -1, -1, 0.0, value)):
            getattr(self, name).append(x)
        return len(self.value) - 1

    def split(self, node: int, feature: int, bound: int, missing_low: bool, gain: float, low: float, high: float) -> tuple[int, int]:
        a, b = self.leaf(low), self.leaf(high)
        self.feature[node], self.bound[node], self.missing_low[node], self.low[node], self.high[node], self.gain[node] = feature, bound, missing_low, a, b, gain
        return a, b

    def split_all(self, nodes: np.ndarray, feature, bound, missing_low, gain, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """:meth:`split` for leaves one after another; low and high child of each in turn."""
        after = len(self.value) + np.arange(2 * len(nodes))
        for name, x in zip(vars(self), (-1, 0, True, -1, -1, 0.0)):
            getattr(self, name).extend([x] * len(after))
        self.value.extend(np.stack((low, high), axis=1).ravel().tolist())
        for i, *split in zip(nodes.tolist(), *[np.asarray(x).tolist() for x in (feature, bound, missing_low, gain, after[::2], after[1::2])]):
            self.feature[i], self.bound[i], self.missing_low[i], self.gain[i], self.low[i], self.high[i] = int(split[0]), int(split[1]), *split[2:]
        return after

    def prune(self, gamma: float) -> None:
        """Take back splits of two leaves that gain less than gamma; children come after their parents."""
        for node in range(len(self.feature) - 1, -1, -1):
            if self.feature[node] >= 0 and self.gain[node] < gamma and self.feature[self.low[node]] < 0 and self.feature[self.high[node]] < 0:
                self.feature[node] = -1

    def packed(self) -> Tree:
        """The same as arrays of small numbers: a hundred deep trees have many nodes."""
        return Tree(**{n: np.array(x, KINDS[n]) for n, x in vars(self).items()})

    def arrays(self) -> tuple[np.ndarray, ...]:
        """What :func:`route` reads. Tasks get it made: nodes grow with the table, and so do the batches that are routed."""
        return tuple(np.asarray(x) for x in (self.feature, self.bound, self.missing_low, self.low, self.high))


def route(arrays: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    feature, bound, missing_low, low, high = arrays
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    moving = rows[feature[at] >= 0]
    while len(moving):
        node = at[moving]
        value = bins[moving, feature[node]]
        at[moving] = np.where(np.where(value == 0, missing_low[node], value <= bound[node]), low[node], high[node])
        moving = moving[feature[at[moving]] >= 0]
    return at


def weight(g, h, s: Settings):
    h = np.asarray(h) + s.lambda_
    return np.where(h > 0, -np.sign(g) * np.maximum(np.abs(g) - s.alpha, 0) / np.where(h > 0, h, 1), 0.0)


def score(g, h, s: Settings):
    h = h + s.lambda_
    g = np.maximum(np.abs(g) - s.alpha, 0) if s.alpha else g
    return g * g / h if s.lambda_ > 0 else np.where(h > 0, g * g / np.where(h > 0, h, 1), 0.0)


def derivatives(margin: np.ndarray, y: np.ndarray, s: Settings):
    if not s.logistic:
        return margin - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-margin))
    return p - y, p * (1 - p)


def columns_of(tree: int, level: int, count: int, s: Settings) -> np.ndarray:
    """The columns that one level of one tree may split on."""
    def first(candidates, share, *where):
        ranked = sorted(candidates, key=lambda c: hashlib.md5("|".join(map(str, (s.salt, *where, c))).encode()).hexdigest())
        return sorted(ranked[: max(1, round(share * len(ranked)))])

    return np.array(first(first(range(count), s.by_tree, "tree", tree), s.by_level, "level", tree, level), np.int64)


class Layout:
    """Where the bins of each column lie in one row of cells: bin 0 (missing) first, as many as the column has."""

    def __init__(self, cuts: Sequence[np.ndarray]):
        sizes = np.array([len(c) + 2 for c in cuts], np.int64)
        self.columns, self.total = len(sizes), int(sizes.sum())
        self.end = np.cumsum(sizes).astype(np.int64)
        self.start = self.end - sizes
        self.column = np.repeat(np.arange(len(sizes)), sizes)

    def open(self, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the allowed columns, those of missing values left out, and which of them are a column's first."""
        cells = np.isin(self.column, allowed)
        cells[self.start] = False
        first = np.zeros(self.total, bool)
        first[self.start[allowed] + 1] = True
        return cells, first

    def cells(self, bins: np.ndarray) -> np.ndarray:
        """Each row's known values as cells, filled up with ``total``: of many 0/1 columns a row has few."""
        row, column = np.nonzero(bins)
        known = np.bincount(row, minlength=len(bins))
        out = np.full((len(bins), max(int(known.max(initial=0)), 1)), self.total, np.int32)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(known) - known, known)] = self.start[column] + bins[row, column]
        return out


def histograms(at: np.ndarray, cells: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, layout: Layout) -> np.ndarray:
    """Sums of g, h and rows by [which, node, cell] over known values; the cell after the last is that of all rows."""
    width = layout.total + 1
    cell = (at[:, None] * width + cells).ravel()
    out = np.empty((3, nodes, width))
    for k, w in enumerate((g, h, None)):
        out[k] = np.bincount(cell, w if w is None else np.repeat(w, cells.shape[1]), nodes * width).reshape(nodes, width)
        out[k, :, -1] = np.bincount(at, w, nodes)
    return out


def best_splits(sums: np.ndarray, allowed: np.ndarray, s: Settings, layout: Layout) -> tuple[np.ndarray, ...]:
    """node, gain, column, bin, missing low, sums low, sums high of the nodes of [which, node, cell] that a split gains.

    An empty bin parts the rows as the last one below it that has rows does, so only bins with rows are tried, and a column's first.
    """
    whole, known = sums[:, :, -1], sums[:, :, :-1]
    cells, first = layout.open(allowed)
    node, cell = np.nonzero(((known[2] > 0) & cells) | first)
    if not len(node):
        return np.zeros(0, np.int64), *[np.zeros(0)] * 3, np.zeros(0, bool), *[np.zeros((0, 3))] * 2
    column, run = layout.column[cell], np.cumsum(known, axis=2)
    missing = whole[:, :, None] - (run[:, :, layout.end - 1] - run[:, :, layout.start])
    missing[:2, missing[2] < 0.5] = 0
    without = run[:, node, cell] - run[:, node, layout.start[column]]
    # [which, node and cell, missing low or high]
    low = np.stack((without + missing[:, node, column], without), axis=2)
    high = whole[:, node, None] - low
    gain = score(low[0], low[1], s) + score(high[0], high[1], s) - score(whole[0], whole[1], s)[node, None]
    fits = (low[2] > 0.5) & (high[2] > 0.5) & (low[1] >= s.child) & (high[1] >= s.child)
    gain = np.where(fits, gain, -np.inf).ravel()
    own, begin = np.unique(node, return_index=True)
    top = np.maximum.reduceat(gain, 2 * begin)
    # the first of a node's largest
    at = np.flatnonzero(gain == np.repeat(top, np.diff(2 * begin, append=len(gain))))
    at = at[np.unique(node[at // 2], return_index=True)[1]][top > LEAST_GAIN]
    pair, side = np.divmod(at, 2)
    column = column[pair]
    return own[top > LEAST_GAIN], gain[at], column, cell[pair] - layout.start[column], side == 0, low[:, pair, side].T, high[:, pair, side].T


def grow(bins: np.ndarray, cells: np.ndarray, g: np.ndarray, h: np.ndarray, s: Settings, layout: Layout, tree_no: int, level: int = 0) -> Tree:
    """A whole tree, or the part below a node of some level, on rows in memory; a bounded number of nodes at a time."""
    tree, step = Tree(), max(1, CELLS // (layout.total + 1))
    tree.leaf(float(weight(g.sum(), h.sum(), s)))
    # rows of nodes that may be split, by their place in the front
    rows, place, front = np.arange(len(bins)), np.zeros(len(bins), np.int64), np.zeros(1, np.int64)
    while len(front) and level < s.depth:
        allowed, parts = columns_of(tree_no, level, layout.columns, s), []
        for first in range(0, len(front), step):
            some = slice(*np.searchsorted(place, (first, first + step)))
            own = rows[some]
            sums = histograms(place[some] - first, cells[own], g[own], h[own], min(step, len(front) - first), layout)
            node, *found = best_splits(sums, allowed, s, layout)
            parts.append((node + first, *found))
        node, gain, column, bound, missing_low, low, high = (np.concatenate(x) for x in zip(*parts))
        after = tree.split_all(front[node], column, bound, missing_low, gain, weight(low[:, 0], low[:, 1], s), weight(high[:, 0], high[:, 1], s))
        rank = np.full(len(front), -1)
        rank[node] = np.arange(len(node))
        at = rank[place]
        rows, at = rows[at >= 0], at[at >= 0]
        value = bins[rows, column[at].astype(np.int64)]
        place = 2 * at + ~np.where(value == 0, missing_low[at], value <= bound[at])
        # a single row is not split
        several = np.bincount(place, minlength=len(after)) > 1
        kept = several[place]
        rows, place, front = rows[kept], (np.cumsum(several) - 1)[place[kept]], after[several]
        order = np.argsort(place, kind="stable")
        rows, place, level = rows[order], place[order], level + 1
    return tree


def grow_all(keys: Sequence, y: np.ndarray, bins: np.ndarray, base: float, s: Settings, layout: Layout) -> Iterator[tuple[int, Tree]]:
    """Number and tree, one after another, on rows in memory."""
    cells, margin = layout.cells(bins), np.full(len(y), base)
    for number in range(s.trees):
        own = np.flatnonzero(drawn(keys, number, s))
        if not len(own):
            continue
        g, h = derivatives(margin[own], y[own], s)
        tree = grow(bins[own], cells[own], g, h, s, layout, number)
        tree.prune(s.gamma)
        tree = tree.packed()
        margin += s.step * tree.value[route(tree.arrays(), bins)]
        yield number, tree


def drawn(keys: Sequence, number: int, s: Settings) -> np.ndarray:
    """Which rows a tree is grown on: the draws of :func:`fit`'s filter on keys in memory, as bytes of their text; null is empty."""
    if s.subsample >= 1:
        return np.ones(len(keys), bool)
    salt, least = f"{s.salt}|{number}", bytes.fromhex(threshold(s.subsample))
    ends = {False: f"|{salt}".encode(), True: salt.encode()}
    return np.fromiter((hashlib.md5(k + ends[not k]).digest()[:4] < least for k in keys), bool, len(keys))


def cuts_of(df: DataFrame, columns: Sequence[str], missing: float = 0.0) -> list[np.ndarray]:
    """Upper bounds of all bins but the last, per column; missing values have no part in them."""
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    long = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("at", "x")).where((F.col("x") != missing) & ~F.isnan("x"))
    found = {r["at"]: r["cuts"] for r in long.groupBy("at").agg(F.percentile_approx("x", steps, 10_000).alias("cuts")).collect()}
    return [np.unique(np.array(found.get(i, []), np.float64)) for i in range(len(columns))]


def binned(df: DataFrame, key: str, label: str, columns: Sequence[str], cuts: Sequence[np.ndarray], keep: Sequence[str] = (), missing: float = 0.0) -> DataFrame:
    """``keep``, key, y and one byte per column: 0 for missing, else 1 and how many cuts lie below the value."""
    rows = df.select(*keep, F.col(key).cast("bigint").alias("key"), F.col(label).cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    schema = rows.drop("x").schema.add("bins", "binary")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            out = np.stack([1 + np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros(x.shape)
            out = np.where(np.isnan(x) | (x == missing), 0, out).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in out], pa.binary())], names=[*batch.schema.names[:-1], "bins"])

    return rows.mapInArrow(code, schema)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _frame(arrays: Sequence[np.ndarray], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=list(names))


@dataclass
class Model:
    columns: list[str]
    cuts: list[np.ndarray]
    settings: Settings
    base: float
    trees: list[Tree] = field(default_factory=list)

    def steps(self) -> list[tuple]:
        """Each tree as arrays, and what its nodes add to the margin."""
        return [(tree.arrays(), self.settings.step * np.asarray(tree.value)) for tree in self.trees]

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return margins(self.base, self.steps(), bins)


def margins(base: float, steps: Sequence[tuple], bins: np.ndarray) -> np.ndarray:
    out = np.full(len(bins), base)
    for arrays, step in steps:
        out += step[route(arrays, bins)]
    return out


def fit(df: DataFrame, key: str, label: str, columns: Sequence[str], settings: Settings, *, missing: float = 0.0, local: int | None = None) -> Model:
    """Fit on the rows of ``df`` that have a label; the start is the mean label (its log odds for classes).

    Tables of at most ``WHOLE`` values are fitted where their rows meet, all trees in one group; ``local`` puts that bound, and that of
    a node's rows, at so many rows.
    """
    known = df.where(F.col(label).isNotNull())
    cuts = cuts_of(known, columns, missing)
    rows = materialize(binned(known, key, label, columns, cuts, missing=missing), "binned")
    count, mean = rows.agg(F.count("*"), F.avg("y")).first()
    base = 0.0 if not count else mean if not settings.logistic else float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6))))
    model = Model(list(columns), cuts, settings, float(base))
    if not count:
        return model
    layout = Layout(cuts)
    if count <= (WHOLE // max(len(cuts), 1) if local is None else local):
        model.trees += _whole_trees(rows, layout, float(base), settings)
        superseded(rows)
        return model
    state = rows.withColumn("margin", F.lit(float(base)))
    for number in range(settings.trees):
        some = state if settings.subsample >= 1 else state.where(below(word(F.col("key"), f"{settings.salt}|{number}"), settings.subsample))
        tree = _one_tree(some, layout, settings, number, LOCAL if local is None else local)
        if tree is None:
            continue
        model.trees.append(tree.packed())
        if number + 1 < settings.trees:
            after = materialize(_advance(state, tree, len(cuts), settings), "margins")
            superseded(state)
            state = after
    return model


def _whole_trees(rows: DataFrame, layout: Layout, base: float, s: Settings) -> Iterator[Tree]:
    """All trees, grown by one task that reads every row and hands on each tree as it is done."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema)
        table = table.sort_by([(c, "ascending") for c in ("key", "y", "bins")])
        keys = [b"" if k is None else str(k).encode() for k in table.column("key").to_pylist()]
        y, bins = table.column("y").to_numpy(), _matrix(table.column("bins"), layout.columns)
        del table
        for number, tree in grow_all(keys, y, bins, base, s, layout):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in vars(tree).values()]], names=["number", *KINDS])

    schema = pa.schema([("key", pa.int64()), ("y", pa.float64()), ("bins", pa.binary())])
    found = materialize(rows.select(schema.names).coalesce(1).mapInArrow(run, "number bigint, " + ", ".join(f"{n} binary" for n in KINDS)), "trees")
    # a few at a time: together they may be larger than what a driver takes at once
    for first in range(0, s.trees, 10):
        for row in found.where(F.col("number").between(first, first + 9)).orderBy("number").collect():
            yield Tree(**{n: np.frombuffer(row[n], kind) for n, kind in KINDS.items()})
    superseded(found)


def _one_tree(rows: DataFrame, layout: Layout, s: Settings, number: int, local: int) -> Tree | None:
    """Levels of large nodes by summed histograms, then every small node to its end in one group."""
    tree, waiting, level = Tree(), [], 0
    count, g, h = _totals(rows, s)
    if not count:
        return None
    front = {tree.leaf(float(weight(g, h, s))): count}
    while front:
        waiting += [(node, level) for node, n in front.items() if n <= local]
        large = [node for node, n in front.items() if n > local]
        front = {}
        if not large or level >= s.depth:
            break
        for node, gain, column, bound, missing_low, low, high in _large_splits(rows, tree, large, layout, s, columns_of(number, level, layout.columns, s)):
            a, b = tree.split(node, column, bound, missing_low, gain, float(weight(low[0], low[1], s)), float(weight(high[0], high[1], s)))
            front |= {a: int(low[2]), b: int(high[2])}
        level += 1
    _graft(tree, _small_trees(rows, tree, dict(waiting), layout, s, number))
    tree.prune(s.gamma)
    return tree


def _gradients(batch, s: Settings):
    return derivatives(batch.column("margin").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False), s)


def _totals(rows: DataFrame, s: Settings) -> tuple[int, float, float]:
    p = 1 / (1 + F.exp(-F.col("margin")))
    g, h = (p - F.col("y"), p * (1 - p)) if s.logistic else (F.col("margin") - F.col("y"), F.lit(1.0))
    return rows.agg(F.count("*"), F.coalesce(F.sum(g), F.lit(0.0)), F.coalesce(F.sum(h), F.lit(0.0))).first()


def _large_splits(rows: DataFrame, tree: Tree, nodes: list[int], layout: Layout, s: Settings, allowed: np.ndarray):
    place = np.full(len(tree.value), -1)
    place[nodes] = np.arange(len(nodes))
    step, arrays = max(1, CELLS // (layout.total + 1)), tree.arrays()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, (g, h) = _matrix(batch.column("bins"), layout.columns), _gradients(batch, s)
            at = place[route(arrays, bins)]
            here = at >= 0
            bins, g, h = bins[here], g[here], h[here]
            own, at = np.unique(at[here], return_inverse=True)
            cells = layout.cells(bins)
            for first in range(0, len(own), step):
                here = (at >= first) & (at < first + step)
                sums = histograms(at[here] - first, cells[here], g[here], h[here], min(step, len(own) - first), layout)
                i, cell = np.nonzero(sums[2])
                yield _frame([own[first + i], cell, *sums[:, i, cell]], ("node", "cell", "g", "h", "n"))

    def choose(cells: pa.Table) -> pa.Table:
        sums = np.zeros((3, 1, layout.total + 1))
        for k, c in enumerate("ghn"):
            sums[k, 0, cells.column("cell").to_numpy()] = cells.column(c).to_numpy()
        found = best_splits(sums, allowed, s, layout)[1:]
        if not len(found[0]):
            return pa.table({n: pa.array([], t) for n, t in (("node", pa.int64()), ("found", pa.list_(pa.float64())))})
        return pa.table({"node": cells.column("node")[:1], "found": [np.concatenate([x[:1].ravel() for x in found]).astype(float).tolist()]})

    parts = rows.mapInArrow(add_up, "node bigint, cell bigint, g double, h double, n double")
    summed = parts.groupBy("node", "cell").agg(*[F.sum(c).alias(c) for c in "ghn"])
    for row in summed.groupBy("node").applyInArrow(choose, "node bigint, found array<double>").orderBy("node").collect():
        f = row["found"]
        yield nodes[row["node"]], f[0], int(f[1]), int(f[2]), bool(f[3]), f[4:7], f[7:10]


def _small_trees(rows: DataFrame, tree: Tree, levels: dict[int, int], layout: Layout, s: Settings, number: int):
    """(node, the tree below it) for each waiting node."""
    if not levels:
        return []
    names, arrays, wanted = ("node", *vars(Tree())), tree.arrays(), np.zeros(len(tree.value), bool)
    wanted[list(levels)] = True

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, (g, h) = _matrix(batch.column("bins"), layout.columns), _gradients(batch, s)
            at = route(arrays, bins)
            inside = wanted[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[inside]), batch.column("key").filter(pa.array(inside)), batch.column("bins").filter(pa.array(inside)), pa.array(g[inside]), pa.array(h[inside])],
                names=["node", "key", "bins", "g", "h"])

    def finish(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        node = group.column("node")[0].as_py()
        bins = _matrix(group.column("bins"), layout.columns)
        grown = grow(bins, layout.cells(bins), group.column("g").to_numpy(), group.column("h").to_numpy(), s, layout, number, levels[node])
        return pa.table({"node": [node], **{n: [list(map(float, x))] for n, x in vars(grown).items()}})

    dealt = rows.mapInArrow(deal, "node bigint, key bigint, bins binary, g double, h double")
    schema = "node bigint, " + ", ".join(f"{n} array<double>" for n in names[1:])
    return [(r["node"], r) for r in dealt.groupBy("node").applyInArrow(finish, schema).orderBy("node").collect()]


def _graft(tree: Tree, grown) -> None:
    """Hang each subtree on its node: its root takes the node's place, the others follow in order."""
    for node, part in grown:
        shift = len(tree.value) - 1
        move = lambda i, node=node, shift=shift: node if i == 0 else int(i) + shift
        for i in range(1, len(part["value"])):
            tree.leaf(part["value"][i])
        for i, feature in enumerate(part["feature"]):
            at = move(i)
            tree.value[at] = part["value"][i]
            if feature >= 0:
                tree.feature[at], tree.bound[at], tree.missing_low[at] = int(feature), int(part["bound"][i]), bool(part["missing_low"][i])
                tree.low[at], tree.high[at], tree.gain[at] = move(part["low"][i]), move(part["high"][i]), part["gain"][i]


def _advance(state: DataFrame, tree: Tree, width: int, s: Settings) -> DataFrame:
    arrays, steps = tree.arrays(), s.step * np.array(tree.value)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = batch.column("margin").to_numpy(zero_copy_only=False) + steps[route(arrays, _matrix(batch.column("bins"), width))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "y", "bins")), pa.array(margin)], names=["key", "y", "bins", "margin"])

    return state.select("key", "y", "bins", "margin").mapInArrow(add, ROWS)


def predict(model: Model, df: DataFrame, key: str, label: str, keep: Sequence[str] = (), missing: float = 0.0) -> DataFrame:
    """``keep``, key, y and ``prediction``: the probability of class 1, or the predicted value."""
    rows = binned(df, key, label, model.columns, model.cuts, keep, missing)
    # arrays alone are sent: unlike the classes, executors read them without this package
    shared, base, width, logistic = df.sparkSession.sparkContext.broadcast(model.steps()), model.base, len(model.cuts), model.settings.logistic
    names = [*keep, "key", "y"]
    schema = rows.select(*names).schema.add("prediction", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = margins(base, shared.value, _matrix(batch.column("bins"), width))
            out = 1 / (1 + np.exp(-margin)) if logistic else margin
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out)], names=[*names, "prediction"])

    return rows.mapInArrow(run, schema)


def importance(model: Model) -> list[tuple[str, float]]:
    """Mean gain of each column's splits, for columns that split."""
    gains: dict[int, list[float]] = {}
    for tree in model.trees:
        for feature, gain in zip(tree.feature, tree.gain):
            if feature >= 0:
                gains.setdefault(feature, []).append(gain)
    return sorted(((model.columns[f], sum(x) / len(x)) for f, x in gains.items()), key=lambda r: (-r[1], r[0]))
