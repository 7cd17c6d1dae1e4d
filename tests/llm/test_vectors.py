"""Block matrix neighbours and shared-list negatives against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import negatives, neighbours, vectors
from cohortlake.llm.store import stage


def table_of(spark):
    """Copies, repeated rows, repeated ids, near copies, rows that take no part, and clashing columns."""
    draw = np.random.default_rng(3)
    base = draw.normal(size=(90, 24)).astype(np.float32).tolist()
    rows = [(i, base[i % 90] if i % 3 else base[0], i % 4, 1.0) for i in range(400)]
    rows += [(400 + i, (np.array(base[5]) + draw.normal(size=24) * 1e-4).astype(np.float32).tolist(), i % 3, 1.0) for i in range(150)]
    rows += [(7, base[7], 3, 2.0)] * 3 + [(20, base[8], 1, 0.0), (40, base[9], 2, 0.0), (40, base[4], 2, 0.0), (41, base[0], 2, 0.0)]
    rows += [
        (1000, None, 1, 1.0), (1050, [None, *base[1][1:]], 1, 1.0), (1100, [float("nan")] * 24, 1, 1.0), (1150, [float("inf")] * 24, 1, 1.0),
        (None, base[2], 1, 1.0), (1200, [], 1, 1.0), (1250, [3.0], 1, 1.0), (1300, [0.0] * 24, 2, 1.0), (1350, base[3], None, 1.0),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score double")
    return df.withColumn("rank", F.lit(9)).withColumn("v", F.lit("x")).withColumn("cluster", F.lit(1)), rows


def sound(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def padded(v):
    return tuple(float(np.float32(x)) for x in v) + (0.0,) * (24 - len(v))


def brute_nearest(rows, k):
    kept = sorted({(i, padded(v)) for i, v, *_ in rows if i is not None and sound(v) and any(v)})
    asked = {}
    for i, v in kept:
        if i % 20 == 0:
            asked.setdefault(i, v)
    out = []
    for q, v in asked.items():
        scored = []
        for i, w in kept:
            if i != q:
                total = 0.0
                for a, b in zip(v, w):
                    total += a * b
                scored.append((-total, i))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 20, 700])
def test_neighbours(spark, k, monkeypatch):
    df, rows = table_of(spark)
    df = stage(df.repartition(3), "vectors")
    want = brute_nearest(rows, k)
    assert sorted(map(tuple, neighbours.search(df, F.col("vec_id") % 20 == 0, k=k).collect())) == want
    monkeypatch.setattr(vectors, "ROWS", 64)
    assert sorted(map(tuple, neighbours.search(df, F.col("vec_id") % 20 == 0, k=k).collect())) == want


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, -2.5])], "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, neighbours.search(df, F.col("vec_id") % 20 == 0).collect())) == [(0, 1, 20, -4.0), (20, 1, 0, -4.0)]
    assert neighbours.search(df.where("false"), F.lit(True)).count() == 0
    assert neighbours.search(df, F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("size", [1.0, 1e-30, 1e120])
def test_bounds_leave_the_best(size):
    draw = np.random.default_rng(4)
    q, x = draw.normal(size=(30, 1500)) * size, draw.normal(size=(9000, 1500))
    x[4000:] *= np.exp(draw.normal(size=5000))[:, None]
    i, j, score, recomputed = neighbours.nearest(q, np.arange(30), x, np.arange(9000) + 100, 20)
    whole = q @ x.T
    for n in range(30):
        assert set(j[i == n]) == set(np.argsort(-whole[n])[:20])
    # at this width the bounds are wide: a tenth of all pairs is left
    assert recomputed < 0.15 * whole.size


def test_matrix_pads():
    lists = pa.chunked_array([pa.array([[1.0, 2.0], []]), pa.array([[3.0]])])
    assert vectors.matrix(lists).tolist() == [[1, 2], [0, 0], [3, 0]]


def brute_negatives(rows, positives=5, wanted=3, low=50, high=95):
    kept = sorted({(i, l, tuple(int(np.floor(x * 256)) for x in padded(v))) for i, v, l, _ in rows if i is not None and l is not None and sound(v)})
    anchors = {}
    for i, l, v in kept:
        if i % 50 == 0:
            anchors.setdefault(i, (l, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in kept if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x[:2] for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:wanted]
            out += [(a, p, n, i, -s, -t) for n, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def test_negatives(spark, monkeypatch):
    df, rows = table_of(spark)
    df = stage(df.repartition(3), "vectors")
    want = brute_negatives(rows)
    assert len(want) > 100
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 50 == 0).collect())) == want
    monkeypatch.setattr(vectors, "ROWS", 64)
    again = negatives.mine(df, F.col("vec_id") % 50 == 0, members=2)
    assert sorted(map(tuple, again.collect())) == want


def test_negatives_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.96], 2), (50, [2.0], 7)], "vec_id bigint, embedding array<double>, label int")
    got = negatives.mine(df, F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 32768)]
    assert negatives.mine(df.where("false"), F.lit(True)).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0


def test_lists_stop_early_and_lose_nothing():
    """Tight clusters: members look at a small part of the list and find what a whole look finds."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 32))
    rows = np.floor(256 * (centres[np.arange(8000) % 40] + 0.05 * draw.normal(size=(8000, 32)))).astype(np.int64)
    labels = draw.integers(0, 3, 8000)
    a = np.arange(0, 8000, 400)
    shared = negatives.Shared(rows[a], rows, np.arange(8000), labels, negatives.unit(rows[a].sum(axis=0, keepdims=True))[0])
    best = negatives.closest(shared, rows[a], a, labels[a], 5)
    assert shared.looked < 0.2 * len(a) * 8000
    whole = rows[a] @ rows.T
    for n, i in enumerate(a):
        order = [j for j in np.lexsort((np.arange(8000), -whole[n])) if labels[j] == labels[i] and j != i][:5]
        assert list(best.ids[best.group == n]) == order
    positive = best.score[np.argsort(best.group, kind="stable")].reshape(len(a), 5)
    shared.looked = 0
    hard = negatives.hardest(shared, rows[a], labels[a], positive, 3, 50, 95)
    assert shared.looked < 0.3 * len(a) * 8000
    for g in range(len(a) * 5):
        n, p = g // 5, positive[g // 5, g % 5]
        order = [j for j in np.lexsort((np.arange(8000), -whole[n])) if labels[j] != labels[a[n]] and 50 * p <= 100 * whole[n, j] <= 95 * p][:3]
        assert list(hard.ids[hard.group == g]) == order


def test_clusters_share_blocks():
    dealt, blocks = negatives.packed({0: 5, 1: 40, 2: 3, 3: 2, 4: 9}, 10)
    assert blocks == 6 and dealt[1] == (2, 4) and dealt[3] == dealt[2] == dealt[0] == (0, 1) and dealt[4] == (1, 1)
    assert negatives.packed({}, 10) == ({}, 0)
