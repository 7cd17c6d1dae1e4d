"""The Merkle manifest against plain code."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cohortlake.llm import merkle, queries
from cohortlake.llm.store import stage


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, fanout):
    """Root, and for each leaf the runs it is in: (its place in the run, the run)."""
    runs, nodes, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            start = a - a % fanout
            runs[i].append((a - start, nodes[start : start + fanout]))
            at[i] = a // fanout
        nodes = [h("".join(nodes[j : j + fanout])) for j in range(0, len(nodes), fanout)]
    return nodes[0], runs


def brute(rows, fanout=3):
    """rows of (doc_id, source, lang, n_chars, text)."""
    def leaf(r, text):
        return h("".join(map(field, (*r[:4], text))))

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        mine = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees.append((mine, *tree([leaf(r, r[4]) for r in mine], fanout)))
    if not trees:
        return []
    root, upper = tree([t[1] for t in trees], fanout)
    out = []
    for (mine, subroot, runs), above in zip(trees, upper):
        for r, own in zip(mine, runs):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            digest = leaf(r, r[4].replace("\n", "") if cut else r[4])
            for i, run in own + above:
                digest = h("".join([*run[:i], digest, *run[i + 1 :]]))
            proof = "".join(n for i, run in own + above for j, n in enumerate(run) if j != i)
            out.append((r[0], leaf(r, r[4]), subroot, root, h(proof), digest, digest == root))
    return sorted(out, key=str)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string")


def rows_of(counts):
    rows, i = [], 0
    for s, n in counts.items():
        for _ in range(n):
            i += 1
            rows.append((i * 37 % 1009 - 100, s, ["en", None, "dé"][i % 3], i % 5 or None, [None, "", "a\nb", "ü\n\n", "plain"][i % 5]))
    return rows


EDGES = [(None, "a", None, None, None)] * 2 + [(None, None, "x", 1, "y\n")] * 5 + [(5, "a", "x", 1, "y\n")] * 30 + [(5, "a", "x", 1, "other")]


MANY = {"a": 100, "b": 1, "": 2, "Z": 27, "é": 28, None: 9}


@pytest.mark.parametrize("counts, fanout, levels", [
    ({"a": 1}, 3, 7), ({"a": 3, None: 4}, 3, 1), (MANY, 3, 1), (MANY, 3, 7), (MANY, 2, 2), ({f"s{i}": 1 + i % 4 for i in range(40)}, 3, 1),
])
def test_manifest(spark, counts, fanout, levels):
    rows = rows_of(counts) + (EDGES if None in counts else [])
    df = documents(spark, rows).repartition(5).withColumn("root", F.lit("x")).withColumn("block", F.lit(1)).withColumn("digest", F.lit(1))
    got = merkle.manifest(stage(df, "docs"), changed=queries.without_breaks(), fanout=fanout, levels=levels)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, fanout)


def test_no_rows(spark):
    assert merkle.manifest(documents(spark, [])).collect() == []


@pytest.mark.parametrize("blocks", [2, 4, 9, 10, 19, 28])
def test_every_block_gets_its_proof(spark, blocks):
    """Blocks of one leaf: all of the tree comes from the exchange."""
    leaves = [h(str(i)) for i in range(blocks)]
    state = spark.createDataFrame([(0, i, blocks, d) for i, d in enumerate(leaves)], "tree bigint, block bigint, size bigint, digest string")
    root, runs = tree(leaves, 3)
    got = {r["block"]: (r["digest"], r["upper"]) for r in merkle.exchange(state, 3, 0).collect()}
    assert got == {i: (root, "".join(n for a, run in own for j, n in enumerate(run) if j != a)) for i, own in enumerate(runs)}


def test_query_against_plain_code(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = sorted(map(tuple, queries.QUERIES["op12_butterfly_merkle"](spark, folder).collect()), key=str)
    assert got == brute(list(map(tuple, docs))) and not all(r[-1] for r in got)
