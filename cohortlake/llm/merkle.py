"""A Merkle manifest of a dataset: one tree per source, one over the sources, a proof for every row, by butterfly exchange.

H is lowercase hex SHA-256 over concatenated inputs, digests as hex text. A leaf is H of the row's fields in the order given,
each ``-`` if null, else its UTF-8 byte count, ``:`` and its value (``field``). In each group leaves ascend by id (nulls first, then
by leaf); while several nodes remain, every ``fanout`` consecutive ones become their H, the last run also if it holds fewer, even
one. What remains is the group's subroot; the subroots in order of their groups (null first, UTF-8 bytewise) make the
root in the same way. A row's proof is the siblings of its runs, level by level, via the subroot to the root.

Order. Rows of (id, group, leaf) are range-partitioned and sorted; a number that grows along each partition, and the counts of
each group in each partition, give every leaf its place in its group without any task holding a group.

Blocks. ``fanout ** levels`` consecutive leaves are a block; a task hashes a block up to its root. Then come exchange rounds. Before
round r each block knows the root of its subtree of fanout ** r blocks and the siblings on the way there, as do all other blocks of
that subtree. In the round it sends that root to the blocks at its own place in the subtrees of the same run (where the last
subtree is short, its blocks serve several places each), hashes what it gets to the next ancestor, as all of them do,
and adds the siblings to its proof. After the last round every block holds the subroot and its upper proof, and no pass down the
tree is needed. Each round is one shuffle of (block, subtree, digest) and a written table. The tree over the groups is
built by the same functions, so the number of groups may be as large as that of the rows.

Repeated rows are leaves of their own. An empty table has no leaves, no root and no result rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.store import drop, stage

FANOUT, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 64


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``seat`` and ``spot`` (partition and running number), and for each group in each partition (group, seat) its first
    spot ``low``, how many rows of the group came in earlier partitions ``before``, and how many it has, ``size``.

    Equal rows are told apart by their place in the input, so that range partitioning can cut between them.
    """
    numbered = rows.withColumn("copy", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "copy")]
    ordered = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("copy")
    spot = F.monotonically_increasing_id()
    ordered = stage(ordered.withColumn("spot", spot).withColumn("seat", F.shiftright("spot", 33)), "ordered")
    counts = ordered.groupBy(group, "seat").agg(F.min("spot").alias("low"), F.count("*").alias("n"))
    so_far = Window.partitionBy(group).orderBy("seat")
    before = F.sum("n").over(so_far) - F.col("n")
    return ordered, counts.select(group, "seat", "low", before.alias("before"), F.sum("n").over(Window.partitionBy(group)).alias("size"))


def lift(nodes: list[str], fanout: int, levels: int, whole: bool) -> list[list[str]]:
    """The levels of nodes above a block, itself included: up to one node if the block is the whole tree, else ``levels`` of them."""
    rows = [nodes]
    while (len(rows[-1]) > 1) if whole else (len(rows) <= levels):
        last = rows[-1]
        rows.append([hashed("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return rows


def below(rows: list[list[str]], at: int, fanout: int) -> str:
    """The siblings of node ``at`` within its block, level by level."""
    out = []
    for nodes in rows[:-1]:
        start = at - at % fanout
        out += [n for i, n in enumerate(nodes[start : start + fanout], start) if i != at]
        at //= fanout
    return "".join(out)


def fold(digest: str, at: int, size: int, siblings: str, fanout: int) -> tuple[str, str]:
    """The root that a node at place ``at`` of ``size`` and its siblings give, and the siblings left over."""
    while size > 1:
        start = at - at % fanout
        ahead, others = at - start, min(fanout, size - start) - 1
        own, siblings = siblings[: others * DIGEST], siblings[others * DIGEST :]
        digest = hashed(own[: ahead * DIGEST] + digest + own[ahead * DIGEST :])
        at, size = at // fanout, -(-size // fanout)
    return digest, siblings


def blocks_of(batches: Iterator[pa.RecordBatch], fields: Sequence[str]) -> Iterator[list[tuple]]:
    """Rows of each (tree, block), for batches that are sorted by it and start with these two columns; a block is bounded."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(f)).to_pylist() for f in fields)):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def block_roots(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, block, size, digest) of the blocks of ``nodes`` (tree, block, place, size, digest); size is the tree's leaves."""

    def climb(batches):
        out = []
        for rows in blocks_of(batches, ("tree", "block", "size", "digest")):
            tree, block, size, _ = rows[0]
            out.append((tree, block, size, lift([r[3] for r in rows], fanout, levels, size <= fanout**levels)[-1][0]))
            if len(out) >= 1 << 14:
                yield _batch(out, ("tree", "block", "size", "digest"))
                out = []
        yield _batch(out, ("tree", "block", "size", "digest"))

    dealt = nodes.select("tree", "block", "place", "size", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    return dealt.mapInArrow(climb, "tree bigint, block bigint, size bigint, digest string")


def exchange(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, block, size, digest, upper) after all rounds: each block holds its tree's root and the siblings above itself."""
    span = fanout**levels
    state = stage(blocks.select("tree", "block", "size", F.ceil(F.col("size") / span).cast("bigint").alias("blocks"), "digest", F.lit("").alias("upper")), "blocks")
    most = state.agg(F.max("blocks")).first()[0] or 0
    width = 1
    while width < most:
        after = stage(_round(state, fanout, width), "blocks")
        drop(state)
        state, width = after, width * fanout
    return state.drop("blocks")


def _round(state: DataFrame, fanout: int, width: int) -> DataFrame:
    """One exchange: subtrees of ``width`` blocks meet in runs of ``fanout``."""
    whole = lambda x: F.floor(x).cast("bigint")
    subtree, place = whole(F.col("block") / width), F.col("block") % width
    length = lambda s: F.least(F.lit(width).cast("bigint"), F.col("blocks") - s * width)
    first = subtree - subtree % fanout
    last = F.least(first + fanout - 1, whole((F.col("blocks") - 1) / width))
    sent = state.where(F.col("blocks") > width).select("*", subtree.alias("subtree"), place.alias("at"), length(subtree).alias("own"), F.explode(F.sequence(first, last)).alias("to"))
    # the blocks of a longer subtree beyond this one's length are served by its blocks in turn
    reach = length(F.col("to")) - 1
    sent = sent.where(F.col("at") <= reach).withColumn("target", F.explode(F.sequence(F.col("at"), reach, F.col("own")))).withColumn("target", F.col("to") * width + F.col("target"))
    mine = F.col("target") == F.col("block")
    kept = F.max(F.when(mine, F.struct("size", "blocks", "upper", "subtree")))
    got = F.sort_array(F.collect_list(F.struct("subtree", "digest")))
    met = sent.groupBy("tree", "target").agg(kept.alias("kept"), got.alias("got"))
    others = F.filter("got", lambda x: x["subtree"] != F.col("kept.subtree"))
    joined = lambda nodes: F.array_join(F.transform(nodes, lambda x: x["digest"]), "")
    after = met.select(
        "tree", F.col("target").alias("block"), "kept.size", "kept.blocks", F.sha2(joined("got"), 256).alias("digest"),
        F.concat("kept.upper", joined(others)).alias("upper"),
    )
    return state.where(F.col("blocks") <= width).unionByName(after)


def with_states(nodes: DataFrame, states: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Leaves and, ahead of the leaves of each block, the block's state, dealt and sorted by block."""
    columns = ["tree", "block", "place", "size", "digest", *extra, "upper"]
    null = lambda c, like: F.lit(None).cast(like.schema[c].dataType).alias(c)
    ahead = states.select(*[F.lit(-1).cast("bigint").alias(c) if c == "place" else F.col(c) if c in states.columns else null(c, nodes) for c in columns])
    rows = nodes.select(*[F.col(c) if c in nodes.columns else null(c, states) for c in columns])
    return ahead.unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def in_blocks(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``rows`` (tree, at, size, digest, ...) with their block and place in it."""
    span = fanout**levels
    return rows.withColumn("block", F.floor(F.col("at") / span).cast("bigint")).withColumn("place", F.col("at") % span)


def _batch(rows: list[tuple], names: Sequence[str], numbers: Sequence[str] = ("tree", "block", "size", "doc_id")) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    kinds = [pa.int64() if n in numbers else pa.bool_() if n == "verified" else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def top_tree(subroots: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, digest, siblings, groups, root) for the groups' subroots (tree = place of the group, digest)."""
    groups = subroots.count()
    nodes = in_blocks(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.lit(groups).cast("bigint").alias("size"), "digest"), fanout, levels)
    states = exchange(block_roots(nodes, fanout, levels), fanout, levels)

    def follow(batches):
        names = ("tree", "block", "place", "size", "digest", "upper")
        for rows in blocks_of(batches, names):
            (_, block, _, size, root, upper), nodes = rows[0], [r[4] for r in rows[1:]]
            up = lift(nodes, fanout, levels, size <= fanout**levels)
            start = block * fanout**levels
            yield _batch([(start + i, n, below(up, i, fanout) + upper, size, root) for i, n in enumerate(nodes)], ("tree", "digest", "siblings", "size", "root"))

    return with_states(nodes, states, ()).mapInArrow(follow, "tree bigint, digest string, siblings string, size bigint, root string").withColumnRenamed("size", "groups")


def manifest(
    docs: DataFrame, *, doc_id: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None,
    fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    ``changed`` gives fields the values they are verified with; the tree is that of the fields as they are. ``folded_root`` is what the
    changed leaf and the original siblings give.
    """
    told = changed or {}
    rows = stage(docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(group).cast("string").alias("source"),
        leaf([F.col(c) for c in fields]).alias("digest"), leaf([told.get(c, F.col(c)) for c in fields]).alias("told"),
    ), "leaves")
    ordered, parts = placed(rows, "source", ("doc_id", "digest"))
    parts = stage(parts, "parts")
    # the groups in order, numbered the same way
    names, ranges = placed(parts.select("source").distinct().withColumn("one", F.lit(0)), "one", ("source",))
    tree = F.col("spot") - F.col("low") + F.col("before")
    numbered = stage(names.join(ranges, ["one", "seat"]).select(F.col("source").alias("name"), tree.alias("tree")), "groups")
    parts = stage(parts.join(numbered, F.col("source").eqNullSafe(F.col("name"))).select(
        F.col("seat").alias("of"), F.col("source").alias("name"), "tree", "low", "before", "size"), "parts")
    at = ordered.join(parts, (F.col("seat") == F.col("of")) & F.col("source").eqNullSafe(F.col("name"))).select(
        "tree", (F.col("spot") - F.col("low") + F.col("before")).alias("at"), "size", "doc_id", "digest", "told")
    nodes = stage(in_blocks(at, fanout, levels), "nodes")
    drop(rows, ordered)
    states = stage(exchange(block_roots(nodes, fanout, levels), fanout, levels), "states")
    top = stage(top_tree(states.where("block = 0").select("tree", "digest"), fanout, levels), "top")
    states = states.join(top.drop("digest"), "tree")

    def follow(batches):
        names = ("tree", "block", "place", "size", "digest", "upper", "siblings", "groups", "root", "doc_id", "told")
        out = []
        for rows in blocks_of(batches, names):
            tree, block, _, size, subroot, upper, above, groups, root, *_ = rows[0]
            nodes = [r[4] for r in rows[1:]]
            up = lift(nodes, fanout, levels, size <= fanout**levels)
            start = block * fanout**levels
            for i, r in enumerate(rows[1:]):
                siblings = below(up, i, fanout) + upper + above
                mine, rest = fold(r[10], start + i, size, siblings, fanout)
                mine, _ = fold(mine, tree, groups, rest, fanout)
                out.append((r[9], r[4], subroot, root, hashed(siblings), mine, mine == root))
            if len(out) >= 1 << 13:
                yield _batch(out, RESULT)
                out = []
        yield _batch(out, RESULT)

    joined = with_states(nodes.withColumns({c: F.lit(None).cast(top.schema[c].dataType) for c in ("siblings", "groups", "root")}), states, ("siblings", "groups", "root", "doc_id", "told"))
    return joined.mapInArrow(follow, ", ".join(f"{n} {'bigint' if n == 'doc_id' else 'boolean' if n == 'verified' else 'string'}" for n in RESULT))


RESULT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
