"""Removal of long word sequences that an earlier document has too, found by recompression.

Recompression rewrites every text in rounds that alternate two steps. One replaces a short run
of one symbol by a name; the other replaces a pair of neighbours, the first from one half of the
alphabet and the second from the other, by a name. A name is a hash of what it
stands for, and the half is a bit of it, so names are global without a dictionary: the same
symbols get the same name in every text, task and retry. Symbols never grow beyond the cap of
their round, and a step looks no further than the next symbol. So equal word sequences are
rewritten equally except for a margin at either end: a pair step adds at most one symbol of the
size before it, a run step at most its cap. With ``STEPS`` the margin is 9 words and a symbol
has at most 4.

Of all symbols that start within a stretch of ``window - 2 * margin - cap + 1`` words the one
of least name is an anchor. A repeated window contains an anchor, at the same place of each of its
occurrences, with at least ``margin`` words before and ``margin + cap`` from it on. The hash of
those words is what anchors are joined on. Only windows around anchors that another document has are
then looked at one by one, by two hashes of their words; a window is removed if its first
occurrence is in a document with a smaller id. Whole copies share one further key each; they are removed whole and
send no windows.

Null texts have no words. Rows without doc_id are neither removed from nor compared with; rows of
equal doc_id do not affect each other. Fewer words than a window: nothing is removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.store import drop, stage
from cohortlake.llm.words import Chunk, binary_texts, mixed, slices, winnowed

WINDOW = 50
#: (step, most words of a symbol it makes)
STEPS = (("pair", 2), ("run", 2), ("pair", 4), ("run", 4))


def margin_and_cap(steps=STEPS) -> tuple[int, int]:
    """Words at either end of a sequence that its surroundings may change, and the longest symbol."""
    margin, longest = 0, 1
    for kind, cap in steps:
        margin += longest if kind == "pair" else cap
        longest = max(longest, cap)
    return margin, longest


def tokens(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def recompressed(words: np.ndarray, offsets: np.ndarray, steps=STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Names and start positions of the symbols after all steps; none crosses the start of a text."""
    names, starts = words, np.arange(len(words))
    heads = np.zeros(len(words), bool)
    heads[offsets[:-1][offsets[:-1] < len(words)]] = True
    for round_, (kind, cap) in enumerate(steps, 1):
        if not len(names):
            break
        sizes = np.diff(starts, append=len(words))
        # a text's last symbol ends with the text, and the next head starts there
        if kind == "run":
            first = np.concatenate(([True], names[1:] != names[:-1])) | heads[starts]
            run = np.cumsum(first) - 1
            count = np.bincount(run)
            short = (count > 1) & (count * sizes[first] <= cap)
            keep = first | ~short[run]
            new = np.where(short[run], mixed(names ^ mixed(count[run].astype(np.uint64) + np.uint64(round_ << 32))), names)
        else:
            left = mixed(names ^ np.uint64(round_ * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(63) == 1
            joins = np.zeros(len(names), bool)
            joins[:-1] = left[:-1] & ~left[1:] & ~heads[starts[1:]] & (sizes[:-1] + sizes[1:] <= cap)
            keep = np.concatenate(([True], ~joins[:-1]))
            new = names.copy()
            at = np.flatnonzero(joins)
            new[at] = mixed(mixed(names[at]) + names[at + 1] + np.uint64(round_))
        names, starts = new[keep], starts[keep]
    return names, starts


def anchors(chunk: Chunk, window: int = WINDOW, steps=STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors that have room for their words, and the hash of those."""
    margin, longest = margin_and_cap(steps)
    names, starts = recompressed(chunk.words, chunk.offsets, steps)
    values = np.full(len(chunk), 2**64 - 1, np.uint64)
    values[starts] = mixed(names)
    at = np.flatnonzero(winnowed(values, window - 2 * margin - longest + 1))
    text = chunk.text_of(at)
    room = (at - margin >= chunk.offsets[text]) & (at + margin + longest <= chunk.offsets[text + 1])
    at = at[room]
    return at, chunk.hash_spans(at - margin, 2 * margin + longest)


def _anchor_rows(docs: DataFrame, window: int, steps) -> DataFrame:
    """(key, doc_id, body, at) per document and anchor key; at is empty for the key of the whole text."""

    def scan(batches):
        for batch in batches:
            texts = binary_texts(batch, "text")
            for low, high in slices(texts):
                lists = [tokens(t) for t in texts[low:high]]
                chunk = Chunk(lists)
                at, keys = anchors(chunk, window, steps)
                text = chunk.text_of(at)
                order = np.lexsort((at, keys, text))
                at, keys, text = at[order], keys[order], text[order]
                first = np.concatenate(([True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]))) if len(at) else np.empty(0, bool)
                heads = np.flatnonzero(first)
                long_ones = np.flatnonzero(np.diff(chunk.offsets) >= window)
                whole = np.array([xxhash.xxh64_intdigest(b" ".join(lists[i]), 7) for i in long_ones], np.uint64)
                cuts = np.concatenate((heads, np.full(len(long_ones) + 1, len(at)))).astype(np.int32)
                rows = pa.array(np.concatenate((text[heads], long_ones)) + low)
                places = pa.array((at - chunk.offsets[text]).astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((keys[heads], whole)).view(np.int64)), batch.column(0).take(rows),
                     batch.column(1).take(rows), pa.ListArray.from_arrays(pa.array(cuts), places)],
                    names=["key", "doc_id", "body", "at"],
                )

    return docs.mapInArrow(scan, "key bigint, doc_id bigint, body bigint, at array<int>")


def _window_rows(candidates: DataFrame, window: int, steps) -> DataFrame:
    """(h1, h2, doc_id, body, start) of the windows around the shared anchors of each document."""
    margin, longest = margin_and_cap(steps)
    reach = np.arange(margin, window - margin - longest + 1)

    def scan(batches):
        for batch in batches:
            texts, places = binary_texts(batch, "text"), batch.column(3)
            for low, high in slices(texts):
                chunk = Chunk(tokens(t) for t in texts[low:high])
                near = np.zeros(len(chunk), bool)
                for i in range(low, high):
                    a, b = chunk.offsets[i - low], chunk.offsets[i - low + 1]
                    own = np.unique((places[i].values.to_numpy()[:, None] - reach).ravel()) + a
                    near[own[(own >= a) & (own + window <= b)]] = True
                starts = np.flatnonzero(near)
                text = chunk.text_of(starts)
                rows = pa.array(text + low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk.hash_spans(starts, window).view(np.int64)),
                     pa.array(chunk.hash_spans(starts, window, seed=1).view(np.int64)), batch.column(0).take(rows),
                     batch.column(1).take(rows), pa.array((starts - chunk.offsets[text]).astype(np.int32))],
                    names=["h1", "h2", "doc_id", "body", "start"],
                )

    return candidates.select("doc_id", "body", "text", "at").mapInArrow(
        scan, "h1 bigint, h2 bigint, doc_id bigint, body bigint, start int"
    )


def _cut_rows(docs: DataFrame, window: int) -> DataFrame:
    """Texts without the words of the windows that start at ``starts``; all gone where ``whole``."""

    def scan(batches):
        for batch in batches:
            texts, starts, whole = binary_texts(batch, "text"), batch.column(3), batch.column(4).to_pylist()
            kept, n_words, n_removed = [], [], []
            for i, text in enumerate(texts):
                words = tokens(text)
                own = starts[i].values.to_numpy() if starts[i].is_valid else ()
                if whole[i]:
                    left = []
                elif len(own):
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, own, 1)
                    np.add.at(step, own + window, -1)
                    left = [w for w, gone in zip(words, (np.cumsum(step)[:-1] > 0).tolist()) if not gone]
                else:
                    left = words
                kept.append(b" ".join(left))
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                names=["doc_id", "kept", "n_words", "n_removed"],
            )

    return docs.select("doc_id", "body", "text", "starts", "whole").mapInArrow(
        scan, "doc_id bigint, kept string, n_words bigint, n_removed bigint"
    )


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, steps=STEPS) -> DataFrame:
    """One row per document: doc_id, kept (the words that stay, joined by one space), n_words, n_removed.

    Other columns of ``docs`` are not read. ``window`` must exceed what ``steps`` need around an anchor.
    """
    margin, longest = margin_and_cap(steps)
    if window < 2 * margin + 2 * longest - 1:
        raise ValueError("the window is too short for these steps")
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    named = source.where("doc_id is not null")

    found = stage(_anchor_rows(named, window, steps), "anchors")
    shared = stage(
        found.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first"),
        "shared",
    )
    copy = (F.size("at") == 0) & (F.col("doc_id") > F.col("first"))
    marks = stage(
        found.join(shared, "key").groupBy("doc_id", "body").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.max(copy).alias("whole")
        ),
        "marks",
    )
    drop(found, shared)

    candidates = named.join(marks.where("not whole"), ["doc_id", "body"])
    windows = stage(_window_rows(candidates, window, steps), "windows")
    first = stage(
        windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first"),
        "first",
    )
    later = windows.join(first, ["h1", "h2"]).where("doc_id > first")
    cuts = stage(
        later.groupBy("doc_id", "body").agg(F.collect_set("start").alias("starts")).withColumn("whole", F.lit(False))
        .unionByName(marks.where("whole").select("doc_id", "body", F.expr("cast(array() as array<int>)").alias("starts"), "whole")),
        "cuts",
    )
    drop(windows, first, marks)
    return _cut_rows(source.join(cuts, ["doc_id", "body"], "left"), window)
