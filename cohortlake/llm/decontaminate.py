"""Benchmark decontamination by winnowed word k-grams.

Of every window of ``span`` words both sides keep the least of its k-gram hashes, so a window has the
same fingerprint wherever it stands: two texts that share ``span`` words share a fingerprint. Items of
fewer words are one window, whose fingerprint is its own hash; windows of each such length are then
fingerprinted in documents too. Fingerprints of documents are joined by shuffle with the distinct ones of the
benchmark. Hits are verified on the whole window by a second join, on 128 bits of hash over all its words, and
extended by merging windows that overlap or touch.

Words are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased. Null texts
have no words. Items without words or without an id take no part; an id that occurs in
several rows counts once. Documents may repeat; each row is judged by itself, but equal texts are looked up
once. Texts are told apart by 128 bits of hash. Without an item nothing is covered.

Nothing of the benchmark is collected but a bitmap of its fingerprints of at most 2 ** ``sieve_bits`` bits, which
spares the join most fingerprints that it would reject. It decides nothing: where it is full, or
left out (``sieve_bits`` 0), the join drops the same rows. The items that share a window are one array, which
is no longer than the list due for each document that holds the window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.store import drop, stage
from cohortlake.llm.words import ALNUM, Chunk, binary_texts, slices, sliding_min

SPAN, GRAM, SHARE, SIEVE_BITS = 13, 5, 20, 27
BUCKET_BITS = 15  # what one bitmap of Spark's holds
WINDOW = pa.struct([(n, pa.int64()) for n in ("key", "length", "start", "first", "second")])
PRINTS = ("body bigint, other bigint, n_words bigint, "
          "found array<struct<key: bigint, length: bigint, start: bigint, first: bigint, second: bigint>>")
TEXT, SAME = ["body", "other"], ["length", "first", "second"]


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


def fingerprints(chunk: Chunk, length: int, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of all windows of ``length`` words: the least k-gram hash, or if shorter than ``span`` their own."""
    starts = chunk.spans(length)
    if length < span:
        return starts, chunk.hash_spans(starts, length)
    values = np.full(len(chunk), 2**64 - 1, np.uint64)
    grams = chunk.spans(gram)
    values[grams] = chunk.hash_spans(grams, gram)
    return starts, sliding_min(values, span - gram + 1)[starts]


def windows_of(texts: list[bytes | None], choose, span: int, gram: int):
    """For each bounded slice of texts: words per text, then text, fingerprint, length, start and two hashes of the
    windows; ``choose(chunk)`` gives (length, which texts have such windows, which fingerprints count)."""
    for low, high in slices(texts):
        chunk = Chunk(tokens(t) for t in texts[low:high])
        parts = [np.empty((6, 0), np.int64)]
        for length, takes, counts in choose(chunk):
            starts, keys = fingerprints(chunk, length, span, gram)
            keep = counts(keys)
            starts, keys = starts[keep], keys[keep]
            of = chunk.text_of(starts)
            mine = takes[of]
            starts, keys, of = starts[mine], keys[mine], of[mine]
            hashes = [chunk.hash_spans(starts, length, seed).view(np.int64) for seed in (0, 1)]
            parts.append(np.stack((of, keys.view(np.int64), np.full(len(of), length), starts - chunk.offsets[of], *hashes)))
        found = np.concatenate(parts, axis=1)
        yield np.diff(chunk.offsets), found[:, np.argsort(found[0], kind="stable")]


def _batch(fixed: list[pa.Array], names: list[str], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    words = np.concatenate([w for w, _ in found]) if found else np.empty(0, np.int64)
    rows = np.concatenate([x for _, x in found], axis=1) if found else np.empty((6, 0), np.int64)
    sizes = np.concatenate([np.bincount(x[0], minlength=len(w)) for w, x in found]) if found else np.empty(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    windows = pa.StructArray.from_arrays([pa.array(x) for x in rows[1:]], fields=list(WINDOW))
    lists = pa.ListArray.from_arrays(pa.array(offsets), windows)
    return pa.RecordBatch.from_arrays([*fixed, pa.array(words, pa.int64()), lists], names=[*names, "n_words", "found"])


def _everything(keys: np.ndarray) -> np.ndarray:
    return np.ones(len(keys), bool)


def _benchmark(items: DataFrame, item_id: str, text: str, span: int, gram: int) -> DataFrame:
    """One row per distinct window: key, length, first, second, names (sorted ids of the items that hold it)."""

    def choose(chunk):
        sizes = np.diff(chunk.offsets)
        for length in sorted({min(int(n), span) for n in sizes if n}):
            yield length, sizes >= span if length == span else sizes == length, _everything

    def scan(batches):
        for batch in batches:
            yield _batch([batch.column(0)], ["name"], list(windows_of(binary_texts(batch, "text"), choose, span, gram)))

    rows = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text")).where("name is not null")
    each = rows.mapInArrow(scan, f"name string, {PRINTS.split(', ', 2)[2]}").select("name", F.inline("found"))
    return each.select("name", "key", *SAME).distinct().groupBy("key", *SAME).agg(F.array_sort(F.collect_list("name")).alias("names"))


def _sieve(keys: DataFrame, most: int) -> tuple[np.ndarray | None, int]:
    """A bitmap with two places for each fingerprint, its leading and its last bits; 32 bits or more a fingerprint while
    ``most`` allows it, so that about one in 250 others passes."""
    bits = min(most, max(BUCKET_BITS, (32 * keys.count()).bit_length()))
    if bits < BUCKET_BITS:
        return None, 0
    places = F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND((1 << bits) - 1))
    place = F.col("place") + 1
    buckets = keys.select(F.explode(places).alias("place")).groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    sieve = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (BUCKET_BITS - 3)
    for row in buckets.collect():
        low = (row["bucket"] - 1) * size
        sieve[low : low + size] = np.frombuffer(row["bitmap"], np.uint8)[:size]
    return sieve, bits


def _set(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1


def _prints(docs: DataFrame, source: list, names: list[str], text: str, lengths: list[int], sieve, bits: int, span: int, gram: int):
    """Every document's hash, number of words, and the windows whose fingerprints the sieve lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def scan(batches):
        held = shared.value

        def counts(keys):
            if held is None:
                return _everything(keys)
            keep = _set(held, keys >> np.uint64(64 - bits))
            keep[keep] = _set(held, keys[keep] & np.uint64((1 << bits) - 1))
            return keep

        def choose(chunk):
            for length in lengths:
                yield length, np.ones(len(chunk.offsets) - 1, bool), counts

        for batch in batches:
            fixed = [batch.column(i) for i in range(len(names) + 2)]
            yield _batch(fixed, [*names, *TEXT], list(windows_of(binary_texts(batch, "text"), choose, span, gram)))

    rows = docs.select(*source, *_hashes(text), F.col(text).alias("text"))
    return rows.mapInArrow(scan, ", ".join([*(f"{n} bigint" for n in names), PRINTS]))


def _hashes(text: str) -> list:
    return [F.xxhash64(F.col(text)).alias("body"), F.xxhash64(F.lit(1), F.col(text)).alias("other")]


def _findings(docs, source, names, items, text, item_id, item_text, span, gram, sieve_bits) -> tuple[DataFrame, DataFrame]:
    """(every document's prints; starts, ends and items of each text in which something is covered)."""
    if not 1 <= gram <= span:
        raise ValueError("a k-gram is no longer than the span")
    bench = stage(_benchmark(items, item_id, item_text, span, gram), "benchmark")
    # a table of its own: both sides of the join are then plain exchanges, whose hot keys adaptive execution splits
    keys = stage(bench.select("key").distinct(), "keys")
    lengths = sorted(r["length"] for r in bench.select("length").distinct().collect())
    prints = stage(_prints(docs, source, names, text, lengths, *_sieve(keys, sieve_bits), span, gram), "prints")

    # equal texts have equal windows: one of them is looked up
    once = prints.where("size(found) > 0").groupBy(*TEXT).agg(F.first("found").alias("found"))
    shared = once.select(*TEXT, F.inline("found")).join(keys.hint("merge"), "key", "left_semi")
    # arrays of items stay behind until each text knows which it needs
    listed = bench.select(*SAME, F.md5(F.to_json("names").cast("binary")).alias("list"), "names")
    hits = stage(shared.join(listed.select(*SAME, "list").hint("merge"), SAME).select(*TEXT, "start", "length", "list"), "hits")

    ends = hits.groupBy(*TEXT, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    order = Window.partitionBy(*TEXT).orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = ends.withColumn("fresh", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    stretches = apart.withColumn("stretch", F.sum("fresh").over(order)).groupBy(*TEXT, "stretch").agg(
        F.min("start").alias("start"), F.max("end").alias("end"))
    covered = stretches.groupBy(*TEXT).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("covered"))
    lists = listed.groupBy("list").agg(F.first("names").alias("names"))
    named = hits.select(*TEXT, "list").distinct().join(lists, "list").select(*TEXT, F.explode("names").alias("name")).distinct()
    named = named.groupBy(*TEXT).agg(F.array_sort(F.collect_list("name")).alias("items"))
    found = covered.join(named, TEXT).select(
        *TEXT, F.col("covered.start").alias("starts"), F.col("covered.end").alias("ends"), "items")
    found = stage(found, "covered")
    drop(bench, keys, hits)
    return prints, found


def _hit(starts: str = "starts", ends: str = "ends"):
    return F.aggregate(F.zip_with(ends, starts, lambda e, s: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)


def _bad(n_hit, n_words, share: int):
    return (n_hit > 0) & (n_hit * share >= n_words)


def contamination(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", span: int = SPAN, gram: int = GRAM, share: int = SHARE, sieve_bits: int = SIEVE_BITS,
) -> DataFrame:
    """One row per document: doc_id, body (hash of the text), n_words, starts and ends of the covered
    stretches (in words), items (sorted ids), n_hit, n_items, contaminated: something is covered, and at
    least one word in ``share``. Other columns of ``docs`` are not read."""
    source = [F.col(doc_id).cast("bigint").alias("doc_id")]
    prints, found = _findings(docs, source, ["doc_id"], items, text, item_id, item_text, span, gram, sieve_bits)
    rows = prints.drop("found").join(found.hint("merge"), TEXT, "left")
    none = {"starts": "array<bigint>", "ends": "array<bigint>", "items": "array<string>"}
    rows = rows.select("doc_id", "body", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()])
    return rows.withColumns({"n_hit": _hit(), "n_items": F.size("items").cast("bigint")}).withColumn(
        "contaminated", _bad(F.col("n_hit"), F.col("n_words"), share))


def clean(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    span: int = SPAN, gram: int = GRAM, share: int = SHARE, sieve_bits: int = SIEVE_BITS,
) -> DataFrame:
    """The documents that are not contaminated, all columns as they are."""
    prints, found = _findings(docs, [], [], items, text, item_id, item_text, span, gram, sieve_bits)
    words = prints.where("size(found) > 0").select(*TEXT, "n_words").distinct()
    bad = found.join(words, TEXT).where(_bad(_hit(), F.col("n_words"), share)).select(
        F.col("body").alias("__body"), F.col("other").alias("__other"))
    bad = stage(bad, "contaminated")
    drop(prints, found)
    first, second = [h for h in _hashes(text)]
    return docs.join(bad.hint("merge"), (first == F.col("__body")) & (second == F.col("__other")), "left_anti")
