"""Line dedup by overlapping windows of consecutive lines.

Every run of ``window`` lines of a text is hashed (two independent 64-bit hashes). Of equal windows
the first, by doc_id and line, stays; the lines of all later ones are removed. Windows overlap:
what is removed is the union of their lines, and windows are judged on the input, not on what is left.

Lines are what newlines separate, compared as they are. Windows of blank lines only do not count.
Texts of fewer lines than a window, null texts and rows without doc_id stay as they are and take
no part. Rows of equal id and text are the same occurrence; a text may end up empty.
All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.store import drop, stage

WINDOW = 3


def split(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(__id, __body, __starts): sorted first lines, from 0, of the windows that occur earlier; documents without any are left out."""
    def hashes(lines: Column) -> Column:
        def of(i: Column) -> Column:
            run = [F.get(lines, i + k) for k in range(window)]
            blank = F.length(F.trim(F.concat_ws("", *run))) == 0
            return F.when(~blank, F.struct(F.xxhash64(*run).alias("a"), F.xxhash64(F.lit(1), *reversed(run)).alias("b")))

        return F.transform(F.sequence(F.lit(0), F.size(lines) - window), of)

    rows = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__body"), split(text).alias("lines")).where(
        (F.size("lines") >= window) & F.col("__id").isNotNull()
    )
    found = rows.select("__id", "__body", F.posexplode(hashes(F.col("lines"))).alias("at", "w")).where("w is not null")
    windows = stage(found.select("__id", "__body", "at", F.col("w.a").alias("a"), F.col("w.b").alias("b")), "windows")
    first = stage(
        windows.groupBy("a", "b").agg(F.min(F.struct("__id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("a", "b", F.col("first.__id").alias("id"), F.col("first.at").alias("line")),
        "first",
    )
    later = windows.join(first, ["a", "b"]).where("__id > id or at > line")
    starts = stage(later.groupBy("__id", "__body").agg(F.array_sort(F.collect_set("at")).alias("__starts")), "starts")
    drop(windows, first)
    return starts


def kept(lines: Column, starts: Column, window: int = WINDOW) -> Column:
    """The lines outside all windows that start at the sorted ``starts``: the slices between them."""
    def between(i: Column) -> Column:
        low = F.when(i == 0, 0).otherwise(F.get(starts, i - 1) + window)
        high = F.when(i == F.size(starts), F.size(lines)).otherwise(F.get(starts, i))
        return F.slice(lines, low + 1, F.greatest(high - low, F.lit(0)))

    return F.when(starts.isNull(), lines).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), between)))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, counts: bool = False) -> DataFrame:
    """``docs`` with the lines of later windows taken out of the text; with ``counts`` also n_lines and n_removed."""
    starts = repeated(docs, doc_id=doc_id, text=text, window=window)
    # by shuffle at every size: no plan that a growing table of starts would change
    joined = docs.join(starts.hint("merge"), (F.col(doc_id) == F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__body")), "left")
    joined = joined.withColumn("__rest", kept(split(text), F.col("__starts"), window))
    out = [
        F.when(F.col("__starts").isNull(), F.col(text)).otherwise(F.array_join("__rest", "\n")).alias(text) if c == text else F.col(c)
        for c in docs.columns
    ]
    if counts:
        size = F.when(F.col(text).isNull(), 0).otherwise(F.size(split(text)))
        out += [size.alias("n_lines"), F.when(F.col(text).isNull(), 0).otherwise(size - F.size("__rest")).alias("n_removed")]
    return joined.select(*out)


def with_length(docs: DataFrame, *, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with the column ``length``, if there is one, set to the characters of the text; null for a null text."""
    return docs.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in docs.columns else docs
