"""Reproducible splits and samples by hash of a row key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.hashing import WORDS, below, word, word_as_number


def row_key(keys: Sequence[str]) -> Column:
    return F.concat_ws("~", *[F.col(k).cast("string") for k in keys])


def hash_split(df: DataFrame, keys: Sequence[str], shares: Mapping[str, float], salt: str,
               column: str = "part") -> DataFrame:
    """Label every row with one of the named parts, in proportion to ``shares``.

    All rows of one key get the same part, so a person never falls on both sides.
    Filter on the label for each part; nothing is shuffled.
    """
    total = sum(shares.values())
    draw = word(row_key(keys), salt)
    names = list(shares)
    label = None
    for name, upto in zip(names[:-1], accumulate(shares.values())):
        hit = below(draw, upto / total)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return df.withColumn(column, F.lit(names[-1]) if label is None else label.otherwise(names[-1]))


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float, salt: str) -> DataFrame:
    """Bernoulli sample without replacement."""
    return df.where(below(word(row_key(keys), salt), fraction))


def sample_to_size(df: DataFrame, keys: Sequence[str], target: int, salt: str) -> DataFrame:
    """Bernoulli sample with expected size ``target``; the row count is a scalar subquery."""
    rows = df.agg(F.count("*")).scalar()
    draw = word_as_number(word(row_key(keys), salt))
    return df.where(draw.cast("double") * rows < F.lit(float(target * WORDS)))


def downsample(df: DataFrame, keys: Sequence[str], stratum: str, fractions: Mapping[object, float],
               salt: str) -> DataFrame:
    """Keep each listed stratum at its fraction and every other row, null strata included.

    One filter replaces a filter, sample and union per class. Apply it to the training
    part only.
    """
    draw = word(row_key(keys), salt)
    keep = F.lit(True)
    for value, fraction in fractions.items():
        keep = F.when(F.col(stratum).eqNullSafe(F.lit(value)), below(draw, fraction)).otherwise(keep)
    return df.where(keep)
