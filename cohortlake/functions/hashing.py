"""Reproducible pseudo-random draws from md5 of a row key.

Row order, partitioning and retries do not change the outcome, which Spark's own
``sample`` and ``randomSplit`` cannot promise. A draw is a word of eight hex digits;
words of equal width order as text exactly as they do as numbers, so a threshold
test is a string comparison.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 2**32


def digest(key: Column, *parts: Column | str) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", key.cast("string"), *cols))


def word(key: Column, salt: str, position: int = 0) -> Column:
    return F.substring(digest(key, salt), 8 * position + 1, 8)


def word_as_number(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def threshold(probability: float) -> str:
    """Largest word (exclusive) that a draw of this probability may take."""
    level = min(int(round(probability * WORDS)), WORDS)
    return "g" if level == WORDS else f"{level:08x}"


def below(text: Column, probability: float) -> Column:
    return text < F.lit(threshold(probability))


def poisson_levels(mean: float) -> list[str]:
    """Cumulative Poisson probabilities as words, up to the last one below 1."""
    levels, total, k = [], 0.0, 0
    while k <= mean + 40 * math.sqrt(mean) + 60:
        total += math.exp(-mean + (k * math.log(mean) if k else 0.0) - math.lgamma(k + 1))
        level = threshold(total)
        if level == "g":
            break
        levels.append(level)
        k += 1
    return levels
