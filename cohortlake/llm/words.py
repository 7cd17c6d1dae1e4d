"""Words of whole texts as numpy arrays of hashes, a bounded chunk of texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 2 << 20
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)

#: A-Z to a-z, every other ASCII character but a-z and 0-9 to a space, the rest as it is.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def binary_texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    values = batch.column(batch.schema.get_field_index(column))
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


def slices(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes of text; one longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Chunk:
    """Word hashes of some texts, one after the other; text i has words[offsets[i]:offsets[i+1]]."""

    def __init__(self, token_lists: Iterable[list[bytes]]):
        parts = [hashed(tokens) for tokens in token_lists]
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self._sums: dict[int, np.ndarray] = {}
        self._powers: list[np.ndarray] = []

    def __len__(self) -> int:
        return len(self.words)

    def spans(self, length: int) -> np.ndarray:
        """Starts of all runs of ``length`` words inside one text."""
        first, last = self.offsets[:-1], self.offsets[1:] - length + 1
        fits = np.maximum(last - first, 0)
        steps = np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
        return np.repeat(first, fits) + steps

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def hash_spans(self, starts: np.ndarray, length: int | np.ndarray, seed: int = 0) -> np.ndarray:
        """Hash of the words [start, start + length), the same wherever the words stand."""
        self._powers = self._powers or powers(len(self.words) + 1)
        up, down = self._powers
        if seed not in self._sums:
            base = self.words if not seed else mixed(self.words ^ np.uint64(seed * ODD % (1 << 64)))
            self._sums[seed] = np.concatenate(([np.uint64(0)], np.cumsum(base * up[: len(base)], dtype=np.uint64)))
        sums = self._sums[seed]
        return mixed((sums[starts + length] - sums[starts]) * down[starts])


def powers(n: int) -> list[np.ndarray]:
    """The first n powers, modulo 2**64, of an odd number and of its inverse."""
    steps = [np.full(n, base, np.uint64) for base in (ODD, INVERSE)]
    for x in steps:
        x[0] = 1
    return [np.cumprod(x, dtype=np.uint64) for x in steps]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(values[i : i + width]); the end is padded with the largest value."""
    return _sliding(values, width, np.minimum, np.uint64(2**64 - 1))


def _sliding(values, width, pick, pad):
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        shifted = np.concatenate((out[step:], np.full(min(step, len(out)), pad, np.uint64)))
        out = pick(out, shifted)
        have += step
    return out


def winnowed(values: np.ndarray, width: int) -> np.ndarray:
    """Mask of the values that are the least of some ``width`` neighbours; ties all count.

    Whether a position is chosen for a stretch depends on that stretch alone, so two equal
    stretches share a choice.
    """
    least = sliding_min(values, width)
    # the largest minimum over the stretches that hold position i: those that start at i-width+1 .. i
    behind = _sliding(least[::-1], width, np.maximum, np.uint64(0))[::-1]
    return (values == behind) & (values != np.uint64(2**64 - 1))
