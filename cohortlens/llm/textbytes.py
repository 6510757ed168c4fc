"""Words, lines and hashes of many texts at once, on the bytes of Arrow string columns.

A batch is worked on in slices of about ``SLICE_BYTES`` of text (one text at least), so the memory
of a task follows the slice and the longest single text, not the batch.  All offsets are byte
offsets into the slice.  UTF-8 keeps bytes below 0x80 out of longer characters, so classes of ASCII
characters are decided byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

SLICE_BYTES = 1 << 20

_RATIO = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _RATIO)
#: longer spans are hashed by themselves: sums modulo 2 ** 64 have equal values for some unequal
#: strings of about a thousand bytes, whatever the base and the values of the bytes
LONG_SPAN = 96


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _power_table(_RATIO, SLICE_BYTES + 1), _power_table(_INVERSE, SLICE_BYTES + 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse; those of a usual slice are kept."""
    if n > SLICE_BYTES + 1:
        return _power_table(_RATIO, n), _power_table(_INVERSE, n)
    power, inverse = _usual_powers()
    return power[:n], inverse[:n]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true inside the given closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: words ``[^\\x20\\x09-\\x0D]+``
BLANK_SEPARATED = ~byte_class((0x09, 0x0D), (0x20, 0x20))
#: words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, after A-Z became a-z
LETTERS_AND_DIGITS = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class Texts:
    """Some rows of a batch: ``first`` is the row of the batch that ``bounds[0]`` starts."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def lower(self) -> Texts:
        """With A-Z turned into a-z."""
        return Texts(self.first, _LOWER[self.data], self.bounds)


def slices(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a column in order; a null is a text of no bytes."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(where, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(bounds, bounds[start] + budget, "right")) - 1
        end = min(max(end, start + 1), n)
        yield Texts(start, data[bounds[start]:bounds[end]], bounds[start:end + 1] - bounds[start])
        start = end


class PrefixHash:
    """64-bit hashes of any byte ranges of a text buffer: short ones after one pass over it, those of
    more than ``LONG_SPAN`` bytes each by itself."""

    def __init__(self, data: np.ndarray):
        self.data = np.ascontiguousarray(data)
        self.power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * self.power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = mix((self.sums[end] - self.sums[start]) * self.inverse[start])
        long = np.flatnonzero(end - start > LONG_SPAN)
        if len(long):
            data = memoryview(self.data)
            out[long] = np.fromiter(
                (xxh3_64_intdigest(data[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)),
                np.uint64, len(long))
        return out


def word_spans(texts: Texts, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the words' bounds per text (as ``bounds`` for bytes)."""
    n = len(texts.data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = word_byte[texts.data]
    opens = np.zeros(n + 1, bool)
    opens[texts.bounds] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here & (~before | opens))
    ends = np.flatnonzero(before & (~here | opens))
    return starts, ends, np.searchsorted(starts, texts.bounds)


def line_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, split at \\n, and the lines' bounds per text.

    A text of no bytes is one empty line.
    """
    breaks = np.flatnonzero(texts.data == 0x0A)
    home = np.searchsorted(texts.bounds, breaks, "right") - 1
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(home, minlength=len(texts)) + 1, out=first[1:])
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    nth = np.arange(len(breaks)) + home
    starts[first[:-1]], starts[nth + 1] = texts.bounds[:-1], breaks + 1
    ends[first[1:] - 1], ends[nth] = texts.bounds[1:], breaks
    return starts, ends, first


def windows(first: np.ndarray, size: int) -> np.ndarray:
    """Indexes that start ``size`` items of one text; ``first`` holds the items' bounds per text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    total = int(counts.sum())
    skipped = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(first[:-1] - skipped, counts)


def combined(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """One hash of ``size`` consecutive item hashes from each index in ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * _RATIO + hashes[at + k]
    return mix(out)


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each item, from the items' bounds per text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs again anywhere, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    ordered = keys[order]
    same[1:-1] = ordered[1:] == ordered[:-1]
    anywhere, before = np.empty(len(keys), bool), np.empty(len(keys), bool)
    before[order] = same[:-1]
    anywhere[order] = same[:-1] | same[1:]
    return anywhere, before


def sum_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of item values per text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte offset."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums
