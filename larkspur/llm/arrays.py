"""Words, lines and fingerprints of whole Arrow columns of texts, as numpy arrays.

Texts are read as UTF-8 bytes. A batch is handled in slices of consecutive texts of about half a megabyte, so that the
work arrays stay small however many rows a batch has.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

# The bytes that separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: The C library's call that returns freed memory, where it has one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
STEPS = tuple(pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(64))


def byte_flags(wanted) -> np.ndarray:
    """A table of 256 flags, set for the wanted bytes."""
    flags = np.zeros(256, bool)
    flags[list(wanted)] = True
    return flags


IS_SPACE = byte_flags(SPACES)
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.where((SAME >= 65) & (SAME <= 90), SAME + 32, SAME).astype(np.uint8)


def release() -> None:
    """Give freed memory back to the system. Spark keeps Python workers for later stages, where they would hold it."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One plain array, null texts as empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and text bounds of consecutive texts; a longer text has a slice of its own."""
    column = flat(column)
    if not len(column):
        return
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(int(np.searchsorted(ends, ends[row] + limit, "right")) - 1, row + 1)
        yield row, end, data[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


def counts(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive bounds."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the bounds of each text in the list of words."""
    inside = ~IS_SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[bounds] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each line; lines end at a line feed or with their text. Empty last lines are left out."""
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([bounds[:-1], feeds + 1]))
    starts = starts[starts < len(data)]
    text = np.searchsorted(bounds, starts, "right") - 1
    follows = np.append(feeds, len(data))[np.searchsorted(feeds, starts)]
    return starts, np.minimum(follows, bounds[text + 1]), text


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each bit over the whole number."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def made_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(size, base, U64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    return made[0], made[1]


@lru_cache(maxsize=1)
def slice_powers() -> tuple[np.ndarray, np.ndarray]:
    return made_powers(SLICE_BYTES + 1)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse. Only those for a usual slice are kept; longer texts make their own."""
    return slice_powers() if size <= SLICE_BYTES + 1 else made_powers(size)


class Fingerprints:
    """64-bit fingerprints of any stretch of the given bytes, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray, table: np.ndarray = SAME):
        up, self.down = powers(len(data) + 1)
        values = (table.astype(U64) + U64(1))[data]
        values *= up[: len(data)]
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(values, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64) * U64(STEPS[0]))

    def grams(self, size: int) -> np.ndarray:
        """Of the stretch of ``size`` bytes at every position."""
        n = max(len(self.sums) - size, 0)
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of ``size`` consecutive ones, at every position where so many follow."""
    n = max(len(h) - size + 1, 0)
    out = np.zeros(n, U64)
    for k in range(size):
        out += h[k : k + n] * U64(STEPS[k])
    return mixed(out)


def whole_runs(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Flags of the runs of ``size`` words, of ``n`` positions, that lie within one text; ``first`` bounds the texts."""
    ok = np.ones(n, bool)
    for edge in range(1, size):
        at = first[1:-1] - edge
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def texts_of(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
