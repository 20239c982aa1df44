"""Periodic runs of words by internal pattern matching.

Texts are handled in slices of about half a megabyte, a longer text by itself. Words become numbers, every text ends with a
number of its own, and the suffixes of a slice are sorted by prefix doubling. Round k of the doubling names the blocks of
2**k words, and a block's name is its range of the suffix array. A wavelet tree over the suffix array answers, for a block
at i, the smallest place beyond i in its range: the block's next occurrence.

Occurrences in the window of one block length behind a block form one arithmetic progression, and its difference, the first
gap, is a candidate period. A run with smallest period q of 2**(k-1) < q <= 2**k, and four periods long at least, holds a block
of 2**k words that starts at a multiple of 2**(k-1) and whose next occurrence is q words on: any nearer one would give a
smaller period. So no run is missed. (Periods of 1 to 4 share the blocks of four words at every second place, as a run
has six words at least.) Each candidate period is then checked against the words themselves, which also gives the ends of its runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from larkspur.llm.arrays import SLICE_BYTES, release

# A run has so many words at least, and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4

#: Blocks of 2**SMALLEST words are the shortest ones; they serve all periods up to their length.
SMALLEST = 2
TYPE = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class WaveletTree:
    """Order statistics of any range of an array of numbers below ``size``: one bit vector per binary place."""

    def __init__(self, values: np.ndarray, size: int):
        self.size, self.bits = size, max(int(size - 1).bit_length(), 1)
        self.levels = []
        values = values.astype(np.int32 if size < 1 << 31 else np.int64)
        for bit in range(self.bits - 1, -1, -1):
            ones = ((values >> bit) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((words, before, len(values) - int(before[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        place = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[place] + np.bitwise_count(words[place] & mask)

    def successors(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest number from ``least`` on in each range [low, high) of the array; ``size`` if there is none."""
        found = np.full(len(low), self.size, np.int64)
        asked = np.flatnonzero(least < self.size)
        low, high, least = low[asked], high[asked], least[asked]
        smaller, a, b = np.zeros(len(asked), np.int64), low, high
        for depth, (words, before, zeros) in enumerate(self.levels):
            one = ((least >> (self.bits - 1 - depth)) & 1).astype(bool)
            a1, b1 = self.ones(words, before, a), self.ones(words, before, b)
            smaller += np.where(one, (b - b1) - (a - a1), 0)
            a, b = np.where(one, zeros + a1, a - a1), np.where(one, zeros + b1, b - b1)
        some = smaller < high - low
        asked, rank, a, b = asked[some], smaller[some], low[some], high[some]
        value = np.zeros(len(asked), np.int64)
        for words, before, zeros in self.levels:
            a1, b1 = self.ones(words, before, a), self.ones(words, before, b)
            in_zeros = (b - b1) - (a - a1)
            one = rank >= in_zeros
            rank = np.where(one, rank - in_zeros, rank)
            value = 2 * value + one
            a, b = np.where(one, zeros + a1, a - a1), np.where(one, zeros + b1, b - b1)
        found[asked] = value
        return found


def block_ranges(names: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array, and per round k the asked blocks (k, places, range starts, range ends) that occur again.

    Suffixes are told apart by as many words as the longest period needs.
    """
    n = len(names)
    sizes = np.bincount(names)
    starts = np.cumsum(sizes) - sizes
    rank, size = starts[names], sizes[names]
    active = np.flatnonzero(size > 1)
    asked, k = [], 0
    while len(active) and (k < SMALLEST or (1 << k) < longest // LEAST_PERIODS):
        reach = active + (1 << k)
        then = np.where(reach < n, rank[np.minimum(reach, n - 1)], -1)
        order = np.lexsort((then, rank[active]))
        active, then = active[order], then[order]
        own = rank[active]
        old = np.concatenate([[True], own[1:] != own[:-1]])
        new = old | np.concatenate([[True], then[1:] != then[:-1]])
        at = np.arange(len(active))
        first = np.flatnonzero(new)
        rank[active] = own + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        again = np.repeat(np.diff(np.append(first, len(active))), np.diff(np.append(first, len(active))))
        size[active] = again
        active = active[again > 1]
        k += 1
        if k >= SMALLEST:
            places = active[active % (1 << (k - 1)) == 0]
            asked.append((k, places, rank[places], rank[places] + size[places]))
    return np.argsort(rank, kind="stable"), asked


def candidate_periods(names: np.ndarray, longest: int) -> np.ndarray:
    """Distances to the next occurrence of blocks, within one block length."""
    order, asked = block_ranges(names, longest)
    if not any(len(places) for _, places, _, _ in asked):
        return np.zeros(0, np.int64)
    tree = WaveletTree(order, len(names))
    found = []
    for k, places, low, high in asked:
        gap = tree.successors(low, high, places + 1) - places
        found.append(np.unique(gap[(gap <= 1 << k) & (places + gap < len(names))]))
    return np.unique(np.concatenate(found))


def runs_of(names: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs, by start and period.

    A stretch that several candidate periods find has the smallest of them.
    """
    found = []
    for period in candidate_periods(names, longest).tolist():
        same = np.zeros(len(names) - period + 2, np.int8)
        same[1:-1] = names[period:] == names[:-period]
        step = np.diff(same)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = end - start + period >= max(LEAST_WORDS, LEAST_PERIODS * period)
        start, length = start[long], (end - start)[long] + period
        found.append(np.stack([start, length, np.full(len(start), period)]))
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def handle(texts: list[bytes]) -> Iterator[tuple[int, list[dict[str, int]], str]]:
    """Per text its number of words, its runs, and its text without the repeated words."""
    index: dict[bytes, int] = {}
    words = [text.split() for text in texts]  # at the bytes 0x20 and 0x09 to 0x0D
    sizes = [len(w) for w in words]
    names = np.empty(sum(sizes) + len(texts), np.int64)
    bounds = np.cumsum([0, *[s + 1 for s in sizes]])
    for own, lo, hi in zip(words, bounds[:-1], bounds[1:] - 1):
        names[lo:hi] = np.fromiter((index.setdefault(w, len(index)) for w in own), np.int64, hi - lo)
    names[bounds[1:] - 1] = len(index) + np.arange(len(texts))
    start, length, period = runs_of(names, max(sizes, default=0))
    gone = np.zeros(len(names) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    kept = np.cumsum(gone)[:-1] == 0
    cuts = np.searchsorted(start, bounds)
    for k, own in enumerate(words):
        part = slice(cuts[k], cuts[k + 1])
        runs = [{"start": s, "length": n, "period": p} for s, n, p in zip((start[part] - bounds[k]).tolist(), length[part].tolist(), period[part].tolist())]
        if runs:
            own = compress(own, kept[bounds[k] : bounds[k + 1] - 1].tolist())
        yield sizes[k], runs, b" ".join(own).decode()


def finder(text: str, kept: list[str]):
    """For mapInArrow: the kept columns with the words and runs of each text, one slice of texts at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            sizes = [0 if not x.is_valid else x.as_buffer().size for x in column]
            lo = 0
            while lo < len(column):
                hi, total = lo + 1, sizes[lo]
                while hi < len(column) and total + sizes[hi] <= SLICE_BYTES:
                    total += sizes[hi]
                    hi += 1
                made = list(handle([x or b"" for x in column.slice(lo, hi - lo).to_pylist()]))
                struct = pa.StructArray.from_arrays(
                    [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(RUN)), pa.array([m[2] for m in made], pa.string())],
                    ["n_words", "runs", "collapsed"],
                )
                own = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, struct], names=[*kept, "_periods"])
                lo = hi
            release()

    return rows


def find_runs(docs: DataFrame, text: str = "text", into: str = "periods", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with a struct ``into``: ``n_words``, ``runs`` (start, length, period) and ``collapsed`` text.

    Words are split at ASCII white space and numbered from 0. A run is a stretch of consecutive words with smallest period q
    and 6 words and 4 periods at least, which no neighbouring word extends. ``runs`` go by start, then period. ``collapsed``
    joins with one space the words that no run holds behind its first q words.

    Null, empty and blank texts have no words and no runs. Each text is judged by itself, so repeated rows have equal results;
    an empty table gives no rows. A very long text is one slice, in arrays of about 15 numbers a word; it is never cut.
    A column named ``into`` is replaced; ``keep`` names the other columns, all by default.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != into]
    fields = [f for f in docs.schema.fields if f.name in kept]
    made = StructType([*fields, StructField("_periods", StructType.fromDDL(f"x {TYPE}")[0].dataType)])
    read = docs.select(*dict.fromkeys([*[f.name for f in fields], text]))
    return read.mapInArrow(finder(text, [f.name for f in fields]), made).withColumnRenamed("_periods", into)


def strongest(runs: str) -> Column:
    """The run of greatest length per period, the first of equal ones; null without runs."""
    larger = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.aggregate(F.col(runs), F.get(F.col(runs), F.lit(0)), larger)
