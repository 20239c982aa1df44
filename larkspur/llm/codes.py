"""Vector code compression: product codes by exact integer k-means with equal-average search.

Components become integers and vectors are cut into equal parts, each with a codebook of its own. The nearest entry of a
part is found by component sums: by Cauchy and Schwarz the squared gap of two sums is at most the parts' width times
their squared distance. So entries are sorted by sum, looked at outward from the part's own sum, and the search ends once
the squared gap over the width is strictly larger than the best distance (equal ones may still tie).

Each round is one pass over the vectors without a shuffle of them: tasks sum up their parts per entry and send one short
list of sums. Only the codebooks (parts x entries x width numbers) and those sums are on the driver. Sums and distances
are exact: components beyond what 64 bits hold are worked out in Python integers, for those rows alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Sums are sent as signed digits of this base, so that any number of tasks adds up exactly.
DIGIT_BITS = 32

Books = list[list[list[int]]]


def finite_vectors(df: DataFrame, vec_id: str, vector: str, label: str | None) -> DataFrame:
    """Rows (vec_id, x array<double>, label) whose vector is neither null nor holds null or non-finite components."""
    x = F.col(vector).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    shown = F.lit(None).cast("int") if label is None else F.col(label)
    return df.where(x.isNotNull() & F.forall(x, finite)).select(F.col(vec_id).alias("vec_id"), x.alias("x"), shown.alias("label"))


def most_small(width: int) -> int:
    """Components below it have squared gaps, distances and their sums over all parts within 64 bits."""
    return math.isqrt((1 << 58) // (4 * max(width, 1) ** 2))


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), exact for every finite double."""
    return int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale)


def part_arrays(column: pa.Array, parts: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their integer parts (rows, parts, width): small ones as 64-bit integers, others as Python integers.

    Missing components of shorter vectors are zero.
    """
    sizes = np.diff(np.asarray(column.offsets, np.int64))
    values = np.asarray(column.flatten(), np.float64)
    x = np.zeros((len(column), parts * width))
    x[np.arange(parts * width) < sizes[:, None]] = values
    small = (np.abs(x) < most_small(width) / SCALE - 1).all(axis=1)
    rows = np.flatnonzero(small)
    if len(rows):
        yield rows, np.floor(x[rows] * SCALE).astype(np.int64).reshape(-1, parts, width)
    rows = np.flatnonzero(~small)
    if len(rows):
        large = np.array([[whole(c) for c in row] for row in x[rows].tolist()], dtype=object)
        yield rows, large.reshape(len(rows), parts, width)


class Codebook:
    """The entries of one part position, sorted by the sum of their components."""

    def __init__(self, entries: list[list[int]], width: int):
        largest = max((abs(c) for e in entries for c in e), default=0)
        self.small, self.width = largest < most_small(width), width
        self.kind = np.int64 if self.small else object
        self.order = np.array(sorted(range(len(entries)), key=lambda e: (sum(entries[e]), e)), np.int64)
        self.entries = np.array([entries[e] for e in self.order], dtype=self.kind).reshape(len(entries), width)
        self.sums = self.entries.sum(axis=1) if width else np.zeros(len(entries), self.kind)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each part's nearest entry, the lower one of equally near ones, and the squared distance."""
        if parts.dtype != self.kind:
            parts = parts.astype(object)
        n, last = len(parts), len(self.order) - 1
        own = parts.sum(axis=1)
        best, index = np.zeros(n, parts.dtype), np.full(n, -1, np.int64)
        right = np.searchsorted(self.sums, own)
        left = right - 1
        open_rows = np.arange(n)
        while len(open_rows):
            lo, hi, mine = left[open_rows], right[open_rows], own[open_rows]
            below = mine - self.sums[np.maximum(lo, 0)]
            above = self.sums[np.minimum(hi, last)] - mine
            up = (lo < 0) | ((hi <= last) & (above <= below))
            gap = np.where(up, above, below)
            first = index[open_rows] < 0
            go = first | ((gap * gap) <= self.width * best[open_rows])
            go = go.astype(bool)
            open_rows, up = open_rows[go], up[go]
            at = np.where(up, right[open_rows], left[open_rows])
            away = parts[open_rows] - self.entries[at]
            distance = (away * away).sum(axis=1)
            entry = self.order[at]
            held, known = best[open_rows], index[open_rows]
            better = ((known < 0) | (distance < held) | ((distance == held) & (entry < known))).astype(bool)
            best[open_rows[better]], index[open_rows[better]] = distance[better], entry[better]
            right[open_rows[up]] += 1
            left[open_rows[~up]] -= 1
            open_rows = open_rows[(left[open_rows] >= 0) | (right[open_rows] <= last)]
        return index, best


def books_of(books: Books, width: int) -> list[Codebook]:
    return [Codebook(entries, width) for entries in books]


def digits(value: int) -> Iterator[tuple[int, int]]:
    """Signed digits of a whole number, by place."""
    sign, rest, place = (-1, -value, 0) if value < 0 else (1, value, 0)
    while rest:
        if rest & ((1 << DIGIT_BITS) - 1):
            yield place, sign * (rest & ((1 << DIGIT_BITS) - 1))
        rest >>= DIGIT_BITS
        place += 1


SUMS = "part int, entry int, component int, digit int, value long"


def part_sums(books: Books, width: int):
    """For mapInArrow: how many parts of a task each entry has (component -1), and the sums of their components."""
    n_parts, n_entries = len(books), len(books[0])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = books_of(books, width)
        n = np.zeros((n_parts, n_entries), np.int64)
        sums = np.zeros((n_parts, n_entries, width), object)
        for batch in batches:
            for _, made in part_arrays(batch.column(0), n_parts, width):
                for p, book in enumerate(held):
                    index, _ = book.nearest(made[:, p])
                    n[p] += np.bincount(index, minlength=n_entries)
                    for e in np.unique(index):
                        sums[p, e] += made[index == e, p].sum(axis=0)
        out = [(p, e, -1, 0, int(n[p, e])) for p, e in zip(*np.nonzero(n))]
        out += [(p, e, c, d, v) for p, e in zip(*np.nonzero(n)) for c in range(width) for d, v in digits(int(sums[p, e, c]))]
        columns = list(zip(*out)) if out else [[]] * 5
        types = [pa.int32()] * 4 + [pa.int64()]
        names = ["part", "entry", "component", "digit", "value"]
        yield pa.RecordBatch.from_arrays([pa.array(map(int, c), t) for c, t in zip(columns, types)], names=names)

    return rows


def moved(books: Books, sums: list, width: int) -> Books:
    """Each entry as the floor of the mean of its parts; unused entries stay."""
    n: dict[tuple[int, int], int] = {}
    total: dict[tuple[int, int], list[int]] = {}
    for p, e, c, d, value in sums:
        if c < 0:
            n[p, e] = value
        else:
            total.setdefault((p, e), [0] * width)[c] += value << (DIGIT_BITS * d)
    zero = [0] * width
    return [[[t // n[p, e] for t in total.get((p, e), zero)] if (p, e) in n else old for e, old in enumerate(entries)] for p, entries in enumerate(books)]


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Books, int]:
    """The codebooks after all rounds, and the width of a part. ``vectors`` as from ``finite_vectors``.

    They start as the parts of the first rows by vec_id (null ids last, then by vector). Fewer rows give fewer entries,
    no rows none.
    """
    width = max(1, -(-(vectors.agg(F.max(F.size("x"))).first()[0] or 0) // parts))
    first = [r["x"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]  # a few rows
    starts = [[whole(c) for c in x] + [0] * (parts * width - len(x)) for x in first]
    books = [[x[p * width : (p + 1) * width] for x in starts] for p in range(parts)]
    for _ in range(rounds if starts else 0):
        summed = (
            vectors.select("x").mapInArrow(part_sums(books, width), SUMS).groupBy("part", "entry", "component", "digit").agg(F.sum("value").alias("value"))
        )
        books = moved(books, summed.collect(), width)  # parts x entries x width numbers
    return books, width


CODED = pa.schema([("code", pa.string()), ("error", pa.int64())])


def coder(books: Books, width: int, kept: list[str]):
    """For mapInArrow: the kept columns with each vector's code and error."""
    most = (1 << 63) - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = books_of(books, width)
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, len(books)), np.uint8), np.zeros(batch.num_rows, object)
            for at, made in part_arrays(batch.column(batch.schema.get_field_index("x")), len(books), width):
                for p, book in enumerate(held):
                    index, distance = book.nearest(made[:, p])
                    codes[at, p] = index
                    errors[at] += distance.astype(object)
            code = [bytes(row).hex() for row in codes]
            error = [int(e) if e <= most else None for e in errors]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(code, pa.string()), pa.array(error, pa.int64())],
                names=[*kept, "code", "error"],
            )

    return rows


def digest(books: Books) -> str:
    """Of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for entries in books for e in entries for c in e).encode()).hexdigest()


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every row with a usable vector.

    - Rows whose vector is null or holds a null or non-finite component are dropped; all other rows stay, repeated ids and null
      ids too (these come last when codebooks start). Other columns of ``df`` play no part, whatever their names.
    - Shorter vectors, and the last part of a length that the parts do not divide, are filled with zeros.
    - ``code`` has two hex digits a part; an equally near entry of lower index wins. ``error`` is the sum of squared distances,
      null if it exceeds a long. ``label_error`` sums it over equal labels, null labels together; null if one of them is null or
      the sum exceeds a long.
    - An empty table, or one without usable rows, gives no rows. Rows are read once a round, and never shuffled.
    """
    vectors = finite_vectors(df, vec_id, vector, label)
    books, width = train(vectors)
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    if not books or not books[0]:
        return df.sparkSession.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string")
    coded = stored(vectors.mapInArrow(coder(books, width, ["vec_id", "label"]), schema), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    summed = F.when((F.count("error") == F.count(F.lit(1))) & (total <= F.lit((1 << 63) - 1)), total.cast("long"))
    by_label = stored(coded.groupBy(F.col("label").alias("of_label")).agg(summed.alias("label_error")), "label-errors")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
