"""Exact top-k search by inner product with MaxScore.

Vectors are integer; a dimension is a term. In a shard of rows a term has two postings lists, one per sign, with its components
by impact, the largest first. A query walks the lists of its own signs, which hold all that can raise a score, and a term's bound
is the head of its list. Per query and shard, terms are split by their bounds: non-essential ones cannot, all together, reach
the best k so far, so that only rows in the essential lists come into question. Those lists are traversed; what else counts for
the rows found is probed from the largest bound on, only for rows still competitive. Shards' results are merged.

Rows and queries whose components are too large for exact doubles are scored in Python integers, only they.

Queries go out in blocks of a fixed number of rows, so that what is sent to all tasks is bounded. Each block is one pass over the rows
and is written before the next one is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.codes import whole
from larkspur.session import run_dir, stored

BLOCK_QUERIES = 20_000
SHARD_ROWS = 4096
PROBE = 8
SCALE = 256
#: Sums of products of integers are exact as doubles below it.
EXACT = 1 << 53
LONG = (1 << 63) - 1
#: Scores beyond a long are ordered by this many big-endian bytes, after adding half their range.
KEY_BYTES = 320


def finite_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Rows (row, vec_id, x array<double>) of vectors that are searched; ``row`` is a number of their own.

    Rows with a null id, a null vector, or a null or non-finite component take no part. All others do, whatever their size, and rows of
    one vec_id are rows like any others. The table is written once, so that row numbers hold. Other columns play no part.
    """
    x = F.col(vector).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    usable = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, finite)
    found = df.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"), "vectors")


def most_small(width: int) -> int:
    """Integers up to it have exact inner products as doubles."""
    return math.isqrt((EXACT - 1) // max(width, 1))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, short ones filled with zeros."""
    sizes = np.diff(np.asarray(column.offsets, np.int64))
    out = np.zeros((len(column), width))
    out[np.arange(width) < np.minimum(sizes, width)[:, None]] = np.asarray(column.flatten(), np.float64)
    return out


def integers(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x): places and rows of small ones as doubles, places and rows of the others as Python integers."""
    small = (np.abs(x) <= most_small(x.shape[1]) / scale - 1).all(axis=1)
    few, many = np.flatnonzero(small), np.flatnonzero(~small)
    large = np.array([[whole(c, scale) for c in row] for row in x[many].tolist()], dtype=object).reshape(len(many), x.shape[1])
    return few, np.floor(x[few] * scale), many, large


class Shard:
    """Rows of small integers with postings per dimension and sign."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.lists: list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]] = []
        for column in rows.T:
            order = np.argsort(column, kind="stable")
            ordered = column[order]
            below, above = np.searchsorted(ordered, 0, "left"), np.searchsorted(ordered, 0, "right")
            self.lists.append(((order[above:][::-1], ordered[above:][::-1]), (order[:below], ordered[:below])))
        heads = [[values[0] if len(values) else 0.0 for _, values in both] for both in self.lists]
        self.high, self.low = np.array(heads).reshape(-1, 2).T

    def search(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of all rows whose score is ``least`` at the least."""
        if least <= 0 or not len(q):  # rows in no list of the query may do
            score = self.rows @ q
            at = np.flatnonzero(score >= least)
            return at, score[at]
        bounds = np.maximum(np.maximum(q * self.high, q * self.low), 0)
        order = np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[order])
        split = int(np.searchsorted(reach, least, "left"))
        if split == len(q):
            return np.zeros(0, np.int64), np.zeros(0)
        essential = order[split:]
        places, impacts = [], []
        for d in essential.tolist():
            at, values = self.lists[d][0 if q[d] > 0 else 1]
            impact = values * q[d]
            spare = least - (reach[-1] - bounds[d])
            if spare > 0:  # rows further down the list cannot reach the threshold with all other bounds
                n = int(np.searchsorted(-impact, -spare, "right"))
                at, impact = at[:n], impact[:n]
            places.append(at)
            impacts.append(impact)
        raised = np.bincount(np.concatenate(places), np.concatenate(impacts), len(self.rows))
        left = reach[split - 1] if split else 0.0
        at = np.flatnonzero((raised > 0) & (raised + left >= least))
        # What lowers the score in essential terms, then all of the others.
        score = np.zeros(len(at))
        for lo in range(0, len(essential), 2 * PROBE):
            step = essential[lo : lo + 2 * PROBE]
            score += np.minimum(self.rows[np.ix_(at, step)] * q[step], 0).sum(axis=1)
            keep = raised[at] + score + left >= least
            at, score = at[keep], score[keep]
        score += raised[at]
        while split and len(at):
            step = order[max(split - PROBE, 0) : split]
            score += self.rows[np.ix_(at, step)] @ q[step]
            split -= len(step)
            keep = score + (reach[split - 1] if split else 0.0) >= least
            at, score = at[keep], score[keep]
        keep = score >= least
        return at[keep], score[keep]


class Best:
    """The best k (score, id) of one query; equal scores prefer the smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0)

    @property
    def least(self) -> float:
        if len(self.scores) < self.k:
            return -math.inf
        return float(max(min(self.scores[-1], 2 * EXACT), -2 * EXACT))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        if scores.dtype == object:
            made = [int(s) for s in scores]
            order = np.array(sorted(range(len(made)), key=lambda n: (-made[n], ids[n]))[: self.k], np.int64)
            scores = np.array(made, dtype=object)
        else:
            if len(scores) > 4 * self.k:
                limit = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                ids, scores = ids[scores >= limit], scores[scores >= limit]
            order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


OUT = pa.schema(
    [("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.int32()), ("key", pa.binary())]
)
OUT_DDL = "query long, query_id long, vec_id long, score long, beyond int, key binary"


def found_rows(queries: list[tuple[int, int]], best: list[Best]) -> pa.RecordBatch:
    """Scores beyond a long have ``beyond`` 1 or -1 and a key of their order."""
    columns: list[list] = [[] for _ in OUT]
    for (row, vec_id), held in zip(queries, best):
        for i, s in zip(held.ids.tolist(), held.scores.tolist()):
            s = int(s)
            beyond = (s > LONG) - (s < -LONG - 1)
            key = (s + (1 << (8 * KEY_BYTES - 1))).to_bytes(KEY_BYTES, "big") if beyond else None
            for column, value in zip(columns, (row, vec_id, i, None if beyond else s, beyond, key)):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT)], schema=OUT)


def block_search(queries: list[tuple[int, int, list[float]]], k: int, scale: int):
    """A function for mapInArrow that finds each query's best k rows of a task."""
    width = max((len(x) for *_, x in queries), default=0)
    asked = np.zeros((len(queries), width))
    for n, (*_, x) in enumerate(queries):
        asked[n, : len(x)] = x

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, small, many, large = integers(asked, scale)
        own = np.array([q[0] for q in queries], np.int64)
        best = [Best(k) for _ in queries]

        def offer(n: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
            other = rows != own[n]
            if other.any():
                best[n].add(ids[other], scores[other])

        for batch in batches:
            for lo in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(lo, SHARD_ROWS)
                rows, ids = (np.asarray(part.column(c), np.int64) for c in ("row", "vec_id"))
                at_small, held, at_large, wide = integers(matrix(part.column("x"), width), scale)
                if len(at_small):
                    shard = Shard(held)
                    for n, q in zip(few.tolist(), small):
                        at, scores = shard.search(q, best[n].least)
                        offer(n, rows[at_small[at]], ids[at_small[at]], scores)
                    if len(many):
                        exact = held.astype(np.int64).astype(object)
                        for n, q in zip(many.tolist(), large):
                            offer(n, rows[at_small], ids[at_small], exact @ q)
                if len(at_large):
                    for n, q in [*zip(few.tolist(), small.astype(np.int64).astype(object)), *zip(many.tolist(), large)]:
                        offer(n, rows[at_large], ids[at_large], wide @ q)
        if any(len(b.ids) for b in best):
            yield found_rows([q[:2] for q in queries], best)

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK_QUERIES, scale: int = SCALE) -> DataFrame:
    """Each query's k best rows (query_id, rank, vec_id, score) among all ``vectors`` but the query itself.

    The score is the inner product of floor(scale * x). Both inputs are as ``finite_vectors`` returns them; a query leaves out the one
    row of its own number, so a repeated vec_id is a candidate and, as a query, has its own k rows. Ties go to the smaller vec_id.
    Missing components count as zero; components past the longest query count for nothing. Scores are exact at any size: those
    beyond a long have their rank and a null score. Without queries or rows the result is empty; a query with fewer than k
    candidates has them all.
    """
    spark = vectors.sparkSession
    blocks = max(1, math.ceil(queries.count() / block))
    path = run_dir(spark, "queries")
    queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).write.partitionBy("block").parquet(path)
    dealt = spark.read.schema("row long, vec_id long, x array<double>, block long").parquet(path)
    found = run_dir(spark, "found")
    spark.createDataFrame([], OUT_DDL).write.parquet(found)
    for number in range(blocks):
        own = [(r["row"], r["vec_id"], r["x"]) for r in dealt.where(F.col("block") == number).collect()]  # one block of bounded size
        if own:
            vectors.mapInArrow(block_search(own, k, scale), OUT_DDL).write.mode("append").parquet(found)
    ordered = Window.partitionBy("query").orderBy(F.desc("beyond"), F.desc("key"), F.desc("score"), "vec_id")
    merged = spark.read.schema(OUT_DDL).parquet(found).withColumn("rank", F.row_number().over(ordered))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
