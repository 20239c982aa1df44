"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A suffix is sampled where the fingerprint of its first GRAM bytes is the smallest within a stretch of SIZE bytes. Equal
stretches choose the same place, so every repeated stretch is found at a sampled suffix. A sample stands for the run of
stretches that chose it; its key is the fingerprint of its first GRAM bytes, its code that of all bytes of that run.

Samples are dealt to shards by the first bits of their key. Of equal codes in one batch of documents only the earliest goes there
to be compared; the others are known to repeat it, and any shard carries them, so that a passage that many documents hold
sends one sample per batch to its shard. A shard takes its samples in batches of document order. Each
batch gets a sorted array, which is scanned against the sorted levels: a sample whose code is there already repeats an
earlier one in all its stretches. New codes become a level, and levels of one size class are merged, so that a shard holds
a logarithmic number of them. Last, samples that agree in the key but not in the code are handed out again: their bytes go
to the shard of their key, which takes the fingerprint of each of their stretches and marks later ones of equal
stretches. Samples of a key that HOT ones have are dealt by the fingerprints of their stretches instead, so that no shard gets
them all.

A suffix array of every byte would shuffle 16 bytes per byte of text; sampled ones need 19 bytes per sample, about 0.5 per
byte. Codes and stretches have 64 bits each. Keys have 32 bits beside the shard number; equal keys of unequal grams only
cause more comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from larkspur.llm import arrays as A
from larkspur.llm.jaccard import joined, lengths, packed
from larkspur.session import stored

SIZE = 100
GRAM = 32
WITHIN = SIZE - GRAM + 1
PLACES = A.U64((1 << 28) - 1)
SHARD_BYTES = 16_000_000
LEAST_SHARDS = 32
BATCH_SAMPLES = 100_000
#: Documents that one packed row names at most; it bounds the arrays of a task, too.
MOST_DOCS = 2048
#: Set beside the number of further stretches of a sample that is known to repeat an earlier one.
KNOWN = np.uint8(128)
KNOWN_TOGETHER = 512
#: From so many samples of one key on, their stretches are spread by fingerprint, which takes several times the bytes.
HOT = 1000
#: In place of the shard that an open sample's bytes go to: it is not open, or it is spread.
DONE, SPREAD = -2, -1


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc, tie, text): documents are ordered by doc, null first, then by a fingerprint of their text."""
    text = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of ``size`` consecutive values at each position where so many follow."""
    span = 1
    while 2 * span <= size:
        values = np.minimum(values[:-span], values[span:]) if len(values) > span else values[:0]
        span *= 2
    rest = size - span
    return np.minimum(values[:-rest], values[rest:]) if rest and len(values) > rest else values[: len(values) if not rest else 0]


def whole_stretches(bounds: np.ndarray, n: int) -> np.ndarray:
    """Flags of the first ``n`` positions from which SIZE bytes lie within one text."""
    edge = np.zeros(n + SIZE + 1, np.int32)
    np.add.at(edge, np.maximum(bounds[:-1], bounds[1:] - SIZE + 1), 1)
    np.add.at(edge, bounds[1:], -1)
    return np.cumsum(edge)[:n] == 0


def sample(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Code, text, first stretch, last stretch (from the first one), key and shard bits of each sample."""
    n = len(data) - SIZE + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    prints = A.Fingerprints(data)
    grams = prints.grams(GRAM)
    least = sliding_least((grams & ~PLACES) | np.arange(len(grams), dtype=A.U64), WITHIN)[:n]
    starts = np.flatnonzero(whole_stretches(bounds, n))
    place = (least[starts] & PLACES).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    first, last = starts[edge], starts[np.append(edge[1:], len(starts)) - 1] if len(edge) else starts
    code = prints.of(first, last + SIZE)
    chosen = A.mixed(grams[place[edge]])  # the chosen fingerprints are small ones, so they are spread again
    key = chosen.astype(np.uint32)
    shard = chosen >> A.U64(40)
    text = np.searchsorted(bounds, first, "right") - 1
    return code, text, first - bounds[text], last - first, key, shard


def known_repeats(code: np.ndarray, at: np.ndarray, first: np.ndarray, docs: tuple) -> np.ndarray:
    """Flags of the samples of a batch whose code an earlier one of the batch has. The earliest of a code is not flagged, nor are
    samples of rows that are alike in all, at the same place: they are one document."""
    place = ordered_docs(*docs)[0][at]
    order = np.lexsort((first, place, code))
    ordered, place, first = code[order], place[order], first[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    lead = np.repeat(head, np.diff(np.append(head, len(ordered))))
    flags = np.zeros(len(code), bool)
    flags[order] = (place != place[lead]) | (first != first[lead])
    return flags


def dealt(names: dict[str, object], shard: np.ndarray, shards: int, at: np.ndarray, docs: tuple, columns: dict[str, np.ndarray]):
    """One row per shard that has any: the documents it names, and the packed columns in order of the shard."""
    order = np.argsort(shard, kind="stable")
    shard, at = shard[order], at[order]
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    out: dict[str, list] = {name: [] for name in names}
    for s in range(shards):
        part = order[cuts[s] : cuts[s + 1]]
        if not len(part):
            continue
        here = np.zeros(len(docs[0]), bool)
        here[at[cuts[s] : cuts[s + 1]]] = True
        out["shard"].append(s)
        out["docs"].append(packed(docs[0][here]))
        out["ties"].append(packed(docs[1][here]))
        out["at"].append(packed((np.cumsum(here) - 1)[at[cuts[s] : cuts[s + 1]]].astype(np.uint16)))
        for name, values in columns.items():
            out[name].append(packed(values[part]))
    return pa.RecordBatch.from_arrays([pa.array(out[n], kind) for n, kind in names.items()], names=list(names))


SAMPLES = {k: pa.int32() if k == "shard" else pa.binary() for k in ("shard", "docs", "ties", "at", "code", "key", "first", "more")}
SAMPLES_DDL = "shard int, docs binary, ties binary, at binary, code binary, key binary, first binary, more binary"


def sample_rows(shards: int):
    """For mapInArrow over (doc, tie, text): the samples of each batch, one row per shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, MOST_DOCS):
                batch = whole.slice(lo, MOST_DOCS)
                docs = np.asarray(batch.column("doc"), np.int64), np.asarray(batch.column("tie"), np.int64)
                found = []
                for row, _, data, bounds in A.slices(batch.column("text")):
                    got = sample(data, bounds)
                    if len(got[0]):
                        found.append((got[0], got[1] + row, got[2].astype(np.uint32), got[3].astype(np.uint8), got[4], got[5]))
                if found:
                    code, at, first, more, key, high = (np.concatenate(c) for c in zip(*found))
                    shard = ((high * A.U64(shards)) >> A.U64(24)).astype(np.int64)
                    known = known_repeats(code, at, first, docs)
                    # A document's known ones stay together, so that few rows name it, but for very many of them.
                    shard = np.where(known, (at + np.arange(len(known)) // KNOWN_TOGETHER) % shards, shard)
                    more = np.where(known, more | KNOWN, more)
                    code, key = np.where(known, A.U64(0), code), np.where(known, np.uint32(0), key)  # no longer of use
                    yield dealt(SAMPLES, shard, shards, at, docs, {"code": code, "key": key, "first": first, "more": more})
            A.release()

    return rows


def ordered_docs(docs: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' places in order, equal ones alike, and one position of each place."""
    order = np.lexsort((ties, docs))
    new = np.ones(len(order), bool)
    new[1:] = (docs[order][1:] != docs[order][:-1]) | (ties[order][1:] != ties[order][:-1])
    place = np.zeros(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, order[new]


class Levels:
    """Sorted arrays of codes with the sample that holds each first, of sizes that grow geometrically."""

    def __init__(self):
        self.arrays: list[tuple[np.ndarray, np.ndarray]] = []

    def known(self, codes: np.ndarray) -> np.ndarray:
        """Flags of the sorted codes that some level holds."""
        found = np.zeros(len(codes), bool)
        for held, _ in self.arrays:
            at = np.minimum(np.searchsorted(held, codes), len(held) - 1)
            found |= held[at] == codes
        return found

    def add(self, codes: np.ndarray, samples: np.ndarray) -> None:
        """A new level of sorted codes; levels of its size class are merged with it."""
        while len(codes) and self.arrays and len(self.arrays[-1][0]).bit_length() <= len(codes).bit_length():
            codes, samples = self.merge((codes, samples), self.arrays.pop())
        if len(codes):
            self.arrays.append((codes, samples))

    @staticmethod
    def merge(*parts) -> tuple[np.ndarray, np.ndarray]:
        codes, samples = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(codes, kind="stable")
        return codes[order], samples[order]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return self.merge(*self.arrays) if self.arrays else (np.zeros(0, A.U64), np.zeros(0, np.int64))


FOUND = "doc long, tie long, first long, last long, goes int"
FOUND_NAMES = ("doc", "tie", "first", "last", "goes")


def scan_shard(table: pa.Table) -> pa.Table:
    """For applyInArrow on one shard: runs of stretches that repeat an earlier run, and runs that are open, with where they go."""
    heads = lengths(table.column("docs"), np.int64)
    base = np.repeat(np.cumsum(heads) - heads, lengths(table.column("at"), np.uint16))
    docs, ties = joined(table.column("docs"), np.int64), joined(table.column("ties"), np.int64)
    place, named = ordered_docs(docs, ties)
    at = place[base + joined(table.column("at"), np.uint16)]
    code, key = joined(table.column("code"), np.uint64), joined(table.column("key"), np.uint32)
    first, more = joined(table.column("first"), np.uint32), joined(table.column("more"), np.uint8)
    known = more >= KNOWN
    carried = at[known], first[known].astype(np.int64), (more[known] ^ KNOWN).astype(np.int64)
    code, key, at, first, more = (x[~known] for x in (code, key, at, first, more))
    order = np.lexsort((first, at))
    new = np.ones(len(order), bool)  # rows that are alike in all are one document
    new[1:] = (at[order][1:] != at[order][:-1]) | (first[order][1:] != first[order][:-1])
    order = order[new]
    code, key, at, first, more = code[order], key[order], at[order], first[order].astype(np.int64), more[order].astype(np.int64)
    levels, repeats = Levels(), []
    for lo in range(0, len(code), BATCH_SAMPLES):
        batch = code[lo : lo + BATCH_SAMPLES]
        order = np.argsort(batch, kind="stable")  # equal codes keep the documents' order
        codes = batch[order]
        again = np.zeros(len(codes), bool)
        again[1:] = codes[1:] == codes[:-1]
        again |= levels.known(codes)
        repeats.append(lo + order[again])
        levels.add(codes[~again], lo + order[~again])
    samples = levels.all()[1]
    samples = samples[np.argsort(key[samples], kind="stable")]
    key = key[samples]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    open_ones = same[1:] | same[:-1]
    left = samples[open_ones]
    head = np.flatnonzero(~same[:-1])
    alike = np.repeat(np.diff(np.append(head, len(key))), np.diff(np.append(head, len(key))))
    goes = np.where(alike >= HOT, SPREAD, table.column("shard")[0].as_py() if table.num_rows else 0)[open_ones]
    repeats = np.concatenate(repeats) if repeats else np.zeros(0, np.int64)
    chosen = np.concatenate([repeats, left])
    at, first, more = (np.concatenate([c, x[chosen]]) for c, x in zip(carried, (at, first, more)))
    doc = named[at]
    A.release()
    return pa.Table.from_arrays(
        [
            pa.array(docs[doc]), pa.array(ties[doc]), pa.array(first), pa.array(first + more),
            pa.array(np.concatenate([np.full(len(at) - len(left), DONE), goes]).astype(np.int32)),
        ],
        names=list(FOUND_NAMES),
    )


STRETCHES = {k: pa.int32() if k == "shard" else pa.binary() for k in ("shard", "docs", "ties", "at", "print", "first", "known")}
STRETCHES_DDL = "shard int, docs binary, ties binary, at binary, print binary, first binary, known binary"


def dealt_stretches(prints: np.ndarray, at: np.ndarray, first: np.ndarray, docs: tuple, shards: int) -> pa.RecordBatch:
    """One row per shard with the stretches of a batch, given by fingerprint, document and place.

    Of equal stretches only the earliest is compared further; the others are known to repeat it.
    """
    order = np.lexsort((first, ordered_docs(*docs)[0][at], prints))
    prints, at, first = prints[order], at[order], first[order]
    known = np.zeros(len(prints), np.uint8)
    known[1:] = prints[1:] == prints[:-1]
    # Known ones need no comparison, so any shard may carry them.
    shard = ((prints >> A.U64(40)) * A.U64(shards) >> A.U64(24)).astype(np.int64)
    shard = np.where(known == 1, np.arange(len(prints)) % shards, shard)
    return dealt(STRETCHES, shard, shards, at, docs, {"print": prints, "first": first.astype(np.uint32), "known": known})


OPEN = STRETCHES | {"more": pa.binary(), "text": pa.binary()}
OPEN_DDL = f"{STRETCHES_DDL}, more binary, text binary"


def bytes_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the given stretches, one after the other."""
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def dealt_bytes(data: np.ndarray, at: np.ndarray, first: np.ndarray, more: np.ndarray, goes: np.ndarray, docs: tuple, shards: int) -> pa.RecordBatch:
    """One row per shard with the open runs that go there; ``data`` has the bytes of all runs."""
    ends = np.cumsum(more + SIZE)
    batch = dealt(
        {k: kind for k, kind in OPEN.items() if k not in ("print", "known")}, goes, shards, at, docs,
        {"first": first.astype(np.uint32), "more": more.astype(np.uint8), "text": np.arange(len(at), dtype=np.int32)},
    )
    runs = [np.frombuffer(x.as_py(), np.int32) for x in batch.column("text")]
    texts = pa.array([packed(bytes_of(data, (ends - more - SIZE)[x], (more + SIZE)[x])) for x in runs], pa.binary())
    none = pa.nulls(batch.num_rows, pa.binary())
    columns = {k: batch.column(k) for k in batch.schema.names} | {"text": texts, "print": none, "known": none}
    return pa.RecordBatch.from_arrays([columns[k] for k in OPEN], names=list(OPEN))


def open_rows(shards: int):
    """For mapInArrow over (doc, tie, text, firsts, lasts, goes): each open run's bytes or stretches, one row of each per shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, MOST_DOCS):
                batch = whole.slice(lo, MOST_DOCS)
                docs = np.asarray(batch.column("doc"), np.int64), np.asarray(batch.column("tie"), np.int64)
                ends = np.asarray(batch.column("firsts").offsets, np.int64)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                low, high, goes = (np.asarray(batch.column(c).values, np.int64)[ends[0] : ends[-1]] for c in ("firsts", "lasts", "goes"))
                found, held = [], []
                for row, end, data, bounds in A.slices(batch.column("text")):
                    part = slice(*np.searchsorted(owner, [row, end]))
                    at, first, more, to = owner[part], low[part], high[part] - low[part], goes[part]
                    place = first + bounds[at - row]
                    if (there := to != SPREAD).any():
                        held.append((bytes_of(data, place[there], more[there] + SIZE), at[there], first[there], more[there], to[there]))
                    if not there.all():
                        size = more[~there] + 1
                        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        place = np.repeat(place[~there], size) + step
                        prints = A.Fingerprints(data).of(place, place + SIZE)
                        found.append((prints, np.repeat(at[~there], size), np.repeat(first[~there], size) + step))
                if held:
                    yield dealt_bytes(*(np.concatenate(c) for c in zip(*held)), docs, shards)
                if found:
                    spread = dealt_stretches(*(np.concatenate(c) for c in zip(*found)), docs, shards)
                    none = pa.nulls(spread.num_rows, pa.binary())
                    yield pa.RecordBatch.from_arrays([*spread.columns, none, none], names=list(OPEN))
            A.release()

    return rows


REPEATED = "doc long, tie long, first long, last long"


def stretch_columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Documents (doc, tie) of packed stretches, and the place among them, fingerprint, first byte and known flag of each stretch."""
    heads = lengths(table.column("docs"), np.int64)
    base = np.repeat(np.cumsum(heads) - heads, lengths(table.column("at"), np.uint16))
    docs, ties = joined(table.column("docs"), np.int64), joined(table.column("ties"), np.int64)
    at = base + joined(table.column("at"), np.uint16)
    prints, first = joined(table.column("print"), np.uint64), joined(table.column("first"), np.uint32).astype(np.int64)
    return docs, ties, at, prints, first, joined(table.column("known"), np.uint8) == 1


def byte_columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    """The same of packed runs given by their bytes."""
    found = []
    base = 0
    for row in table.select(["docs", "ties", "at", "first", "more", "text"]).to_batches():
        for docs, ties, at, first, more, text in zip(*(row.column(k) for k in range(row.num_columns))):
            docs, ties = np.frombuffer(docs.as_py(), np.int64), np.frombuffer(ties.as_py(), np.int64)
            at, first = np.frombuffer(at.as_py(), np.uint16), np.frombuffer(first.as_py(), np.uint32).astype(np.int64)
            size = np.frombuffer(more.as_py(), np.uint8).astype(np.int64) + 1
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            begin = np.cumsum(size + SIZE - 1) - (size + SIZE - 1)
            place = np.repeat(begin, size) + step
            prints = A.Fingerprints(np.frombuffer(text.as_py(), np.uint8)).of(place, place + SIZE)
            place, named = ordered_docs(docs, ties)
            known = np.repeat((named[place] != np.arange(len(docs)))[at], size)  # a batch's further rows alike in all, as in dealt_stretches
            found.append((docs, ties, np.repeat(at.astype(np.int64) + base, size), prints, np.repeat(first, size) + step, known))
            base += len(docs)
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.int64, bool)
    return tuple(np.concatenate(c) for c in zip(*found)) if found else tuple(np.zeros(0, kind) for kind in kinds)


def scan_open(table: pa.Table) -> pa.Table:
    """For applyInArrow on one shard of open runs: runs of stretches that also start earlier."""
    with_bytes = pc.is_valid(table.column("text"))
    spread, held = stretch_columns(table.filter(pc.invert(with_bytes))), byte_columns(table.filter(with_bytes))
    held = held[0], held[1], held[2] + len(spread[0]), *held[3:]
    return later_runs(*(np.concatenate(c) for c in zip(spread, held)))


def scan_stretches(table: pa.Table) -> pa.Table:
    """For applyInArrow on one shard of stretches: runs of stretches that also start earlier."""
    return later_runs(*stretch_columns(table))


def later_runs(docs: np.ndarray, ties: np.ndarray, at: np.ndarray, prints: np.ndarray, first: np.ndarray, known: np.ndarray) -> pa.Table:
    """Runs of the stretches that are known or that equal an earlier one."""
    place, named = ordered_docs(docs, ties)
    at = place[at]
    done_at, done_first = at[known], first[known]
    at, first, prints = at[~known], first[~known], prints[~known]
    order = np.lexsort((first, at, prints))
    at, first, prints = at[order], first[order], prints[order]
    again = np.zeros(len(prints), bool)
    # Rows alike in all are one document: the same place is no earlier one.
    head = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
    lead = np.repeat(head, np.diff(np.append(head, len(prints))))
    again = (at != at[lead]) | (first != first[lead])
    at, first = np.concatenate([at[again], done_at]), np.concatenate([first[again], done_first])
    order = np.lexsort((first, at))
    at, first = at[order], first[order]
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] > first[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
    doc = named[at[edge]]
    A.release()
    last = first[np.append(edge[1:], len(first)) - 1] if len(edge) else first
    return pa.Table.from_arrays(
        [pa.array(docs[doc]), pa.array(ties[doc]), pa.array(first[edge]), pa.array(last)], names=["doc", "tie", "first", "last"]
    )


KEPT = StructType(
    [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept", BinaryType())]
)


@F.arrow_udf(KEPT)
def cut(texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
    """What is left of each text without the bytes of the given runs of stretches."""
    sizes, removed, spans, kept = [], [], [], []
    for text, low, high in zip(texts, firsts, lasts):
        data = text.as_py().encode()
        sizes.append(len(data))
        if not low.is_valid or not len(low):
            removed.append(0)
            spans.append(0)
            kept.append(data)
            continue
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, np.asarray(low.values, np.int64), 1)
        np.add.at(edge, np.asarray(high.values, np.int64) + SIZE, -1)
        gone = np.cumsum(edge)[:-1] > 0
        removed.append(int(gone.sum()))
        spans.append(int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))))
        kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
    A.release()
    return pa.StructArray.from_arrays(
        [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
        fields=list(pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])),
    )


def by_document(runs: DataFrame, *more: str) -> DataFrame:
    """The runs of each document as two lists in the same order; further columns are lists of their name."""
    gathered = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last", *more)).alias("runs"))
    return gathered.select(
        F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), F.col("runs.first").alias("firsts"), F.col("runs.last").alias("lasts"),
        *(F.col(f"runs.{c}").alias(c) for c in more),
    )


def repeated_runs(texts: DataFrame) -> DataFrame:
    """Runs (doc, tie, first, last) of positions whose SIZE bytes also start earlier; ``texts`` as from ``keyed``."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    found = stored(
        texts.mapInArrow(sample_rows(shards), SAMPLES_DDL).groupBy("shard").applyInArrow(scan_shard, FOUND), "found"
    )
    opened = by_document(found.where(F.col("goes") != DONE), "goes")
    stretches = texts.join(opened, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie"))).select(
        "doc", "tie", "text", "firsts", "lasts", "goes"
    )
    late = stretches.mapInArrow(open_rows(shards), OPEN_DDL).groupBy("shard").applyInArrow(scan_open, REPEATED)
    return stored(found.where(F.col("goes") == DONE).drop("goes").unionByName(late), "repeats")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row (doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` is the text in UTF-8 without every byte of a
    SIZE-byte string that also starts earlier, in a smaller doc_id or earlier in the same text.

    Strings are judged on the input. Null texts are empty, null ids come first, other columns are ignored. Rows of one
    doc_id with unequal texts come in order of a fingerprint of the text; rows alike in both are one document and have one result.
    A very long text is a slice of its own, in arrays that grow with its bytes. An empty table gives no rows.
    """
    texts = keyed(docs, doc_id, text)
    runs = by_document(repeated_runs(texts))
    both = texts.join(runs, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left")
    done = both.select(F.nullif("doc", F.lit(-(1 << 63))).alias("doc_id"), cut("text", "firsts", "lasts").alias("c"))
    return done.select("doc_id", "c.*")
