"""Removal of repeated runs of sentences.

A run counts from LEAST_SENTENCES sentences on, whatever their words, and one sentence alone from LONG_WORDS words on. Of each
run that counts, only the shortest spans are hashed: one that starts at each sentence and one that ends at each. Any longer run
that repeats, sentence by sentence, is covered by spans inside it: a sentence whose own span would reach past the run's end
lies in the span that ends there. Spans are compared by the fingerprint of their words, A-Z lower-cased. All spans meet in
shards by fingerprint; a span that repeats an earlier one, in document order, removes its sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from larkspur.llm import arrays as A
from larkspur.llm.suffix import MOST_DOCS, REPEATED, STRETCHES_DDL, by_document, dealt_stretches, keyed, scan_stretches
from larkspur.session import stored

LEAST_SENTENCES = 2
LONG_WORDS = 50
SHARD_BYTES = 64_000_000
LEAST_SHARDS = 32

# What ends a sentence at the end of a word.
ENDS = A.byte_flags(b".!?")
WIDE_ENDS = ("。".encode(), "！".encode(), "？".encode())


def sentence_starts(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first word of each sentence; sentences end at a full stop, at a line's end or with their text."""
    last = ends - 1
    closes = ENDS[data[last]]
    for wide in WIDE_ENDS:
        closes |= (data[last] == wide[2]) & (data[np.maximum(last - 1, 0)] == wide[1]) & (data[np.maximum(last - 2, 0)] == wide[0])
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(len(starts), bool)
    opens[1:] = closes[:-1] | (feeds[starts[1:]] > feeds[ends[:-1]])
    opens[first[:-1][first[:-1] < len(starts)]] = True
    return np.flatnonzero(opens)


def span_bounds(data: np.ndarray, bounds: np.ndarray, least_words: int) -> tuple[np.ndarray, ...]:
    """Of each span: text, number within the text by start and end, first sentence within the text, end sentence, first word, end
    word; then the sentences' first bytes, and the words' starts and ends."""
    starts, ends, first = A.words(data, bounds)
    opens = sentence_starts(data, bounds, starts, ends, first)
    of_text = np.searchsorted(opens, first)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(of_text))
    edges = np.append(opens, len(starts))
    low = np.arange(len(opens))
    high = np.maximum(np.searchsorted(edges, opens + least_words), low + LEAST_SENTENCES)
    long = np.diff(edges) >= LONG_WORDS
    high = np.where(long, low + 1, high)
    end = low + 1
    start = np.minimum(np.searchsorted(edges, edges[1:] - least_words, "right") - 1, end - LEAST_SENTENCES)
    start = np.where(long, low, start)
    new = high[np.maximum(start, 0)] != end  # not the span that its first sentence has anyway
    new &= start >= of_text[text]
    whole = high <= of_text[text + 1]
    low, high = np.concatenate([low[whole], start[new]]), np.concatenate([high[whole], end[new]])
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    text = text[low]
    number = np.arange(len(text)) - np.searchsorted(text, text)
    return text, number, low - of_text[text], high - of_text[text], opens[low], edges[high], starts[opens], starts, ends


def spans(data: np.ndarray, bounds: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each span: fingerprint, text, number within the text."""
    text, number, _, _, a, b, _, starts, ends = span_bounds(data, bounds, least_words)
    sums = np.zeros(len(starts) + 1, A.U64)
    up, down = A.powers(len(starts) + 1)
    np.cumsum(A.Fingerprints(data, A.LOWER).of(starts, ends) * up[: len(starts)], out=sums[1:])
    return A.mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(A.U64) * A.U64(A.STEPS[20])), text, number


def span_rows(shards: int, least_words: int):
    """For mapInArrow over (doc, tie, text): the spans of each batch, one row per shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, MOST_DOCS):
                batch = whole.slice(lo, MOST_DOCS)
                docs = np.asarray(batch.column("doc"), np.int64), np.asarray(batch.column("tie"), np.int64)
                found = []
                for row, _, data, bounds in A.slices(batch.column("text")):
                    prints, text, number = spans(data, bounds, least_words)
                    found.append((prints, text + row, number))
                if found and sum(len(f[0]) for f in found):
                    yield dealt_stretches(*(np.concatenate(c) for c in zip(*found)), docs, shards)
            A.release()

    return rows


CUT = StructType([StructField("n_sentences", LongType()), StructField("n_removed", LongType()), StructField("n_runs", LongType()), StructField("kept", StringType())])


def cut(least_words: int):
    """What is left of each text without the sentences of the given spans."""

    @F.arrow_udf(CUT)
    def left(texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        out = []
        for text, low, high in zip(texts, firsts, lasts):
            raw = text.as_py().encode()
            data = np.frombuffer(raw, np.uint8)
            _, _, sentence, end, _, _, places, _, _ = span_bounds(data, np.array([0, len(data)]), least_words)
            if not low.is_valid or not len(low):
                out.append((len(places), 0, 0, text.as_py()))
                continue
            gone = np.zeros(len(places), bool)
            for a, b in zip(low.values.to_pylist(), high.values.to_pylist()):
                for k in range(a, b + 1):
                    gone[sentence[k] : end[k]] = True
            edges = np.append(places, len(data))
            kept = [raw[: edges[0]]] + [raw[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone)]
            runs = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
            out.append((len(places), int(gone.sum()), runs, b"".join(kept).decode()))
        A.release()
        kinds = [("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64()), ("kept", pa.string())]
        return pa.StructArray.from_arrays([pa.array([o[k] for o in out], kind) for k, (_, kind) in enumerate(kinds)], fields=list(pa.struct(kinds)))

    return left


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 0) -> DataFrame:
    """Per row (doc_id, n_sentences, n_removed, n_runs, kept): ``kept`` is the text without repeated sentences.

    ``least_words`` is how many words a run of several sentences has at least, for callers that let short ones stay. Spans are judged on
    the input. Null and empty texts have no sentences; texts of fewer sentences or words than a span are left alone. A very long
    text is a slice of its own, in arrays that grow with its words. Null ids come first; rows of one doc_id come in order of a
    fingerprint of their text, and rows alike in both are one document with one result. Other columns are ignored. An empty
    table gives no rows.
    """
    texts = keyed(docs, doc_id, text)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    found = texts.mapInArrow(span_rows(shards, least_words), STRETCHES_DDL).groupBy("shard").applyInArrow(scan_stretches, REPEATED)
    runs = by_document(stored(found, "spans"))
    both = texts.join(runs, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left")
    done = both.select(F.nullif("doc", F.lit(-(1 << 63))).alias("doc_id"), cut(least_words)("text", "firsts", "lasts").alias("c"))
    return done.select("doc_id", "c.*")
