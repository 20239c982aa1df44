"""Quality rules with thresholds from mergeable quantile sketches per language and source.

Each text is measured in one pass. The features' quantiles are sketched per language and source. A document whose feature
lies far outside the middle half of its group, or beyond its tails, is rejected. A group's limits are blended by weight with
those of its language, and a language's with those of all documents. Thresholds are a small table, joined to the measured rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from larkspur.llm import arrays as A
from larkspur.llm.components import free_names
from larkspur.session import stored

# The characters counted as symbols, and the base rules' limits.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Lines that are not blank are counted, too, for the share of repeated ones.
COUNTS = (*MEASURES, "n_lines")
TYPE = StructType([StructField(m, LongType()) for m in COUNTS])
IS_SYMBOL = A.byte_flags(SYMBOLS.encode())

#: A group's limits count by its documents, those of its language as so many; likewise for languages and all documents.
BLEND_DOCS = 100
#: A feature may lie so many times the middle half's width outside it; the width counts as so much at least.
REACH = 4.0
LEAST_WIDTH = {"word_length": 1.0, "symbols": 0.05, "dup_lines": 0.08, "repeats": 0.08}
#: Nor may it lie so many times the distance from the median to a tail's quantile beyond that; it counts as so much at least.
TAIL = 0.05
TAIL_REACH = 2.0
LEAST_TAIL = {"word_length": 0.25, "symbols": 0.05, "dup_lines": 0.1, "repeats": 0.1}
SKETCH_K = 400


def measure_slice(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = A.words(data, bounds)
    chars = A.counts(~A.IS_SPACE[data] & ((data & 0xC0) != 0x80), bounds)
    symbols = A.counts(IS_SYMBOL[data], bounds)
    prints = A.Fingerprints(data)

    line_starts, line_ends, text = A.lines(data, bounds)
    full = np.concatenate([[0], np.cumsum(~A.IS_SPACE[data])])
    full = full[line_ends] > full[line_starts]
    keys = A.mixed(prints.of(line_starts[full], line_ends[full]) + text[full].astype(A.U64) * A.U64(A.STEPS[1]))
    kept = np.unique(keys, return_index=True)[1]
    n = len(bounds) - 1
    n_lines = np.bincount(text[full], minlength=n)
    dup_lines = n_lines - np.bincount(text[full][kept], minlength=n)

    keys = A.runs(prints.of(starts, ends), WINDOW)
    keys += A.texts_of(first)[: len(keys)].astype(A.U64) * A.U64(A.STEPS[1])
    at = np.flatnonzero(A.whole_runs(first, WINDOW, len(keys)))
    keys = keys[at]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    repeated = np.zeros(len(starts) + 1, np.int64)
    if len(twice):
        place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = at[twice[place] == keys]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, hit + WINDOW, -1)
    return [np.diff(first), chars, symbols, dup_lines, A.counts(np.cumsum(repeated)[:-1] > 0, first), n_lines]


@F.arrow_udf(TYPE)
def measures(column: pa.Array) -> pa.Array:
    """Counts of each whole text; a null text has none of anything."""
    made = [measure_slice(data, bounds) for _, _, data, bounds in A.slices(column)]
    columns = [np.concatenate(c) for c in zip(*made)] if made else [np.zeros(0, np.int64)] * len(COUNTS)
    A.release()
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], list(COUNTS))


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < LEAST_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MOST_REPEATED * F.col(f"{m}.n_words"))


def features(m: str) -> dict[str, Column]:
    """Shares that do not depend on a text's length."""
    words = F.greatest(F.col(f"{m}.n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col(f"{m}.n_lines"), F.lit(1)).cast("double")
    return {
        "word_length": F.col(f"{m}.word_chars") / words,
        "symbols": F.col(f"{m}.n_symbols") / words,
        "dup_lines": F.col(f"{m}.n_dup_lines") / lines,
        "repeats": F.col(f"{m}.n_repeat_words") / words,
    }


def thresholds(measured: DataFrame, lang: str, source: str, m: str = "quality") -> DataFrame:
    """Lowest and highest accepted value of each feature, per language and source.

    Sketches cover all documents that pass the base rules. One sketch per group and task is shuffled; the groups'
    sketches are merged to those of languages and of everything.
    """
    found = features(m)
    sketched = (
        measured.where(~base_failed(m))
        .groupBy(F.col(lang).alias("lang"), F.col(source).alias("source"))
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            *[F.kll_sketch_agg_double(value, SKETCH_K).alias(name) for name, value in found.items()],
        )
    )
    merged = [F.sum("n_docs").alias("n_docs"), *[F.kll_merge_agg_double(name, SKETCH_K).alias(name) for name in found]]
    by_lang = sketched.groupBy("lang").agg(*merged)
    of_all = by_lang.agg(*merged).where("n_docs > 0")  # without documents there is no sketch to ask

    def limits(df: DataFrame, *keys: str) -> DataFrame:
        columns = []
        for name in found:
            least, low, middle, high, most = (F.kll_sketch_get_quantile_double(name, F.lit(q)) for q in (TAIL, 0.25, 0.5, 0.75, 1 - TAIL))
            reach = REACH * F.greatest(high - low, F.lit(LEAST_WIDTH[name]))
            below = TAIL_REACH * F.greatest(middle - least, F.lit(LEAST_TAIL[name]))
            above = TAIL_REACH * F.greatest(most - middle, F.lit(LEAST_TAIL[name]))
            columns.append(F.struct(F.greatest(low - reach, least - below).alias("low"), F.least(high + reach, most + above).alias("high")).alias(name))
        return df.select(*keys, F.col("n_docs").cast("double").alias("n_docs"), F.struct(*columns).alias("limits"))

    def blended(own: str, wider: str) -> Column:
        mean = lambda at: (F.col(f"{own}.n_docs") * F.col(f"{own}.limits.{at}") + BLEND_DOCS * F.col(f"{wider}.limits.{at}")) / (
            F.col(f"{own}.n_docs") + BLEND_DOCS
        )
        return F.struct(*[F.struct(*[mean(f"{name}.{end}").alias(end) for end in ("low", "high")]).alias(name) for name in found])

    own = limits(sketched, "lang", "source").alias("o")
    all_limits = F.broadcast(limits(of_all)).alias("a")  # one row
    of_lang = limits(by_lang, "lang").alias("l").join(all_limits, F.lit(True)).select("l.lang", blended("l", "a").alias("limits")).alias("w")
    return own.join(of_lang, F.col("o.lang").eqNullSafe(F.col("w.lang"))).select("o.lang", "o.source", blended("o", "w").alias("limits"))


def judge(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", into: str = "quality", keep: list[str] | None = None
) -> DataFrame:
    """Every row of ``docs`` with a struct ``into``: the measures, ``base_failed`` and ``kept``.

    Texts are measured in one pass, however long; the measured rows are written to the shared folder, and thresholds and
    verdicts are worked out from there. ``keep`` names the other columns, all by default.

    Null and empty texts fail the base rules. Rows with a null language or source form groups of their own. Repeated
    rows are judged alike. A column named ``into`` is replaced; other columns stay as they are. An empty table gives no rows, and
    one in which no document passes the base rules gives all of them, not kept. The thresholds are written, too, so that the join
    knows their size.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != into]
    m, own_lang, own_source, of_lang, of_source, limits = free_names(
        [*docs.columns, into], "measured", "own_lang", "own_source", "of_lang", "of_source", "limits"
    )
    measured = stored(
        docs.select(*kept, F.col(lang).alias(own_lang), F.col(source).alias(own_source), measures(F.col(text)).alias(m)), "measured"
    )
    found = stored(
        thresholds(measured, own_lang, own_source, m).select(
            F.col("lang").alias(of_lang), F.col("source").alias(of_source), F.col("limits").alias(limits)
        ),
        "thresholds",
    )
    joined = measured.join(
        found, F.col(own_lang).eqNullSafe(F.col(of_lang)) & F.col(own_source).eqNullSafe(F.col(of_source)), "left"
    )
    fits = F.lit(True)
    for name, value in features(m).items():
        fits = fits & value.between(F.col(f"{limits}.{name}.low"), F.col(f"{limits}.{name}.high"))
    failed = base_failed(m)
    verdict = F.struct(
        *[F.col(f"{m}.{c}") for c in MEASURES], failed.alias("base_failed"), (~failed & F.coalesce(fits, F.lit(True))).alias("kept")
    )
    return joined.select(*kept, verdict.alias(into))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns. Nulls, ties, repeats and very long texts: see ``judge``."""
    (into,) = free_names(docs.columns, "verdict")
    return judge(docs, into=into).where(F.col(into)["kept"]).select(*docs.columns)
