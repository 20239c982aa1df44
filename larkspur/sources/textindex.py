"""Stored listings with trigram postings per file, for substring search that skips files.

A file that holds a needle holds all its trigrams in one listing's search text. Postings tell which files hold a trigram; files that lack one of
the needle's are not opened, and the rest are searched in full, so results are those of a plain search. Listings are dealt by company,
which keeps rare words in few files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.listings import haystack, needles, search_listings
from larkspur.session import stored

GRAM = 3
FILE_ROWS = 10_000


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, by code points; empty for shorter texts."""
    # One code point is consumed at a time, and the group looks ahead from it.
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * GRAM + "))."), F.lit(1)))


def batch_grams(texts: list[str]) -> list[str]:
    """The distinct trigrams of some texts, as ``trigrams`` gives them for each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # code points up to the end of the text
    at = np.flatnonzero(left >= GRAM)
    a, b, c = (chars[at + k].astype(np.int64) for k in range(GRAM))
    plain = (a | b | c) < 128
    held = np.zeros(1 << 21, bool)
    held[(a << 14 | b << 7 | c)[plain]] = True
    few = np.flatnonzero(held)
    codes = np.concatenate([few >> 14 << 42 | (few >> 7 & 127) << 21 | few & 127, np.unique((a << 42 | b << 21 | c)[~plain])])
    found = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [found[k : k + GRAM] for k in range(0, len(found), GRAM)]


def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (file, text): (file, gram) of each batch without repeats."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).filter(batch.column("text").is_valid())
        for file in table.column("file").unique():
            texts = table.filter(pc.equal(table.column("file"), file)).column("text").to_pylist()
            grams = pa.array(batch_grams(texts), pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(file, len(grams)).cast(pa.string()), grams], names=["file", "gram"])


def write_indexed(listings: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write normalised listings under ``path``, then the postings of their files, sorted by trigram.

    The listings are stored first, as dealing by ranges reads the rows a second time.
    """
    spark = listings.sparkSession
    dealt = stored(listings, "listed").repartitionByRange("company", "ordinal").sortWithinPartitions("company", "ordinal")
    dealt.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    texts = rows.select(F.col("_metadata.file_name").alias("file"), haystack().alias("text"))
    grams = texts.mapInArrow(gram_rows, "file string, gram string").distinct()
    grams.repartitionByRange("gram").sortWithinPartitions("gram", "file").write.parquet(f"{path}/postings")


def files_with(spark: SparkSession, path: str, wanted: list[str]) -> list[str] | None:
    """Names of the files that hold all trigrams of all ``wanted`` texts; None if these are too short to tell.

    Names only are gathered, no more than Spark lists for a scan of the table.
    """
    grams = sorted({text[k : k + GRAM] for text in wanted for k in range(len(text) - GRAM + 1)})
    if not grams:
        return None
    held = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(grams))
    files = held.groupBy("file").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
    return [r["file"] for r in files.select("file").collect()]


def search_indexed(spark: SparkSession, path: str, query: str = "", chip: str = "", **conditions) -> DataFrame:
    """``search_listings`` over the listings under ``path``, reading only files that may hold the query and the chip.

    Other conditions are pushed to the scan as usual. Texts of less than three characters read all files.
    """
    whole = spark.read.parquet(f"{path}/rows")
    files = files_with(spark, path, needles(query, chip))
    rows = whole
    if files is not None:
        rows = spark.read.schema(whole.schema).parquet(*[f"{path}/rows/{f}" for f in files]) if files else whole.limit(0)
    return search_listings(rows, query=query, chip=chip, **conditions)
