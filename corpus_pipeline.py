"""The corpus pipeline: good documents, without repeated line runs and near copies, mixed to weights, as token ids.

Every stage takes rows with nulls in any column, texts of any length, repeated rows, further columns and empty tables; what comes of
them is said at each stage. An empty table, or one whose rows all go, gives no rows at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import jaccard, lines, mixing, quality
from larkspur.llm.queries import encode_pieces
from larkspur.session import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the quality rules reject go, null and empty texts among them. Nulls in language or source are groups of
    their own; repeated rows are judged alike."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: later copies of repeated line runs are deleted, and documents that lose all lines. Rows of one doc_id and text
    are one document; null ids come first."""
    return lines.drop_repeated_lines(docs)


def copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near copies stays, the one of the smallest doc_id; ties are rows of one doc_id, which
    stay or go together. Rows with a null doc_id stay."""
    return jaccard.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: sources are mixed to their target weights by estimated tokens. A document is read once at most; rows alike in id and
    text are taken alike."""
    return mixing.take_mix(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: texts are encoded, decoded and summed up, one row for each; a null text is an empty one."""
    return encode_pieces(spark, sf_dir, docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("copies", copy_stage),
    ("mix", mix_stage),
    ("pieces", piece_stage),
]

#: Quality sketches, similarity of sets and token ids are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
