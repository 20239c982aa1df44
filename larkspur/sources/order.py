"""The order of rows in files, whatever way Spark packs the files into tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import stored


def input_order() -> Column:
    """File, block and line of a row of a file scan. Within a block the task's line number grows with the line."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def with_ordinal(df: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """Turn a column as from ``input_order`` into one integer, unique and growing with file name, block and line.

    The rows are stored once, because line numbers belong to one scan. The window runs over one row per input split.
    """
    held = stored(df, "ordered")
    lines = F.col(f"{order}.line")
    splits = held.groupBy(F.col(f"{order}.file").alias("_file"), F.col(f"{order}.block").alias("_block")).agg(
        F.min(lines).alias("_low"), (F.max(lines) - F.min(lines) + 1).alias("_span")
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_start", F.coalesce(F.sum("_span").over(before), F.lit(0)))
    same = (F.col(f"{order}.file") == F.col("_file")) & (F.col(f"{order}.block") == F.col("_block"))
    numbered = held.join(starts, same).withColumn(name, F.col("_start") + lines - F.col("_low"))
    return numbered.drop(order, "_file", "_block", "_low", "_span", "_start")
