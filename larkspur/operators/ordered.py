"""Ordered work on keys of any size: the rows of a key are first cut into chunks of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], chunk: str) -> DataFrame:
    """Add ``previous_<column>``, the value in the row before within the key.

    Neighbours inside a chunk come from a window per key and chunk. Only the first row of a chunk looks at
    the last row of the chunk before, taken from one pre-aggregated row per chunk. ``chunk`` must not
    decrease in the order. The order must be unique within a key.
    """
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    over_chunks = Window.partitionBy(*keys).orderBy(chunk)
    values = F.struct(*columns)
    lasts = df.groupBy(*keys, chunk).agg(F.max_by(values, F.struct(*order)).alias("_last"))
    before = lasts.withColumn("_before", F.lag("_last").over(over_chunks)).drop("_last")
    near = df.withColumn("_near", F.lag(values).over(inside)).withColumn("_at", F.row_number().over(inside))
    joined = near.join(before, [*keys, chunk], "left")
    previous = F.when(F.col("_at") == 1, F.col("_before")).otherwise(F.col("_near"))
    out = joined.withColumn("_previous", previous)
    return out.withColumns({f"previous_{c}": F.col("_previous")[c] for c in columns}).drop(
        "_near", "_at", "_before", "_previous"
    )
