"""Sums of a stream, kept in a store that merges its folders.

A micro-batch is summed by key and added to the store; folders are merged by adding up again, so that their number grows
with the logarithm of the batches. The sums of all folders add up to the result, whatever order rows arrive in: there is no
watermark behind which a late row is lost, and no state that grows with the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.streaming.store import FAN, Store

SUMS = "sums"


def summed_again(keys: list[str], sums: list[str]):
    """Adds up rows of sums by key."""
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sums])


def append_sums(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str], sums: dict[str, Column], fan: int = FAN
) -> StreamingQuery:
    """Work off what is there, in batches that the source bounds."""

    def write(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy(*keys).agg(*[F.sum(value).alias(name) for name, value in sums.items()])
        store = Store(batch.sparkSession, path, {SUMS: summed.schema}, fan=fan)
        store.append(number, {SUMS: summed}, {SUMS: summed_again(keys, list(sums))})

    return in_batches(stream, checkpoint, write)


def in_batches(stream: DataFrame, checkpoint: str, write) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_sums(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The sums of all folders; an empty table before the first batch. Rows of one key may still be several."""
    return Store(spark, path, {SUMS: schema}).read(SUMS)
