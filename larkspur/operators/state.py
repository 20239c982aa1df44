"""Saved, applied and hidden jobs of each user, and layered settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"save": "saved", "applied": "applied", "hide": "hidden"}


def job_state(events: DataFrame) -> DataFrame:
    """Live state from toggle events: saved and applied need an odd number of toggles, hidden any. Other actions do nothing."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("action")]
    return (
        events.where(F.col("action").isin(*KINDS))
        .groupBy("user_uid", "job_id", kind.alias("kind"))
        .agg(F.count("*").alias("_n"), F.max("ts").alias("ts"))
        .where((F.col("kind") == "hidden") | (F.col("_n") % 2 == 1))
        .drop("_n")
    )


def jobs_of(state: DataFrame, user_uid: str, kind: str) -> DataFrame:
    """Job ids of one user in one state."""
    return state.where((F.col("user_uid") == user_uid) & (F.col("kind") == kind)).select("job_id")


def overlay(df: DataFrame, layers: list[str], name: str) -> DataFrame:
    """Merge map columns from left to right; the rightmost layer holding a key wins."""
    empty = F.create_map().cast("map<string,string>")

    def over(base: Column, patch: Column) -> Column:
        return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k)), patch)

    merged = F.coalesce(F.col(layers[0]), empty)
    for layer in layers[1:]:
        merged = over(merged, F.coalesce(F.col(layer), empty))
    return df.withColumn(name, merged)
