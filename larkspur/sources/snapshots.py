"""Listings over daily snapshots: what a new snapshot adds to those seen before.

A store keeps the first row of every listing key, in the snapshot that showed it first, and beside them a narrow table of the keys.
A new snapshot is compared with the keys alone; rows of earlier snapshots are not read again. Both tables are folders behind
a manifest that merge geometrically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.operators.listings import first_per_key, listing_key, named, normalize_rows
from larkspur.operators.numbering import with_position
from larkspur.session import stored
from larkspur.streaming.store import Manifest, Store

#: Ordinals of one snapshot are below it; later snapshots' rows come after those of earlier ones.
SNAPSHOT_ROWS = 1 << 40
KEYS = "key string, position long"


def snapshot_store(spark: SparkSession, path: str, mapped: StructType) -> Store:
    """The store under ``path`` for snapshots with the columns of ``mapped`` (listings after the column aliases)."""
    rows = StructType([f for f in mapped.fields if f.name not in ("key", "position")]).add("key", "string").add("position", "long")
    return Store(spark, path, {"seen": KEYS, "listings": rows})


def unseen(store: Store, mapped: DataFrame) -> DataFrame:
    """The first row of each key of a snapshot that the store does not hold, with its ``key``.

    Only the key column of the store is read. It is cut down to keys of this snapshot before it meets the rows, so that with a
    snapshot small enough to broadcast the store's keys are not shuffled.
    """
    first = first_per_key(mapped.withColumn("key", F.coalesce(listing_key(), F.lit(""))), F.col("key"))
    held = store.read("seen").select("key").join(mapped.select(F.coalesce(listing_key(), F.lit("")).alias("key")), "key", "left_semi")
    return first.join(held, "key", "left_anti")


def add_snapshot(store: Store, number: int, mapped: DataFrame) -> Manifest:
    """Add a snapshot by its number, counted from 0 without gaps or repeats; one that the store holds changes nothing.

    Rows with a title and a company get the position that they have in the de-duplicated listing of all snapshots so far. An empty
    snapshot adds nothing but its number.
    """
    if number <= store.manifest().batch:
        return store.manifest()
    columns = [f.name for f in store.schemas["listings"].fields]
    new = stored(unseen(store, mapped), "unseen")
    start = store.read("seen").agg(F.coalesce(F.max("position") + 1, F.lit(0))).first()[0]
    placed = with_position(new.where(named()).select("ordinal"), "ordinal", "at").select("ordinal", (F.col("at") + start).alias("position"))
    placed = new.join(placed, "ordinal", "left").withColumn("ordinal", F.col("ordinal") + number * SNAPSHOT_ROWS)
    rows = stored(placed.select(*columns), "placed")
    together = {"seen": lambda df: df.repartition("key"), "listings": lambda df: df}
    return store.append(number, {"seen": rows.select("key", "position"), "listings": rows}, together)


def seen_listings(store: Store) -> DataFrame:
    """The first row of each key over all snapshots; ``ordinal`` goes by snapshot, then by the order inside it."""
    return store.read("listings").drop("key", "position")


def normalized_listings(store: Store) -> DataFrame:
    """The normalised listings of all snapshots, with the ids that one pass over all of them would give."""
    rows = store.read("listings").where(F.col("position").isNotNull())
    return normalize_rows(rows.drop("key").withColumnRenamed("position", "_position"))
