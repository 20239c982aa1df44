"""Request stream to daily usage counters and lifetime counts.

Counters of days lie in a store, split by day. Days past the retention are rolled up: their lifetime counts are added to the
lifetime table, and in the same version of the store those days stop counting. Their parts can then be deleted. A request that
arrives later than that still counts for the lifetime: its folder is newer, and is rolled up the next time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.functions.times import utc_day, utc_timestamp
from larkspur.operators import usage as us
from larkspur.streaming import windows as wn
from larkspur.streaming.store import FAN, Store

DAYS, LIFETIME = "days", "lifetime"
SCHEMAS = {DAYS: "day date, dim string, key string, n bigint", LIFETIME: "what string, key string, n bigint"}
MERGES = {DAYS: us.merge_counters, LIFETIME: wn.summed_again(["what", "key"], ["n"])}


def usage_store(spark: SparkSession, path: str, fan: int = FAN) -> Store:
    return Store(spark, path, SCHEMAS, {DAYS: ["day"]}, fan)


def request_facts(requests: DataFrame) -> DataFrame:
    """(day, dim, key) of the trackable requests; the same for a stream and for a table."""
    timed = requests.withColumn("ts", utc_timestamp(requests, "ts"))
    facts = us.daily_facts(us.enrich_requests(us.trackable(timed)), "ts", pairs=True)
    return facts.select(utc_day(F.col("ts")).alias("day"), "dim", "key")


def count_requests(requests: DataFrame, path: str, checkpoint: str, fan: int = FAN) -> StreamingQuery:
    """Daily counters of the requests that have arrived, late ones too."""

    def write(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("day", "dim", "key").agg(F.count("*").alias("n"))
        usage_store(batch.sparkSession, path, fan).append(number, {DAYS: summed}, MERGES)

    return wn.in_batches(request_facts(requests), checkpoint, write)


def counters_so_far(spark: SparkSession, path: str) -> DataFrame:
    """Daily counters of the days that are not rolled up."""
    return us.merge_counters(usage_store(spark, path).read(DAYS))


def lifetime_so_far(spark: SparkSession, path: str) -> DataFrame:
    """Lifetime counts (what, key, n): those rolled up and those of the days that are left, from one version."""
    store = usage_store(spark, path)
    held = store.manifest()
    return MERGES[LIFETIME](store.read(LIFETIME, held).unionByName(us.lifetime_counts(store.read(DAYS, held))))


def roll_up(spark: SparkSession, path: str, today: str) -> None:
    """Add the days before the retained ones to the lifetime counts and let them go; deletes parts let go earlier.

    Run it while the stream is not working, as the store has one writer. A second run on one day changes nothing.
    """
    store = usage_store(spark, path)
    store.drop_parts(DAYS)
    first = us.first_retained(today)
    past = store.read(DAYS).where(F.col("day") < F.lit(first).cast("date"))
    held = store.add({LIFETIME: us.lifetime_counts(past)}, {DAYS: first})
    store.merge_due(held, LIFETIME, MERGES[LIFETIME])


def drop_rolled_days(spark: SparkSession, path: str) -> int:
    """Delete the parts of days that are rolled up; how many there were. Readers of older versions may miss them."""
    return usage_store(spark, path).drop_parts(DAYS)
