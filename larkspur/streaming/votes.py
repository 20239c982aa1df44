"""Vote stream to live votes, by summaries that merge.

A micro-batch writes its votes, and one summary for each voter, target and hour in it: the first and last run of equal votes,
and the first and last place in time. It reads nothing of earlier batches. Summaries of one hour that follow one another in
time merge without their votes, in whatever grouping, so that the store may put together old folders. Only where a late
batch's votes lie among those of another are the hour's votes read again, for that voter and target alone, when the
state is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.functions.times import utc_timestamp
from larkspur.operators.votes import (
    RUN_COLUMNS, VOTE_KEYS, run_summaries, runs_of_summaries, state_of_summaries, with_created,
)
from larkspur.streaming import windows as wn
from larkspur.streaming.store import FAN, Store

VOTES, HOURS = "votes", "hours"
HOUR = "hour"
SEGMENT = [*VOTE_KEYS, HOUR]
#: First and last place in time of a summary's votes.
LO, HI = ("lo_ts", "lo_seq"), ("hi_ts", "hi_seq")


def _schemas(target_id: str, ts: str) -> dict[str, str]:
    keys = f"user_uid string, target_type string, target_id {target_id}, {HOUR} bigint"
    return {
        VOTES: f"{keys}, seq bigint, ts {ts}, delta int, day bigint",
        HOURS: f"{keys}, lo_ts {ts}, lo_seq bigint, hi_ts {ts}, hi_seq bigint, first int, first_n bigint, last int, last_n bigint, n bigint",
    }


def vote_store(spark: SparkSession, path: str, target_id: str = "bigint", ts: str = "timestamp_ntz", fan: int = FAN) -> Store:
    return Store(spark, path, _schemas(target_id, ts), {VOTES: ["day"]}, fan)


def _hour(df: DataFrame) -> Column:
    """Number of the UTC hour of a vote; -1 for the vote cast by creating something, and for one without a time."""
    hour = F.floor(F.unix_seconds(utc_timestamp(df, "ts")) / 3600).cast("long")
    return F.coalesce(F.when(F.col("created") == 1, hour), F.lit(-1).cast("long"))


def _place(ts: str, seq: str) -> Column:
    return F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))


def _summaries(rows: DataFrame, order: list[str], lo: Column, hi: Column) -> DataFrame:
    summed = run_summaries(rows, SEGMENT, order, {"lo": F.min(lo), "hi": F.max(hi)})
    ends = [F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("lo", "hi") for c in ("ts", "seq")]
    return summed.select(*SEGMENT, *ends, *RUN_COLUMNS)


def segments(votes: DataFrame) -> DataFrame:
    """One summary of the given votes per voter, target and hour."""
    return _summaries(votes.withColumn("votes", F.lit(1).cast("long")), ["ts", "seq"], _place("ts", "seq"), _place("ts", "seq"))


def _marked(rows: DataFrame) -> DataFrame:
    """Summaries with a flag on all of an hour of which some overlap in time."""
    in_time = Window.partitionBy(*SEGMENT).orderBy(*LO, *HI)
    reached = F.max(_place(*HI)).over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_reached", reached).withColumn("_over", F.coalesce(_place(*LO) <= F.col("_reached"), F.lit(False)))
    return marked.withColumn("_mixed", F.max("_over").over(Window.partitionBy(*SEGMENT))).drop("_reached", "_over")


def merged_segments(rows: DataFrame) -> DataFrame:
    """Summaries of one hour put together where they follow one another in time; those that overlap stay as they are."""
    marked = _marked(rows)
    runs = runs_of_summaries(marked.where(~F.col("_mixed")), SEGMENT, [*LO], HI)
    return _summaries(runs, [*LO, "_at"], _place(*LO), _place(*HI)).unionByName(marked.where("_mixed").drop("_mixed"))


def _day(hour: Column) -> Column:
    return F.when(hour >= 0, F.floor(hour / 24)).otherwise(-1).cast("long")


def summarise_votes(events: DataFrame, path: str, checkpoint: str, fan: int = FAN) -> StreamingQuery:
    """Add the votes and the summaries of their hours to the store under ``path``."""
    types = dict(events.dtypes)

    def write(batch: DataFrame, number: int) -> None:
        votes = batch.select(*VOTE_KEYS, _hour(batch).alias(HOUR), F.col("seq").cast("long").alias("seq"), "ts", F.col("delta").cast("int").alias("delta"))
        store = vote_store(batch.sparkSession, path, types["target_id"], types["ts"], fan)
        store.append(
            number, {VOTES: votes.withColumn("day", _day(F.col(HOUR))), HOURS: segments(votes)}, {VOTES: lambda rows: rows, HOURS: merged_segments}
        )

    return wn.in_batches(with_created(events), checkpoint, write)


def state_so_far(spark: SparkSession, path: str, target_id: str = "bigint", ts: str = "timestamp_ntz") -> DataFrame:
    """Live vote of each voter and target that is not 0."""
    store = vote_store(spark, path, target_id, ts)
    held = store.manifest()
    marked = _marked(store.read(HOURS, held))
    mixed = marked.where("_mixed").select(*SEGMENT).distinct().withColumn("_day", _day(F.col(HOUR)))
    votes = store.read(VOTES, held)
    wanted = [votes[c].eqNullSafe(mixed[c]) for c in SEGMENT]
    again = segments(votes.join(mixed, [votes["day"] == mixed["_day"], *wanted], "left_semi"))
    hours = marked.where(~F.col("_mixed")).drop("_mixed").unionByName(again)
    runs = runs_of_summaries(hours, VOTE_KEYS, [HOUR, *LO])
    return state_of_summaries(run_summaries(runs, VOTE_KEYS, [HOUR, *LO, "_at"])).where("value <> 0")
