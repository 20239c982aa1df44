"""Toggle votes: state per voter and target, scores and member statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOTE_KEYS = ["user_uid", "target_type", "target_id"]


def creation_votes(rows: DataFrame, target_type: str) -> DataFrame:
    """The first +1 an author casts by creating a post or comment."""
    return rows.select(
        F.lit(-1).cast("long").alias("seq"),
        # Without a zone, so that the session zone plays no part.
        F.expr("timestampadd(MILLISECOND, created_ms, TIMESTAMP_NTZ '1970-01-01 00:00:00')").alias("ts"),
        F.col("author_uid").alias("user_uid"),
        F.lit(target_type).alias("target_type"),
        F.col("id").alias("target_id"),
        F.lit(1).alias("delta"),
    )


def all_votes(posts: DataFrame, comments: DataFrame, events: DataFrame) -> DataFrame:
    """Creation votes and later toggles; creation always comes first."""
    created = creation_votes(posts, "post").unionByName(creation_votes(comments, "comment"))
    return created.withColumn("created", F.lit(0)).unionByName(events.withColumn("created", F.lit(1)))


CHUNK = "_chunk"
CHUNK_COLUMNS = ("_last", "_tail", "_n")


def with_created(events: DataFrame) -> DataFrame:
    """Votes without the mark ``created`` are later toggles."""
    return events if "created" in events.columns else events.withColumn("created", F.lit(1))


def vote_state(events: DataFrame, chunk: str = "hour") -> DataFrame:
    """Live vote of each voter and target: -1, 0 or 1.

    A vote equal to the live one clears it, any other replaces it. So the last run of equal votes decides:
    an odd run leaves that vote, an even one none. Runs are measured per ``chunk`` of time first, which
    splits a hot voter and target over many tasks, and the chunks are put together from one row each.
    """
    rows = with_created(events)
    return combine_chunks(chunk_summaries(rows.withColumn(CHUNK, F.when(F.col("created") == 1, F.date_trunc(chunk, "ts")))))


def chunk_summaries(rows: DataFrame) -> DataFrame:
    """Last vote, length of the run it ends, and rows of each voter, target and chunk."""
    back = Window.partitionBy(*VOTE_KEYS, CHUNK).orderBy(F.col("ts").desc(), F.col("seq").desc())
    so_far = back.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_last", F.first("delta").over(back))
        .withColumn("_broken", F.max((F.col("delta") != F.col("_last")).cast("int")).over(so_far))
        .groupBy(*VOTE_KEYS, CHUNK)
        .agg(F.max("_last").alias("_last"), F.count_if(F.col("_broken") == 0).alias("_tail"), F.count("*").alias("_n"))
    )


def combine_chunks(chunks: DataFrame) -> DataFrame:
    """Live votes from the summaries of chunks; the chunk of creation sorts before all others."""
    later = Window.partitionBy(*VOTE_KEYS).orderBy(F.col(CHUNK).desc_nulls_last())
    before = later.rowsBetween(Window.unboundedPreceding, -1)
    breaks = (F.col("_last") != F.col("_final")) | (F.col("_tail") < F.col("_n"))
    run = (
        chunks.withColumn("_final", F.first("_last").over(later))
        .withColumn("_stops", F.max(breaks.cast("int")).over(before))
        .where((F.coalesce(F.col("_stops"), F.lit(0)) == 0) & (F.col("_last") == F.col("_final")))
        .groupBy(*VOTE_KEYS)
        .agg(F.max("_final").alias("_final"), F.sum("_tail").alias("_run"))
    )
    value = F.when(F.col("_run") % 2 == 1, F.col("_final")).otherwise(0).cast("int")
    return run.select(*VOTE_KEYS, value.alias("value"))


RUN_COLUMNS = ("first", "first_n", "last", "last_n", "n")


def run_summaries(rows: DataFrame, keys: list[str], order: list[str], carried: dict[str, Column] | None = None) -> DataFrame:
    """First and last run of equal votes of each key, and its votes: (keys, first, first_n, last, last_n, n).

    ``rows`` hold ``delta`` and ``votes``, so many equal votes in a row; a null delta stands for a stretch that starts and ends with other
    votes than its neighbours. ``order`` is the order within a key; ``carried`` adds sums per key.
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    breaks = ~F.col("delta").eqNullSafe(F.lag("delta").over(ordered)) | F.lag(F.lit(1)).over(ordered).isNull()
    numbered = rows.withColumn("_breaks", breaks.cast("long")).withColumn("_run", F.sum("_breaks").over(ordered))
    carried = carried or {}
    runs = numbered.groupBy(*keys, "_run").agg(
        F.first("delta").alias("delta"), F.sum("votes").alias("votes"), *[value.alias(name) for name, value in carried.items()]
    )
    # The rows lie by key already, so neither step shuffles them again.
    run = F.struct("delta", "votes")
    again = [(F.min if name.startswith("lo") else F.max)(name).alias(name) for name in carried]
    return (
        runs.groupBy(*keys)
        .agg(F.min_by(run, "_run").alias("_a"), F.max_by(run, "_run").alias("_z"), F.sum("votes").alias("n"), *again)
        .select(
            *keys, *carried, F.col("_a.delta").alias("first"), F.col("_a.votes").alias("first_n"),
            F.col("_z.delta").alias("last"), F.col("_z.votes").alias("last_n"), "n",
        )
    )


def runs_of_summaries(summaries: DataFrame, keys: list[str], order: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """The runs that summaries stand for, so that ``run_summaries`` of them is the summary of all their votes.

    A summary that is one run gives one row, any other its first run, its last, and between them a stretch that nothing joins.
    So summaries of consecutive stretches may be put together in any grouping: the result is the same.
    """
    run = lambda delta, votes, at: F.struct(delta.alias("delta"), votes.alias("votes"), F.lit(at).alias("_at"))
    first, last = run(F.col("first"), F.col("first_n"), 0), run(F.col("last"), F.col("last_n"), 2)
    between = F.col("n") - F.col("first_n") - F.col("last_n")
    parts = (
        F.when(F.col("first_n") == F.col("n"), F.array(first))
        .when(between == 0, F.array(first, last))
        .otherwise(F.array(first, run(F.lit(None).cast("int"), between, 1), last))
    )
    return summaries.select(*keys, *order, *kept, F.inline(parts))


def state_of_summaries(summaries: DataFrame) -> DataFrame:
    """Live vote of each voter and target: an odd last run leaves its vote, an even one none."""
    value = F.when(F.col("last_n") % 2 == 1, F.col("last")).otherwise(0).cast("int")
    return summaries.select(*VOTE_KEYS, value.alias("value"))


def scores(state: DataFrame) -> DataFrame:
    """Sum of the live votes per target."""
    return state.groupBy("target_type", "target_id").agg(F.sum("value").alias("score"))


def member_stats(posts: DataFrame, comments: DataFrame, state: DataFrame) -> DataFrame:
    """Posts, comments, live votes cast and karma of each member. Votes of others leave karma as it is."""

    def part(df: DataFrame, uid: str, posts_n: int, comments_n: int, votes_n: int, karma_n: int) -> DataFrame:
        numbers = {"posts": posts_n, "comments": comments_n, "votes_cast": votes_n, "karma": karma_n}
        return df.select(F.col(uid).alias("uid"), *[F.lit(n).cast("long").alias(name) for name, n in numbers.items()])

    rows = (
        part(posts, "author_uid", 1, 0, 0, 1)
        .unionByName(part(comments, "author_uid", 0, 1, 0, 1))
        .unionByName(part(state.where("value <> 0"), "user_uid", 0, 0, 1, 0))
    )
    return rows.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("posts", "comments", "votes_cast", "karma")])


def shown_stats(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Per member the larger of the stored and the counted posts, comments and votes."""
    both = stored.join(live.withColumnsRenamed({c: f"_{c}" for c in ("posts", "comments", "votes_cast", "karma")}), "uid", "full")
    larger = {
        c: F.greatest(F.coalesce(c, F.lit(0)), F.coalesce(f"_{c}", F.lit(0))) for c in ("posts", "comments", "votes_cast")
    }
    return both.select("uid", *[v.alias(c) for c, v in larger.items()], F.coalesce("karma", F.lit(0)).alias("karma"))


def with_my_vote(
    rows: DataFrame, state: DataFrame, user_uid: str, target_type: str, most: int | None = None
) -> DataFrame:
    """Add one member's vote on each row, 0 without one. ``most`` bounds the votes on these targets, by target."""
    mine = state.where(
        (F.col("user_uid") == user_uid) & (F.col("target_type") == target_type) & (F.col("value") != 0)
    ).select(F.col("target_id").alias("id"), F.col("value").alias("my_vote"))
    if most is not None:
        mine = mine.orderBy("id").limit(most)
    joined = rows.join(mine, "id", "left")
    return joined.withColumn("my_vote", F.coalesce("my_vote", F.lit(0)))
