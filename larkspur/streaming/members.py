"""Post and comment streams to member statistics and comment counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.streaming import windows as wn

NUMBERS = ("posts", "comments", "karma")
SCHEMA = "uid string, posts bigint, comments bigint, karma bigint"


def _rows(df: DataFrame, posts: int, comments: int) -> DataFrame:
    return df.select(
        F.col("author_uid").alias("uid"),
        F.lit(posts).cast("long").alias("posts"),
        F.lit(comments).cast("long").alias("comments"),
        F.lit(1).cast("long").alias("karma"),
    )


def member_rows(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """What each post and comment adds to its author; the same for streams and for tables."""
    return _rows(posts, 1, 0).unionByName(_rows(comments, 0, 1))


def count_members(posts: DataFrame, comments: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return wn.append_sums(member_rows(posts, comments), path, checkpoint, ["uid"], {c: F.col(c) for c in NUMBERS})


def stats_so_far(spark: SparkSession, path: str, state: DataFrame) -> DataFrame:
    """Posts, comments, live votes cast and karma of each member; ``state`` as from the vote stream."""
    written = wn.read_sums(spark, path, SCHEMA).select("uid", *NUMBERS, F.lit(0).cast("long").alias("votes_cast"))
    cast = state.where("value <> 0").select(
        F.col("user_uid").alias("uid"), *[F.lit(0).cast("long").alias(c) for c in NUMBERS], F.lit(1).cast("long").alias("votes_cast")
    )
    both = written.unionByName(cast)
    return both.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("posts", "comments", "votes_cast", "karma")])


def count_comments(comments: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Active comments per post."""
    return wn.append_sums(comments.where("status = 'active'"), path, checkpoint, ["post_id"], {"n": F.lit(1).cast("long")})


def comments_so_far(spark: SparkSession, path: str, post_id: str = "bigint") -> DataFrame:
    return wn.read_sums(spark, path, f"post_id {post_id}, n bigint").groupBy("post_id").agg(F.sum("n").alias("comment_count"))
