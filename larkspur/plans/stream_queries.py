"""Streams over the given tables, worked off to the end and compared with the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.usage import PAIRS, lifetime_counts
from larkspur.operators.votes import all_votes, scores
from larkspur.plans import forum_queries as fq
from larkspur.plans import request_queries as rq
from larkspur.plans import sqltext as q
from larkspur.plans.catalog import query
from larkspur.plans.views import stream_view
from larkspur.session import run_dir
from larkspur.streaming import members as mb
from larkspur.streaming import usage as us
from larkspur.streaming import votes as vo


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = run_dir(spark, "usage")
    us.count_requests(stream_view(spark, sf_dir, "requests"), f"{work}/days", f"{work}/checkpoint").awaitTermination()
    return us.counters_so_far(spark, f"{work}/days")


@query("m1_usage_stream", rq.USAGE_BY_DATE)
def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir).where(F.col("dim") != PAIRS)


_LIFETIME = rq.over_requests(
    """SELECT 'global_count' AS what, '' AS key, count(*) AS n FROM enriched
    UNION ALL SELECT 'crawler_count', '', count(*) FROM enriched WHERE bot IS NOT NULL
    UNION ALL SELECT 'bots', bot, count(*) FROM enriched WHERE bot IS NOT NULL GROUP BY bot
    UNION ALL SELECT 'external_referrers', referrer, count(*) FROM enriched WHERE referrer IS NOT NULL GROUP BY referrer
    UNION ALL SELECT 'device_global', device, count(*) FROM enriched GROUP BY device
    UNION ALL SELECT 'device_crawler', device, count(*) FROM enriched WHERE bot IS NOT NULL GROUP BY device
    UNION ALL SELECT 'device_bots', concat(device, ' | ', bot), count(*) FROM enriched WHERE bot IS NOT NULL GROUP BY device, bot"""
)


@query("m1_lifetime_stream", _LIFETIME)
def lifetime_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifetime_counts(_counters(spark, sf_dir))


@query("f7_lifetime_after_roll_up", _LIFETIME)
def lifetime_after_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days past the retention are rolled up and their parts deleted; the lifetime counts stay what they were."""
    work = run_dir(spark, "usage")
    us.count_requests(stream_view(spark, sf_dir, "requests"), f"{work}/days", f"{work}/checkpoint").awaitTermination()
    us.roll_up(spark, f"{work}/days", rq.TODAY)
    us.drop_rolled_days(spark, f"{work}/days")
    return us.lifetime_so_far(spark, f"{work}/days")


def _vote_state(spark: SparkSession, events: DataFrame) -> DataFrame:
    work = run_dir(spark, "votes")
    vo.summarise_votes(events, work, f"{work}-checkpoint").awaitTermination()
    return vo.state_so_far(spark, work)


_LIVE = "SELECT * FROM vote_state WHERE value <> 0"


@query("m2_vote_stream", q.with_ctes(["vote_events"], _LIVE, fq._EVENTS_ONLY, fq._ISLANDS))
def vote_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vote_state(spark, stream_view(spark, sf_dir, "vote_events"))


@query(
    "m2_score_stream",
    q.with_ctes(
        ["vote_events"],
        f"SELECT target_type, target_id, CAST(sum(value) AS BIGINT) AS score FROM ({_LIVE}) GROUP BY target_type, target_id",
        fq._EVENTS_ONLY, fq._ISLANDS,
    ),
)
def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(_vote_state(spark, stream_view(spark, sf_dir, "vote_events")))


@query("m3_member_stream", fq.MEMBER_STATS)
def member_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = run_dir(spark, "members")
    posts, comments = (stream_view(spark, sf_dir, v) for v in ("posts", "comments"))
    mb.count_members(posts, comments, f"{work}/sums", f"{work}/checkpoint").awaitTermination()
    votes = all_votes(posts, comments, stream_view(spark, sf_dir, "vote_events"))
    return mb.stats_so_far(spark, f"{work}/sums", _vote_state(spark, votes))


@query(
    "m3_comment_count_stream",
    q.with_ctes(["comments"], "SELECT post_id, count(*) AS comment_count FROM comments WHERE status = 'active' GROUP BY post_id"),
)
def comment_count_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = run_dir(spark, "comments")
    mb.count_comments(stream_view(spark, sf_dir, "comments"), f"{work}/sums", f"{work}/checkpoint").awaitTermination()
    return mb.comments_so_far(spark, f"{work}/sums")
