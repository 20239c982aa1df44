"""Streams give the batch results, over several micro-batches and with rows out of order."""

from pyspark.sql import functions as F

from larkspur.operators import usage as us
from larkspur.operators import votes as vo
from larkspur.plans import request_queries as rq
from larkspur.plans.views import view
from larkspur.streaming import members as mb
from larkspur.streaming import usage as su
from larkspur.streaming import votes as sv
from tests.test_forum import brute_state, vote_rows, votes

SF = "/root/testdata/sf0.001"


def rows_of(df):
    names = sorted(df.columns)
    return sorted(tuple(str(r[n]) for n in names) for r in df.collect())


def in_parts(df, order, path, parts=3):
    """Write the rows to one folder in parts, newest first; after each part the caller may run its stream."""
    for number in range(parts):
        part = df.where(F.pmod(F.floor(order), F.lit(parts)) == parts - 1 - number)
        part.coalesce(1).write.mode("append").parquet(path)
        yield number


def test_usage_with_late_files(spark, tmp_path):
    landed = view(spark, SF, "requests")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    assert su.counters_so_far(spark, out).count() == 0
    third = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400 / 10  # ten days a part, the last ones first
    for _ in in_parts(landed, third, source):
        su.count_requests(spark.readStream.schema(landed.schema).parquet(source), out, checkpoint).awaitTermination()
    batch = us.daily_facts(rq.enriched(spark, SF), pairs=True).groupBy("day", "dim", "key").agg(F.count("*").alias("n"))
    assert rows_of(su.counters_so_far(spark, out)) == rows_of(batch)
    su.count_requests(spark.readStream.schema(landed.schema).parquet(source), out, checkpoint).awaitTermination()
    assert rows_of(su.counters_so_far(spark, out)) == rows_of(batch)


def test_votes_out_of_order(spark, tmp_path):
    rows = sorted(vote_rows(900, 11), key=lambda r: (r[1], r[0]))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    assert sv.state_so_far(spark, out).count() == 0
    for part in (rows[600:], rows[1:300:2], rows[300:600], rows[:300:2]):
        votes(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(votes(spark, part).schema).parquet(source)
        sv.summarise_votes(stream, out, checkpoint).awaitTermination()
    state = sv.state_so_far(spark, out)
    got = {(r["user_uid"], r["target_id"]): r["value"] for r in state.collect()}
    assert got == {k: v for k, v in brute_state(rows).items() if v}
    assert rows_of(vo.scores(state)) == rows_of(vo.scores(vo.vote_state(votes(spark, rows)).where("value <> 0")))


def test_members_in_three_files_out_of_order(spark, tmp_path):
    posts, comments, events = (view(spark, SF, v) for v in ("posts", "comments", "vote_events"))
    paths = {n: str(tmp_path / n) for n in ("posts", "comments", "votes", "sums", "hours")}
    steps = zip(
        in_parts(posts, F.col("id"), paths["posts"]), in_parts(comments, F.col("id"), paths["comments"]), in_parts(events, F.col("seq") / 7, paths["votes"])
    )
    for _ in steps:
        s = {n: spark.readStream.schema(df.schema).parquet(paths[n]) for n, df in (("posts", posts), ("comments", comments), ("votes", events))}
        mb.count_members(s["posts"], s["comments"], paths["sums"], f"{paths['sums']}-c").awaitTermination()
        sv.summarise_votes(vo.all_votes(s["posts"], s["comments"], s["votes"]), paths["hours"], f"{paths['hours']}-c").awaitTermination()
    batch = vo.member_stats(posts, comments, vo.vote_state(vo.all_votes(posts, comments, events)))
    assert rows_of(mb.stats_so_far(spark, paths["sums"], sv.state_so_far(spark, paths["hours"]))) == rows_of(batch)
