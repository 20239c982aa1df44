"""The store behind a manifest, mergeable vote summaries, and days rolled up into lifetime counts."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import usage as us
from larkspur.operators import votes as vo
from larkspur.streaming import members as mb
from larkspur.streaming import store as st
from larkspur.streaming import usage as su
from larkspur.streaming import votes as sv
from larkspur.streaming import windows as wn
from tests.test_forum import brute_state, vote_rows, votes
from tests.test_streams import rows_of

SCHEMAS = {"sums": "k bigint, n bigint"}
ADD = wn.summed_again(["k"], ["n"])


def batch(spark, number):
    return {"sums": spark.range(5).select((F.col("id") + number).alias("k"), F.lit(1).cast("long").alias("n"))}


def test_folders_grow_with_the_logarithm():
    """The plan of merges alone, for 1000 batches."""
    held, most = [], 0
    for n in range(1000):
        held.append(st.Folder(0, str(n)))
        while found := st.due(held):
            held = [f for f in held if f not in found] + [st.Folder(found[0].level + 1, f"m{n}")]
        most = max(most, len(held))
    assert most <= 4 * (st.FAN - 1)


def test_store_merges_and_forgets(spark, tmp_path):
    path = str(tmp_path / "s")
    store = st.Store(spark, path, SCHEMAS, fan=3)
    assert store.read("sums").count() == 0
    for number in range(20):
        before = store.read("sums")
        n_before = before.agg(F.sum("n")).first()[0] or 0
        store.append(number, batch(spark, number), {"sums": ADD})
        assert (before.agg(F.sum("n")).first()[0] or 0) == n_before  # a reader of the version before still sees it
        assert store.read("sums").agg(F.sum("n")).first()[0] == 5 * (number + 1)
    held = store.manifest()
    assert len(held.folders["sums"]) <= 2 * 3 and held.batch == 19
    folders = [p for p in (tmp_path / "s" / "sums").iterdir() if p.name.startswith("folder=")]
    assert len(folders) <= len(held.names()) + 3 * st.KEEP + 3 and len(list((tmp_path / "s" / "manifest").glob("0*"))) == st.KEEP
    again = store.append(19, batch(spark, 5), {"sums": ADD})  # a batch that is run again changes nothing
    assert again == held and store.read("sums").agg(F.sum("n")).first()[0] == 100


def test_a_failed_batch_leaves_the_version_before(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "s"), SCHEMAS, fan=2)
    store.append(0, batch(spark, 0), {"sums": ADD})

    def fails(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.append(1, batch(spark, 1), {"sums": fails})
    assert store.read("sums").agg(F.sum("n")).first()[0] == 10  # its rows are in; only the merge is still due
    store.append(2, batch(spark, 2), {"sums": ADD})
    assert store.read("sums").agg(F.sum("n")).first()[0] == 15 and len(store.manifest().folders["sums"]) == 1


def test_second_writer_is_refused(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "s"), SCHEMAS)
    stale = store.manifest()
    store.append(0, batch(spark, 0))
    with pytest.raises(OSError):
        store.publish(stale)


def test_summaries_are_a_monoid(spark):
    """100,000 sequences of votes, cut at random places and put together in two random steps: equal to the fold."""
    rng = random.Random(5)
    rows, want = [], {}
    for key in range(100_000):
        state, cut, group = 0, 0, 0
        for seq in range(rng.randint(1, 9)):
            delta = rng.choice([1, 1, -1])
            cut += rng.random() < 0.4
            group = max(group, cut if rng.random() < 0.5 else group)
            rows.append((f"u{key}", "post", key, group, cut, seq, delta))
            state = 0 if state == delta else delta
        want[key] = state
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(rows, columns=[*vo.VOTE_KEYS, "g", "c", "seq", "delta"]))
    df = df.withColumn("delta", F.col("delta").cast("int")).withColumn("votes", F.lit(1).cast("long"))
    pieces = vo.run_summaries(df, [*vo.VOTE_KEYS, "g", "c"], ["seq"])
    groups = vo.run_summaries(vo.runs_of_summaries(pieces, [*vo.VOTE_KEYS, "g"], ["c"]), [*vo.VOTE_KEYS, "g"], ["c", "_at"])
    whole = vo.run_summaries(vo.runs_of_summaries(groups, vo.VOTE_KEYS, ["g"]), vo.VOTE_KEYS, ["g", "_at"])
    assert whole.where("n <> first_n AND n < first_n + last_n").isEmpty()
    assert {r["target_id"]: r["value"] for r in vo.state_of_summaries(whole).collect()} == want


def test_a_batch_writes_its_own_summaries_only(spark, tmp_path):
    """Five batches of 100 creation votes each write 100 summaries, whatever came before."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    for number in range(5):
        ids = spark.range(number * 100, number * 100 + 100)
        made = ids.select("id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("author_uid"), (F.col("id") * 1000).alias("created_ms"))
        made.write.mode("append").parquet(source)
        stream = spark.readStream.schema(made.schema).parquet(source)
        cast = vo.creation_votes(stream, "post").withColumn("created", F.lit(0))
        sv.summarise_votes(cast, out, checkpoint).awaitTermination()
    store = sv.vote_store(spark, out)
    held = store.manifest()
    assert [store.load(sv.HOURS, [f]).count() for f in held.folders[sv.HOURS]] == [100] * 5
    assert sv.state_so_far(spark, out).count() == 500


def test_votes_over_many_merges_and_late_batches(spark, tmp_path):
    rows = sorted(vote_rows(600, 21), key=lambda r: (r[1], r[0]))
    rng = random.Random(2)
    parts = [rows[:150], rows[300:450], *[[] for _ in range(5)], rows[450:]]
    for r in rows[150:300]:
        parts[2 + rng.randrange(5)].append(r)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    for part in parts:
        votes(spark, part).coalesce(1).write.mode("append").parquet(source)
        sv.summarise_votes(spark.readStream.schema(votes(spark, part).schema).parquet(source), out, checkpoint, fan=2).awaitTermination()
    got = {(r["user_uid"], r["target_id"]): r["value"] for r in sv.state_so_far(spark, out).collect()}
    assert got == {k: v for k, v in brute_state(rows).items() if v}
    assert len(sv.vote_store(spark, out).manifest().folders[sv.HOURS]) <= 3


def requests(spark, days):
    """One request a minute of some days, every third by a crawler."""
    base = spark.createDataFrame([(d,) for d in days], "d string").crossJoin(spark.range(30))
    agent = F.when(F.col("id") % 3 == 0, "Mozilla/5.0 (compatible; Googlebot/2.1)").otherwise("Mozilla/5.0 (Windows NT 10.0)")
    return base.select(
        F.col("id").alias("request_id"), F.expr("to_timestamp_ntz(d) + make_dt_interval(0, 0, id)").alias("ts"), F.lit("https://a.example/x").alias("url"),
        F.lit("GET").alias("method"), agent.alias("user_agent"), F.lit("").alias("sec_ch_ua_platform"),
        F.concat(F.lit("https://r"), (F.col("id") % 4).cast("string"), F.lit(".example/")).alias("referer"), F.lit("1.2.3.4").alias("ip_address"), F.lit("US").alias("country"),
    )


def test_days_roll_up_into_the_lifetime(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))

    def land(*days):
        made = requests(spark, days)
        made.coalesce(1).write.mode("append").parquet(source)
        su.count_requests(spark.readStream.schema(made.schema).parquet(source), out, checkpoint, fan=3).awaitTermination()

    def lifetime():
        return rows_of(su.lifetime_so_far(spark, out))

    land("2026-01-01", "2026-01-20")
    land("2026-02-10")
    before = lifetime()
    assert before == rows_of(us.lifetime_counts(su.counters_so_far(spark, out)))
    su.roll_up(spark, out, "2026-02-10")  # keeps 2026-01-12 and later
    assert lifetime() == before
    counters = su.counters_so_far(spark, out)
    assert {str(r["day"]) for r in counters.select("day").distinct().collect()} == {"2026-01-20", "2026-02-10"}
    plan = counters._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(day" in plan
    su.roll_up(spark, out, "2026-02-10")
    assert lifetime() == before
    land("2026-01-01", "2026-03-01")  # late rows of a day that is gone, and new ones
    after = lifetime()
    total = {r["key"]: r["n"] for r in su.lifetime_so_far(spark, out).where("what = 'global_count'").collect()}
    assert total == {"": 150}
    su.roll_up(spark, out, "2026-03-01")
    assert lifetime() == after
    assert su.drop_rolled_days(spark, out) >= 2
    assert lifetime() == after
    assert {str(r["day"]) for r in su.counters_so_far(spark, out).select("day").distinct().collect()} == {"2026-02-10", "2026-03-01"}


def test_counts_over_many_batches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    for number in range(7):
        made = spark.range(10).select((F.col("id") % 3 + number).alias("post_id"), F.lit("active").alias("status"))
        made.coalesce(1).write.mode("append").parquet(source)
        mb.count_comments(spark.readStream.schema(made.schema).parquet(source), out, checkpoint).awaitTermination()
    assert mb.comments_so_far(spark, out).agg(F.sum("comment_count")).first()[0] == 70
