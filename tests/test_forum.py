"""Votes, threads, checks and merges against brute force and hand-written rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from larkspur.operators import forum as fm
from larkspur.operators import threads as th
from larkspur.operators import usage as us
from larkspur.operators import votes as vo
from larkspur.operators.ordered import with_previous

START = datetime(2024, 1, 1)


def fold(deltas):
    live = 0
    for d in deltas:
        live = 0 if live == d else d
    return live


def vote_rows(n, seed, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        user = "u0" if rng.random() < hot else f"u{rng.randint(1, 9)}"
        target = 0 if user == "u0" else rng.randint(0, 3)
        ts = START + timedelta(minutes=rng.randint(0, 60 * 30))
        rows.append((seq, ts, user, "post", target, rng.choice([1, 1, 1, -1])))
    return rows


def votes(spark, rows):
    return spark.createDataFrame(rows, "seq long, ts timestamp_ntz, user_uid string, target_type string, target_id long, delta int")


def brute_state(rows):
    per = {}
    for seq, ts, user, _, target, delta in sorted(rows, key=lambda r: (r[1], r[0])):
        per.setdefault((user, target), []).append(delta)
    return {k: fold(v) for k, v in per.items()}


def test_vote_state_equals_a_fold(spark):
    for seed in range(4):
        rows = vote_rows(600, seed)
        got = {(r["user_uid"], r["target_id"]): r["value"] for r in vo.vote_state(votes(spark, rows).repartition(6)).collect()}
        assert got == brute_state(rows)
    by_minute = vo.vote_state(votes(spark, rows), chunk="minute")
    assert {(r["user_uid"], r["target_id"]): r["value"] for r in by_minute.collect()} == brute_state(rows)


def test_one_voter_across_hours(spark):
    # Runs that span hours, in every combination of three hours of up to two votes.
    rows, seq, expected = [], 0, {}
    patterns = [(), (1,), (-1,), (1, 1), (1, -1), (-1, 1)]
    for i, a in enumerate(patterns):
        for j, b in enumerate(patterns):
            for k, c in enumerate(patterns):
                user = f"{i}{j}{k}"
                if a + b + c:
                    expected[user] = fold(a + b + c)
                for hour, part in enumerate((a, b, c)):
                    for m, d in enumerate(part):
                        rows.append((seq, START + timedelta(hours=hour, minutes=m), user, "post", 1, d))
                        seq += 1
    got = {r["user_uid"]: r["value"] for r in vo.vote_state(votes(spark, rows)).collect()}
    assert got == expected


def test_creation_counts_as_the_first_vote(spark):
    posts = spark.createDataFrame([(1, "a", 1704067200000), (2, "b", 1704067200000)], "id long, author_uid string, created_ms long")
    comments = posts.limit(0)
    # Both vote in the very moment of creation; creation still comes first.
    events = votes(spark, [(5, START, "a", "post", 1, 1), (6, START, "b", "post", 1, 1), (7, START, "b", "post", 2, -1)])
    state = vo.vote_state(vo.all_votes(posts, comments, events))
    got = {(r["user_uid"], r["target_id"]): r["value"] for r in state.collect()}
    assert got == {("a", 1): 0, ("b", 1): 1, ("b", 2): -1}
    assert {r["target_id"]: r["score"] for r in vo.scores(state).collect()} == {1: 1, 2: -1}
    stats = {r["uid"]: (r["posts"], r["comments"], r["votes_cast"], r["karma"]) for r in vo.member_stats(posts, comments, state).collect()}
    assert stats == {"a": (1, 0, 0, 1), "b": (1, 0, 2, 1)}
    mine = {r["id"]: r["my_vote"] for r in vo.with_my_vote(posts, state, "b", "post").collect()}
    assert mine == {1: 1, 2: -1}


def comments(spark, rows):
    return spark.createDataFrame(rows, "id long, post_id long, parent_id long, created_ms long").withColumn("status", F.lit("active"))


def test_threads(spark):
    rows = [
        (1, 10, None, 5), (2, 10, 1, 9), (3, 10, 1, 7), (4, 10, 3, 8), (5, 10, 99, 6), (6, 20, 4, 1),
        (7, 10, 7, 1), (8, 10, 9, 1), (9, 10, 8, 1), (11, 10, 9, 1), (12, 10, 7, 3),
    ]
    paths = th.thread_paths(comments(spark, rows))
    got = {r["id"]: (r["root_post_id"], r["depth"], r["in_cycle"]) for r in paths.collect()}
    assert {i: got[i] for i in (1, 2, 3, 4, 5)} == {1: (10, 0, False), 2: (10, 1, False), 3: (10, 1, False), 4: (10, 2, False), 5: (10, 0, False)}
    # A reply to a comment of another post stands there.
    assert got[6] == (10, 3, False)
    assert all(got[i][2] for i in (7, 8, 9, 11, 12))
    order = [r["id"] for r in th.thread_tree(comments(spark, rows)).collect()]
    assert order == [1, 3, 4, 6, 2, 5]
    posts = spark.createDataFrame([(10, 2), (20, 4), (30, 0)], "id long, comment_count long")
    assert {r["id"]: r["comment_count"] for r in th.tree_counts(posts, paths).collect()} == {10: 6, 20: 4, 30: 0}
    assert {r["id"]: r["comment_count"] for r in th.comment_counts(posts, comments(spark, rows)).collect()} == {10: 10, 20: 4, 30: 0}


def test_deep_thread(spark):
    rows = [(i, 1, i - 1 if i else None, i) for i in range(300)]
    got = th.thread_tree(comments(spark, rows)).collect()
    assert [r["depth"] for r in got] == list(range(300))


def test_random_forest(spark):
    rng = random.Random(3)
    rows = [(i, i % 4, rng.choice([None, *range(max(0, i - 20), i)]) if i else None, rng.randint(0, 99)) for i in range(250)]
    parent = {r[0]: r[2] for r in rows}

    def chain(i):
        return [i] if parent[i] is None else [*chain(parent[i]), i]

    got = {r["id"]: [s["id"] for s in r["path"]] for r in th.thread_tree(comments(spark, rows)).collect()}
    assert got == {i: chain(i) for i in parent}


def test_loaded_comments_share_the_limit(spark):
    # 75 posts shown, so 8 look-ups of ten posts with 88 comments each; one post holds most comments.
    posts = spark.range(80).select(
        "id", F.lit("c").alias("company_slug"), F.lit("active").alias("status"), F.col("id").alias("created_ms")
    )
    hot = spark.range(1000).select(
        F.col("id"), F.lit(79).cast("long").alias("post_id"), F.lit("active").alias("status"), F.col("id").alias("created_ms")
    )
    few = spark.range(2000, 2080).select(
        "id", (F.col("id") - 2000).alias("post_id"), F.lit("active").alias("status"), (F.col("id") - 2000).alias("created_ms")
    )
    got = th.loaded_comments(posts, hot.unionByName(few)).collect()
    # The look-up of posts 70..79 is full; posts 0..4 are not shown; the other 65 posts have one comment each.
    assert len(got) == 88 + 65
    first = sorted((r["created_ms"], r["id"]) for r in got if r["post_id"] >= 70)
    expected = sorted([(i, i) for i in range(1000)] + [(i, 2000 + i) for i in range(70, 80)])[:88]
    assert first == expected


def test_previous_value_across_chunks(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), rng.randint(0, 20), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, v int").withColumn("chunk", F.floor(F.col("t") / 4))
    got = {r["v"]: r["previous_v"] for r in with_previous(df, ["k"], ["t", "v"], ["v"], "chunk").collect()}
    expected = {}
    for key in "ab":
        before = None
        for _, _, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            expected[v], before = before, v
    assert got == expected


def test_checks(spark):
    rows = [("s", "t", "b", 1, 0, "active"), ("", "t" * 301, "b" * 6001, 2, 1, "gone"), (None, "", None, None, None, None)]
    df = spark.createDataFrame(rows, "company_slug string, title string, body string, score int, comment_count int, status string")
    checked = fm.check_new_posts(df)
    every = ["status", "company_slug", "title", "body", "score", "comment_count"]
    assert [r["failed"] for r in checked.collect()] == [[], every, every]
    assert (fm.accepted(checked).count(), fm.quarantined(checked).count()) == (1, 2)
    votes_df = spark.createDataFrame([(1, "post", "s"), (0, "user", "s" * 141)], "value int, target_type string, company_slug string")
    assert [r["failed"] for r in fm.check_votes(votes_df).collect()] == [[], ["value", "target_type", "company_slug"]]
    steps = [(1, 0, 1, 0), (1, 1, 3, 1), (1, 2, 0, 1), (1, 3, 0, 3), (1, 4, 0, 2)]
    versions = spark.createDataFrame([(i, START + timedelta(minutes=40 * s), s, a, b) for i, s, a, b in steps],
                                     "id int, ts timestamp_ntz, seq int, score int, comment_count int")
    got = {r["seq"]: r["failed"] for r in fm.check_updates(versions).collect()}
    assert got == {0: [], 1: [], 2: ["score"], 3: ["comment_count"], 4: ["comment_count"]}


def test_normalize_and_profiles(spark):
    df = spark.createDataFrame([("", None, "", "Bo", "May 1, 2026", None, "x")], "id string, title string, body string, author string, created_at string, updated_at string, score string")
    row = fm.normalize_posts(df, 7).first()
    assert row["id"].startswith("p-") and row["title"] == "Untitled thread" and row["author_name"] == "Bo"
    assert (row["created_ms"], row["updated_ms"], row["status"], row["comment_count"]) == (1777593600000, 1777593600000, "active", 0.0)
    assert row["score"] != row["score"]
    bad = spark.createDataFrame([("1", "whenever")], "id string, created_at string")
    assert fm.normalize_comments(bad, 7).first()["created_ms"] == 7
    users = spark.createDataFrame([("u", "  ", "h" * 130, "b " * 400, 3, 9), (None, " N ", None, None, 3, None)],
                                  "uid string, display_name string, headline string, bio string, posts long, user_posts long")
    a, b = fm.sanitize_profiles(users).collect()
    assert (a["display_name"], len(a["headline"]), len(a["bio"]), a["posts"], a["karma"]) == ("Community Member", 120, 500, 9, 0)
    assert (b["uid"], b["display_name"], b["headline"], b["posts"]) == ("guest", "N", "", 3)


def test_merge_stores(spark):
    def store(rows):
        return spark.createDataFrame(rows, "company_slug string, id string, title string, ordinal long")

    current = store([("s", "1", "c1", 0), ("s", "1", "c1 again", 1)])
    first = store([("s", "1", "f1", 0), ("s", "2", "f2", 1), ("t", "1", "f3", 2)])
    second = store([("s", "2", "s2", 0), ("s", "3", "s3", 1), ("s", "3", "s3 again", 2)])
    assert sorted(r["title"] for r in fm.merge_stores([current, first, second]).collect()) == ["c1", "c1 again", "f2", "f3", "s3"]
    assert fm.merge_stores([current]).count() == 2


def test_sorting_and_activity(spark):
    posts = spark.createDataFrame([(1, 5, 0, 100, "a"), (2, 1, 3, 50, "a"), (3, 5, 0, 200, "b")], "id long, score long, comment_count long, created_ms long, author_uid string").withColumn("status", F.lit("active"))
    order = {m: [r["id"] for r in fm.sort_posts(posts, m).collect()] for m in ("new", "top", "hot")}
    assert order == {"new": [3, 1, 2], "top": [3, 1, 2], "hot": [2, 3, 1]}
    many = spark.range(50).select("id", F.lit("a").alias("author_uid"), F.col("id").alias("created_ms"), F.lit("active").alias("status"))
    users = spark.createDataFrame([("a",), ("z",)], "uid string")
    got = fm.user_activity(users, posts.select(*many.columns), many)
    assert got.where("kind = 'comment'").count() == 20
    assert got.where("uid = 'z'").first()["kind"] is None


def test_upgrade_and_report(spark):
    old = spark.createDataFrame([("2026-01-01", "x", {"mac": 2}, {}), ("2026-01-02", "4", {"mac": 1}, {"ios": 5})],
                                "day string, global_count string, devices map<string,bigint>, sdk_devices map<string,bigint>")
    a, b = us.upgrade_buckets(old).orderBy("day").collect()
    assert (a["global_count"], a["sdk_devices"], a["bots"], b["global_count"], b["sdk_devices"]) == (0.0, {"mac": 2}, {}, 4.0, {"ios": 5})
    days = spark.createDataFrame([("2026-01-01",), ("2026-01-02",), ("2026-01-31",), ("legacy",)], "day string")
    assert [r["day"] for r in us.retained(days, "2026-01-31").collect()] == ["2026-01-02", "2026-01-31", "legacy"]
