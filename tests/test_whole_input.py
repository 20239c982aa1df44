"""Rows that used to be dropped or doubled: caps, unknown values, removed comments, days, plans that read twice."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions.text import date_millis
from larkspur.operators import companies as co
from larkspur.operators import threads as th
from larkspur.operators import usage as us
from larkspur.operators import votes as vo
from larkspur.operators.state import job_state
from larkspur.plans import registered
from larkspur.session import release_runs, run_dir, stored
from larkspur.sources.listings import land_listings_csv, path_exists, read_listings_csv

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["n1_normalize_listings", "l1_listing_search", "f2_search_listings"])
def test_listings_are_scanned_once(spark, name):
    plan = registered.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/orders.parquet") == 1


def test_votes_beyond_a_thousand(spark):
    state = spark.range(1200).selectExpr("'u' user_uid", "'comment' target_type", "id target_id", "1 value")
    state = state.unionByName(spark.range(5).selectExpr("'u' user_uid", "'post' target_type", "id + 5000 target_id", "1 value"))
    rows = spark.range(5000, 5006).toDF("id")
    assert [r["my_vote"] for r in vo.with_my_vote(rows, state, "u", "post").orderBy("id").collect()] == [1] * 5 + [0]
    assert [r["my_vote"] for r in vo.with_my_vote(rows, state, "u", "post", most=2).orderBy("id").collect()] == [1, 1, 0, 0, 0, 0]


def test_registry_of_any_size(spark):
    firms = spark.range(1, 700).selectExpr("id ordinal", "concat('Firm ', id) name", "concat('f', id, '.example') domain")
    rows = spark.createDataFrame([(1, "Firm 650", "")], "ordinal long, company string, apply string")
    assert co.with_company_domain(rows, firms).first()["company_domain"] == "f650.example"


def test_unknown_actions_do_nothing(spark):
    events = spark.createDataFrame([("u", "1", "save", 1), ("u", "1", "view", 2), ("u", "2", None, 3)], "user_uid string, job_id string, action string, ts long")
    assert [(r["job_id"], r["kind"]) for r in job_state(events).collect()] == [("1", "saved")]


def test_replies_of_a_removed_comment_move_up(spark):
    rows = [(1, 7, None, "active"), (2, 7, 1, "removed"), (3, 7, 2, "active"), (4, 8, None, "active"), (5, 7, 3, "active")]
    comments = spark.createDataFrame([(*r, r[0]) for r in rows], "id long, post_id long, parent_id long, status string, created_ms long")
    posts = spark.createDataFrame([(7, 0)], "id long, comment_count long")
    paths = th.thread_paths(comments, posts)
    assert {r["id"]: r["depth"] for r in paths.collect()} == {1: 0, 3: 0, 5: 1}
    assert [r["comment_count"] for r in th.tree_counts(posts, paths).collect()] == [3]


def test_days_are_utc_for_timestamps(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        rows = spark.createDataFrame([(1, "https://a.example/", "")], "request_id long, url string, x string").select(
            "request_id", "url", F.timestamp_seconds(F.lit(1704074400)).alias("ts"),
            *[F.lit("").alias(c) for c in ("user_agent", "sec_ch_ua_platform", "referer", "ip_address", "country")],
        )
        assert str(us.enrich_requests(rows).first()["day"]) == "2024-01-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_date_forms(spark):
    day = 1714521600000  # 1 May 2024
    forms = {
        "1 May 2024": 0, "Wed, 01 May 2024 10:00:00 GMT": 10, "2024/05/01": 0, "May 1, 2024 10:00": 10, "2024/5/1 07:30": 7.5,
        "Wednesday, May 1, 2024": 0, "May 1, 2024 12:15 AM": 0.25, "Wed May 01 2024 10:00:00 GMT-0500": 15, "1 May 2024, 1:00 pm +0130": 11.5,
    }
    bad = ["May 32, 2024", "1 Foo 2024", "May 1, 2024 25:00", "2024/13/01", "Wed"]
    df = spark.createDataFrame([(t,) for t in [*forms, *bad]], "t string").select("t", date_millis(F.col("t")).alias("ms"))
    got = {r["t"]: r["ms"] for r in df.collect()}
    assert got == {**{t: day + int(h * 3600000) for t, h in forms.items()}, **dict.fromkeys(bad)}


def test_csv_files_keep_their_order(spark, tmp_path):
    for k, n in enumerate((3, 4000, 1, 900)):
        (tmp_path / f"part-{k}.csv").write_text("id,name\n" + "".join(f"{k}-{i},{'x' * 50}\n" for i in range(n)))
    want = [f"{k}-{i}" for k, n in enumerate((3, 4000, 1, 900)) for i in range(n)]
    got = read_listings_csv(spark, str(tmp_path), multi_line=False).orderBy("ordinal").collect()
    assert [r["id"] for r in got] == want and len({r["ordinal"] for r in got}) == len(want)
    landed = land_listings_csv(spark, str(tmp_path), str(tmp_path / "landed"))
    assert [r["id"] for r in landed.orderBy("ordinal").collect()] == want


def test_runs_are_released(spark):
    kept = stored(spark.range(3), "small")
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert path_exists(spark, path) and run_dir(spark, "x") != run_dir(spark, "x")
    release_runs(spark)
    assert not path_exists(spark, path)
