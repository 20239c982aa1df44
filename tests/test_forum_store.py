"""Posts and comments in buckets by company."""

import random

from pyspark.sql import functions as F

from larkspur.operators import threads as th
from larkspur.sources import forum_store as fs

POSTS = "id long, company_slug string, title string, created_ms long, status string"
COMMENTS = "id long, post_id long, parent_id long, company_slug string, created_ms long, status string"


def tables(spark):
    """One company holds a third of the posts; some comments have no post, another company's name or a null status."""
    rng = random.Random(1)
    company = lambda: "hot" if rng.random() < 0.33 else rng.choice(["a", "b", "c", None])
    status = lambda: rng.choice(["active", "active", "active", "deleted", None])
    posts = [(k, company(), f"t{k}", rng.randrange(500), status()) for k in range(400)]
    comments = [(k, rng.randrange(420), None, company(), rng.randrange(900), status()) for k in range(9000)]
    return spark.createDataFrame(posts, POSTS), spark.createDataFrame(comments, COMMENTS)


def test_pages_equal_the_whole_join(spark, tmp_path):
    posts, comments = tables(spark)
    path = str(tmp_path / "forum")
    fs.land_forum(posts, comments, path, buckets=8)
    whole = th.loaded_comments(posts, comments).join(posts.select(F.col("id").alias("post_id"), F.col("company_slug").alias("of")), "post_id")
    for company in ("hot", "a", "b", "c", "nobody"):
        got = fs.company_comments(spark, path, company).select(*comments.columns).collect()
        want = whole.where(F.col("of") == company).select(*comments.columns).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and (company == "nobody" or len(got) > 100)


def test_a_page_reads_one_bucket_without_a_shuffle(spark, tmp_path):
    posts, comments = tables(spark)
    path = str(tmp_path / "forum")
    fs.land_forum(posts, comments, path, buckets=8)
    page = fs.company_comments(spark, path, "a")
    page.collect()
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 8" in plan and "hashpartitioning" not in plan
    # Another session's catalog does not know the tables yet.
    rows = page.count()
    for table in fs.TABLES:
        spark.sql(f"DROP TABLE {fs._name(path, table)}")
    assert fs.company_comments(spark, path, "a").count() == rows
    fs.land_forum(posts.limit(0), comments.limit(0), str(tmp_path / "empty"), buckets=4)
    assert fs.company_comments(spark, str(tmp_path / "empty"), "a").count() == 0
