"""Posts and comments stored in buckets by company, so that a company's page reads its own buckets and shuffles no comments."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.threads import active, wanted_posts, within_share

BUCKETS = 64
#: The column of stored comments that names the company of their post.
COMPANY = "post_company"
TABLES = {"posts": ("company_slug", ["company_slug", "id"]), "comments": (COMPANY, [COMPANY, "post_id", "created_ms"])}


def _name(path: str, table: str) -> str:
    return f"forum_{zlib.crc32(path.encode()):08x}_{table}"


def land_forum(posts: DataFrame, comments: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write both tables under ``path``. Comments are stored by the company of their post, found here once; those of unknown
    posts are on no page and stay out. A null company is a bucket like any other."""
    spark = posts.sparkSession
    of_post = posts.select(F.col("id").alias("post_id"), F.col("company_slug").alias(COMPANY))
    for table, rows in (("posts", posts), ("comments", comments.join(of_post, "post_id").select(*comments.columns, COMPANY))):
        key, order = TABLES[table]
        # Rebalancing gives small companies one file each and splits the shuffle partition of a hot one.
        dealt = rows.hint("rebalance", buckets, key)
        dealt.write.bucketBy(buckets, key).sortBy(*order).option("path", f"{path}/{table}").format("parquet").saveAsTable(_name(path, table))
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")


def open_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table, made known to the session's catalog if another session has written it."""
    name = _name(path, table)
    if not spark.catalog.tableExists(name):
        key, order = TABLES[table]
        buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{table}").schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}/{table}'")
    return spark.table(name)


def company_posts(spark: SparkSession, path: str, company: str) -> DataFrame:
    return open_table(spark, path, "posts").where(F.col("company_slug") == company)


def company_comments(spark: SparkSession, path: str, company: str) -> DataFrame:
    """The comments that a company's page loads: those of its newest posts, as ``loaded_comments`` gives them.

    One bucket of each table is read. The wanted posts, POSTS_MAX rows at most, are broadcast, and the comments are ranked in the bucket
    they lie in.
    """
    wanted = F.broadcast(wanted_posts(company_posts(spark, path, company)))
    stored = active(open_table(spark, path, "comments").where(F.col(COMPANY) == company))
    return within_share(stored.join(wanted, "post_id"), COMPANY).drop(COMPANY)
