"""Counts and trends over listings: data set profile, skill trend, hiring momentum, job-skill bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as tx


def profile(df: DataFrame) -> DataFrame:
    """One row: number of rows and the columns."""
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"), F.lit(",".join(df.columns)).alias("columns")
    )


def preview(df: DataFrame, order_col: str, rows: int) -> DataFrame:
    return df.orderBy(order_col).limit(rows)


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value of each column with the share of all rows, from one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counted = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))
    # One row per named column.
    totals = counted.groupBy("column").agg(F.sum("n").alias("_all"))
    return counted.join(F.broadcast(totals), "column").withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def _month(posted: Column) -> Column:
    """First day of the month of a date text; NULL where the text is no date."""
    day = F.date_from_unix_date(F.floor(tx.date_millis(posted) / 86400000).cast("int"))
    return F.trunc(day, "MM")


def _with_change(counted: DataFrame, key: str) -> DataFrame:
    # One row per key and month, so a group is as long as the span of months.
    by_month = Window.partitionBy(key).orderBy("month")
    return counted.withColumn("change", F.col("n") - F.lag("n").over(by_month))


def skill_trend(listings: DataFrame) -> DataFrame:
    """Postings per skill or certification and month, with the change to the month before in the data."""
    skill = F.explode(F.array_distinct(F.concat("skills", "certifications"))).alias("skill")
    rows = listings.select(_month(F.col("posted")).alias("month"), skill).where(F.col("month").isNotNull())
    return _with_change(rows.groupBy("skill", "month").agg(F.count("*").alias("n")), "skill")


def hiring_momentum(listings: DataFrame) -> DataFrame:
    """Postings per company and month, with the change to the month before in the data."""
    rows = listings.select("company", _month(F.col("posted")).alias("month")).where(F.col("month").isNotNull())
    return _with_change(rows.groupBy("company", "month").agg(F.count("*").alias("n")), "company")


def job_skill_bridge(listings: DataFrame) -> DataFrame:
    """One row per listing and skill or certification; duplicates go within the row, without a shuffle."""

    def tagged(column: str, kind: str) -> Column:
        return F.transform(F.array_distinct(F.col(column)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("skill")))

    both = F.concat(tagged("skills", "skill"), tagged("certifications", "certification"))
    return listings.select("id", F.inline(both))
