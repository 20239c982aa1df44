"""Company registry and job table files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators.companies import REGISTRY_MAX, infer_industry
from larkspur.sources.order import input_order

# Fixed value: a registry line is rank, name and a number, each followed by a comma.
REGISTRY_LINE = r"^([0-9]+),(.+?),([0-9]+(?:\.[0-9]+)?),"
# Texts that stand for a missing cell in a job table.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_registry_csv(spark: SparkSession, path: str, most: int = REGISTRY_MAX) -> DataFrame:
    """Companies of the first matching lines in input order; header and other lines are dropped."""
    lines = spark.read.text(path).select("value", input_order().alias("_order"))
    order = ["_order"]
    first = lines.where(F.col("value").rlike(REGISTRY_LINE)).orderBy(*order).limit(most)
    name = F.regexp_extract("value", REGISTRY_LINE, 2)
    # At most ``most`` rows reach this window.
    return first.withColumn("ordinal", F.row_number().over(Window.orderBy(*order)).cast("long")).select(
        "ordinal",
        F.regexp_extract("value", REGISTRY_LINE, 1).cast("long").alias("rank"),
        name.alias("name"),
        infer_industry(name).alias("industry"),
        F.lit("").alias("domain"),
    )


def read_registry_json(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a JSON document with a ``data`` array."""
    schema = (
        "array<struct<rank:bigint,company:string,name:string,industry:string,domain:string,revenueMillions:double,"
        "revenue:double,employees:bigint,headquarters:string,state:string>>"
    )
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.data"), schema)).alias("ordinal", "c"))
    texts = [tx.blank_if_null(F.col(f"c.{c}")).alias(c) for c in ("industry", "domain", "headquarters", "state")]
    return rows.select(
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col("c.rank").alias("rank"),
        tx.first_filled(F.col("c.company"), F.col("c.name")).alias("name"),
        *texts,
        F.coalesce("c.revenueMillions", "c.revenue").alias("revenue_millions"),
        F.col("c.employees").alias("employees"),
    )


def write_jobs_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def read_jobs_csv(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Job table for analysis: the first rows, in order of file names and lines, if asked; missing cells as ''."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    names = raw.columns
    rows = raw if most is None else raw.withColumn("_order", input_order()).orderBy("_order").limit(most)
    return rows.select(
        *[F.when(F.col(c).isNull() | F.col(c).isin(*MISSING), "").otherwise(F.col(c)).alias(c) for c in names]
    )
