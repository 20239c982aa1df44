"""Company registry: normalisation, look-ups and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as tx

# Most companies in the registry, and in a search result.
REGISTRY_MAX = 500
SEARCH_LIMIT = 20
# Name patterns and the industry they stand for, tried in this order.
INDUSTRY_PATTERNS = (
    ("bank|financial|capital|credit|visa|mastercard|amex|express", "Financial Services"),
    ("health|medical|pharma|lilly|pfizer|abbott|amgen|merck", "Healthcare"),
    ("energy|oil|petroleum|gas|chevron|exxon|valero", "Energy"),
    ("air|boeing|aerospace|defense|lockheed|raytheon", "Aerospace / Defense"),
    ("motor|auto|tesla|ford|gm|deere", "Automotive / Industrial"),
    ("tech|data|software|systems|oracle|microsoft|apple|nvidia|intel|cisco|adobe", "Technology"),
    ("insurance|mutual|life|allstate|farm", "Insurance"),
    ("walmart|costco|target|kroger|dollar|stores|retail|depot|lowe", "Retail"),
)
OTHER_INDUSTRY = "Fortune 500"


def infer_industry(name: Column) -> Column:
    text = F.lower(tx.blank_if_null(name))
    found = F.when(F.lit(False), F.lit(""))
    for pattern, industry in INDUSTRY_PATTERNS:
        found = found.when(text.rlike(pattern), industry)
    return found.otherwise(OTHER_INDUSTRY)


def first_companies(df: DataFrame, most: int = REGISTRY_MAX) -> DataFrame:
    """The first rows of a registry, in input order."""
    return df.orderBy("ordinal").limit(most)


def normalize_companies(df: DataFrame, overrides: DataFrame | None = None, most: int = REGISTRY_MAX) -> DataFrame:
    """Registry rows from (ordinal, rank, name, industry, domain); ``overrides`` maps name to domain.

    Figures and places are taken over where the input has them.
    """
    place = F.row_number().over(Window.orderBy("ordinal"))
    rows = first_companies(df, most).withColumn("_place", place)
    name = tx.first_filled(F.col("name"), F.concat(F.lit("Company "), F.col("_place").cast("string")))
    rows = rows.withColumn("name", name)
    if overrides is None:
        rows = rows.withColumn("_known", F.lit(None).cast("string"))
    else:
        # Left side: at most ``most`` rows, so Spark may broadcast it whatever the size of the overrides.
        known = overrides.groupBy("name").agg(F.max("domain").alias("_known"))
        rows = rows.join(known, "name", "left")
    def given(column: str, kind: str, default) -> Column:
        value = F.col(column) if column in df.columns else F.lit(None)
        return F.coalesce(value.cast(kind), F.lit(default).cast(kind)).alias(column)

    return rows.select(
        "ordinal",
        F.coalesce(F.nullif(F.col("rank"), F.lit(0)), F.col("_place")).cast("long").alias("rank"),
        "name",
        F.coalesce(F.nullif(F.col("industry"), F.lit("")), infer_industry(F.col("name"))).alias("industry"),
        tx.slug(F.col("name")).alias("slug"),
        F.coalesce(
            F.nullif(F.col("domain"), F.lit("")),
            F.nullif(F.col("_known"), F.lit("")),
            tx.domain_guess(F.col("name"), tx.REGISTRY_STOP_WORDS),
        ).alias("domain"),
        given("revenue_millions", "double", None),
        given("employees", "bigint", None),
        given("headquarters", "string", ""),
        given("state", "string", ""),
    )


def company_by_slug(registry: DataFrame) -> DataFrame:
    """One company per slug; the last one in input order wins."""
    last = Window.partitionBy("slug").orderBy(F.col("ordinal").desc())
    return registry.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def search_companies(registry: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    needle = query.lower().strip()
    if not needle:
        return registry.limit(0)
    texts = (F.lower("name"), F.col("slug"), F.lower("industry"))
    hit = F.lit(False)
    for text in texts:
        hit = hit | F.contains(text, F.lit(needle))
    return registry.where(hit).orderBy("ordinal").limit(limit)


def with_company_domain(listings: DataFrame, registry: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Domain of a listing: host of its link, else registry by name, else override, else a guess.

    A registry of any size is looked up whole. Spark chooses the join by its size and splits a very common company.
    """
    wanted = F.lower(tx.clean(F.col("company")))
    first = Window.partitionBy("_name").orderBy("ordinal")
    known = (
        registry.withColumn("_name", F.lower(tx.clean(F.col("name"))))
        .where("_name <> ''")
        .withColumn("_rank", F.row_number().over(first))
        .where("_rank = 1")
        .select("_name", F.col("domain").alias("_registered"))
    )
    out = listings.withColumn("_name", wanted).join(known, "_name", "left")
    if overrides is None:
        out = out.withColumn("_override", F.lit(None).cast("string"))
    else:
        extra = overrides.groupBy(F.col("name").alias("company")).agg(F.max("domain").alias("_override"))
        out = out.join(extra, "company", "left")
    domain = F.coalesce(
        F.nullif(tx.host_of_url(F.col("apply")), F.lit("")),
        F.nullif(F.col("_registered"), F.lit("")),
        F.nullif(F.col("_override"), F.lit("")),
        tx.domain_guess(F.lower(tx.clean(F.col("company")))),
    )
    return out.withColumn("company_domain", domain).drop("_name", "_registered", "_override")


def with_post_company(posts: DataFrame, registry: DataFrame) -> DataFrame:
    """Company name and industry of each post; an unknown slug gives its words and 'Company'."""
    known = company_by_slug(registry).select(
        F.col("slug").alias("company_slug"), F.col("name").alias("_name"), F.col("industry").alias("_industry")
    )
    return (
        posts.join(known, "company_slug", "left")
        .withColumn("company_name", F.coalesce("_name", F.replace(F.col("company_slug"), F.lit("-"), F.lit(" "))))
        .withColumn("company_industry", F.coalesce("_industry", F.lit("Company")))
        .drop("_name", "_industry")
    )
