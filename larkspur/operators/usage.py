"""Request usage: enrichment, lifetime totals and daily counters."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import requests as rq
from larkspur.functions import text as tx
from larkspur.functions.times import utc_day, utc_timestamp

# Fixed value: days kept in the daily counters, the current one included.
RETENTION_DAYS = 30
DIMENSIONS = ("sdk_devices", "devices", "ip_addresses", "countries", "external_referrers", "bots")
BOUNDED = ("countries", "bots")
PAIRS = "device_bots"
# Lifetime counts and the daily dimension they are the sum of.
LIFETIME = {
    "global_count": "global_count", "crawler_count": "crawler_count", "bots": "bots", "external_referrers": "external_referrers",
    "sdk_devices": "device_global", "devices": "device_crawler", PAIRS: PAIRS,
}


def ingest_requests(df: DataFrame) -> DataFrame:
    """Accepted request records: a valid URL is required; any method but HEAD counts as GET."""
    method = F.when(F.upper(tx.blank_if_null(F.col("method"))) == "HEAD", "HEAD").otherwise("GET")
    return df.withColumn("url", tx.trim(F.col("url"))).where(tx.url_host(F.col("url")) != "").withColumn("method", method)


def trackable(df: DataFrame, skipped: tuple[str, ...] = rq.SKIPPED_PATHS) -> DataFrame:
    return df.where(rq.is_trackable(F.col("method"), F.col("url"), skipped))


def enrich_requests(df: DataFrame) -> DataFrame:
    """Day, device, crawler, address, country and external referrer of each request.

    Texts used more than once are computed in a step of their own, so that each is evaluated once per row.
    """
    agent = F.col("user_agent")
    texts = df.withColumns(
        {
            "_platform": rq.platform_name(F.col("sec_ch_ua_platform")),
            "_bracket": rq.bracket_name(agent),
            "_host": tx.url_host(F.col("referer")),
            "_own": tx.url_host(F.col("url")),
        }
    )
    named, bracket = F.col("_platform"), F.col("_bracket")
    device = (
        F.when(~named.isin("", "unknown"), named)
        .when(~bracket.isin("", "unknown"), bracket)
        .otherwise(rq.device_kind(agent))
    )
    return texts.select(
        "request_id",
        "ts",
        utc_day(utc_timestamp(df, "ts")).alias("day"),
        device.alias("device"),
        rq.detect_crawler(agent).alias("bot"),
        rq.client_ip(F.col("ip_address")).alias("ip_address"),
        rq.country(F.col("country")).alias("country"),
        rq.foreign_host(F.col("_host"), F.col("_own")).alias("referrer"),
    )


def usage_totals(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count("*").alias("global_count"),
        F.count("bot").alias("crawler_count"),
        F.count("referrer").alias("external_referrer_count"),
    )


def count_by(enriched: DataFrame, key: str) -> DataFrame:
    """Lifetime count per bot or referrer."""
    return enriched.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def device_totals(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("device").agg(
        F.count("*").alias("global_count"), F.count("bot").alias("crawler_count")
    )


def device_bots(enriched: DataFrame) -> DataFrame:
    return enriched.where(F.col("bot").isNotNull()).groupBy("device", "bot").agg(F.count("*").alias("n"))


def daily_facts(enriched: DataFrame, when: str = "day", pairs: bool = False) -> DataFrame:
    """One row per request and counted dimension; ``when`` is the day, or the event time on a stream.

    With ``pairs`` there is one more dimension, device and crawler together, for the lifetime counts.
    """
    is_crawler = F.col("bot").isNotNull()

    def fact(dimension: str, key: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dim"), key.alias("key"))

    both = F.when(is_crawler, F.concat_ws(" | ", "device", "bot"))
    extra = [fact(PAIRS, both)] if pairs else []
    facts = F.array(
        *extra,
        fact("global_count", F.lit("")),
        fact("crawler_count", F.when(is_crawler, "")),
        fact("sdk_devices", F.col("device")),
        fact("devices", F.when(is_crawler, F.col("device"))),
        fact("ip_addresses", F.col("ip_address")),
        fact("countries", F.col("country")),
        fact("external_referrers", F.col("referrer")),
        fact("bots", F.col("bot")),
    )
    return enriched.select(when, F.inline(facts)).where(F.col("key").isNotNull())


def usage_by_date(enriched: DataFrame) -> DataFrame:
    """Daily counters in long form (day, dim, key, n); counts are combined before the shuffle."""
    return daily_facts(enriched).groupBy("day", "dim", "key").agg(F.count("*").alias("n"))


def first_retained(today: str) -> str:
    """The first of the RETENTION_DAYS days that end with ``today``."""
    return (date.fromisoformat(today) - timedelta(days=RETENTION_DAYS - 1)).isoformat()


def retained(counters: DataFrame, today: str, day_col: str = "day") -> DataFrame:
    """Counters of the last RETENTION_DAYS days; a day that is no date is kept."""
    first = F.lit(first_retained(today)).cast("date")
    day = F.col(day_col).try_cast("date")
    return counters.where(day.isNull() | (day >= first))


def usage_entries(counters: DataFrame, today: str) -> DataFrame:
    """The retained counters in date order, every dimension in long form."""
    return retained(counters, today).where(F.col("dim") != PAIRS).orderBy("day", "dim", "key")


def usage_report(counters: DataFrame, today: str) -> DataFrame:
    """One row per retained day, oldest first, then one with the totals of those days, whose day is NULL.

    Crawlers and countries come as maps: there are ten crawler keys and at most 26 * 26 country codes.
    Devices, addresses and referrers have no such bound and stay in ``usage_entries``; here they are counted, in the totals
    each once.
    """
    kept = retained(counters, today).where(F.col("dim") != PAIRS)
    none = F.lit(None).cast(dict(kept.dtypes)["day"])
    days = kept.select(F.explode(F.array(F.struct("day"), F.struct(none.alias("day")))).alias("d"), "dim", "key", "n")
    summed = days.groupBy(F.col("d.day").alias("day"), "dim", "key").agg(F.sum("n").alias("n"))

    def total(dim: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("dim") == dim, F.col("n"))), F.lit(0)).alias(dim)

    def entries(dim: str) -> Column:
        held = F.collect_list(F.when(F.col("dim") == dim, F.struct("key", "n")))
        return F.map_from_entries(F.sort_array(held)).alias(dim)

    wide = [d for d in DIMENSIONS if d not in BOUNDED]
    return (
        summed.groupBy("day")
        .agg(
            total("global_count"),
            total("crawler_count"),
            *[F.count_if(F.col("dim") == d).alias(f"{d}_seen") for d in wide],
            *[entries(d) for d in BOUNDED],
        )
        .orderBy(F.col("day").asc_nulls_last())
    )


def lifetime_counts(counters: DataFrame) -> DataFrame:
    """Totals, crawlers, referrers and devices over all days (what, key, n), from daily counters with pairs."""
    what = F.create_map(*[F.lit(x) for pair in LIFETIME.items() for x in pair])[F.col("dim")]
    return (
        counters.where(F.col("dim").isin(*LIFETIME)).groupBy(what.alias("what"), "key").agg(F.sum("n").alias("n"))
    )


def merge_counters(*parts: DataFrame) -> DataFrame:
    """Add up counters of separate runs."""
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.groupBy("day", "dim", "key").agg(F.sum("n").alias("n"))


def upgrade_buckets(df: DataFrame) -> DataFrame:
    """Stored buckets of the old form: bad or missing numbers are 0, empty sdk_devices copies devices."""
    empty = F.create_map().cast("map<string,bigint>")
    maps = {d: F.coalesce(F.col(d), empty) if d in df.columns else empty for d in DIMENSIONS}
    numbers = {}
    for name in ("global_count", "crawler_count"):
        value = F.col(name).cast("string").try_cast("double") if name in df.columns else F.lit(None).cast("double")
        finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
        numbers[name] = F.coalesce(F.when(finite, value), F.lit(0.0))
    out = df.withColumns({**maps, **numbers})
    return out.withColumn("sdk_devices", F.when(F.size("sdk_devices") == 0, F.col("devices")).otherwise(F.col("sdk_devices")))
