"""Queries over requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import requests as rq
from larkspur.functions import text as tx
from larkspur.operators import usage as us
from larkspur.plans import sqltext as q
from larkspur.plans.catalog import query
from larkspur.plans.views import view

TODAY = "2024-01-31"

_OWN, _REF = q.url_host("url"), q.url_host("referer")
_PATH = q.url_path("url")
_TRACKED = (
    f"upper(method) IN ('GET', 'HEAD') AND {_OWN} <> '' AND NOT starts_with({_PATH}, '/.netlify/') "
    f"AND NOT starts_with({_PATH}, '/usage-dashboard')"
)
_IP = f"CASE WHEN {q.trim('''split_part(ip_address, ',', 1)''')} = '' THEN 'unknown' ELSE substr({q.trim('''split_part(ip_address, ',', 1)''')}, 1, 96) END"
_COUNTRY = f"CASE WHEN regexp_matches(upper({q.trim('country')}), '^[A-Z][A-Z]\\z') THEN upper({q.trim('country')}) ELSE 'ZZ' END"
_REFERRER = f"CASE WHEN {_REF} <> '' AND NOT ({_OWN} <> '' AND ({_REF} = {_OWN} OR ends_with({_REF}, concat('.', {_OWN})))) THEN {_REF} END"
_DEVICE = q.device("user_agent", "sec_ch_ua_platform")

TRACKED = f"tracked AS (SELECT * FROM requests WHERE {_TRACKED})"
ENRICHED = f"""enriched AS (SELECT request_id, ts, CAST(ts AS DATE) AS day, {_DEVICE} AS device, {q.crawler('user_agent')} AS bot,
  {_IP} AS ip_address, {_COUNTRY} AS country, {_REFERRER} AS referrer FROM tracked)"""


def over_requests(body: str, *extra: str) -> str:
    return q.with_ctes(["requests"], body, TRACKED, ENRICHED, *extra)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "requests")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.enrich_requests(us.trackable(requests(spark, sf_dir)))


@query(
    "s12_request_ingest",
    q.with_ctes(
        ["requests"],
        f"""SELECT request_id, {q.trim('url')} AS url, CASE WHEN upper(method) = 'HEAD' THEN 'HEAD' ELSE 'GET' END AS method
        FROM requests WHERE {_OWN} <> ''""",
    ),
)
def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.ingest_requests(requests(spark, sf_dir)).select("request_id", "url", "method")


@query("r1_trackable", q.with_ctes(["requests"], "SELECT request_id, method, url FROM tracked", TRACKED))
def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.trackable(requests(spark, sf_dir)).select("request_id", "method", "url")


def _rule(name: str, out: str, rule, sql: str) -> None:
    @query(name, q.with_ctes(["requests"], f"SELECT request_id, {sql} AS {out} FROM requests"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return requests(spark, sf_dir).select("request_id", rule().alias(out))


_rule("r2_detect_crawler", "bot", lambda: rq.detect_crawler(F.col("user_agent")), q.crawler("user_agent"))
_rule("r3_device", "device", lambda: rq.device(F.col("user_agent"), F.col("sec_ch_ua_platform")), _DEVICE)
_rule("r4_client_ip", "ip", lambda: rq.client_ip(F.col("ip_address")), _IP)
_rule("r5_country", "code", lambda: rq.country(F.col("country")), _COUNTRY)
_rule("r6_external_referrer", "referrer", lambda: rq.external_referrer(F.col("referer"), F.col("url")), _REFERRER)


@query(
    "r6_page_referrer",
    q.with_ctes(["job_pages_html"], f"SELECT page_id, {q.url_host('url')} AS host, {q.url_path('url')} AS path FROM job_pages_html"),
)
def page_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "job_pages_html")
    return pages.select("page_id", tx.url_host(F.col("url")).alias("host"), tx.url_path(F.col("url")).alias("path"))


@query("r0_enrich_requests", over_requests("SELECT * FROM enriched"))
def enriched_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir)


@query(
    "a3_usage_totals",
    over_requests("SELECT count(*) AS global_count, count(bot) AS crawler_count, count(referrer) AS external_referrer_count FROM enriched"),
)
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.usage_totals(enriched(spark, sf_dir))


@query("a4_bots", over_requests("SELECT bot, count(*) AS n FROM enriched WHERE bot IS NOT NULL GROUP BY bot"))
def bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.count_by(enriched(spark, sf_dir), "bot")


@query("a5_devices", over_requests("SELECT device, count(*) AS global_count, count(bot) AS crawler_count FROM enriched GROUP BY device"))
def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.device_totals(enriched(spark, sf_dir))


@query("a5_device_bots", over_requests("SELECT device, bot, count(*) AS n FROM enriched WHERE bot IS NOT NULL GROUP BY device, bot"))
def device_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.device_bots(enriched(spark, sf_dir))


@query("a6_external_referrers", over_requests("SELECT referrer, count(*) AS n FROM enriched WHERE referrer IS NOT NULL GROUP BY referrer"))
def referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.count_by(enriched(spark, sf_dir), "referrer")


_FACTS = """facts AS (
  SELECT day, 'global_count' AS dim, '' AS key FROM enriched
  UNION ALL SELECT day, 'crawler_count', '' FROM enriched WHERE bot IS NOT NULL
  UNION ALL SELECT day, 'sdk_devices', device FROM enriched
  UNION ALL SELECT day, 'devices', device FROM enriched WHERE bot IS NOT NULL
  UNION ALL SELECT day, 'ip_addresses', ip_address FROM enriched
  UNION ALL SELECT day, 'countries', country FROM enriched
  UNION ALL SELECT day, 'external_referrers', referrer FROM enriched WHERE referrer IS NOT NULL
  UNION ALL SELECT day, 'bots', bot FROM enriched WHERE bot IS NOT NULL)"""
COUNTERS = "counters AS (SELECT day, dim, key, count(*) AS n FROM facts GROUP BY day, dim, key)"
USAGE_BY_DATE = over_requests("SELECT day, dim, key, n FROM counters", _FACTS, COUNTERS)


@query("a7_usage_by_date", USAGE_BY_DATE)
def by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.usage_by_date(enriched(spark, sf_dir))


_MAP_TEXT = "coalesce(string_agg(concat(key, '=', CAST(n AS VARCHAR)), '|' ORDER BY key) FILTER (WHERE dim = '{d}'), '')"


_WIDE = [d for d in us.DIMENSIONS if d not in us.BOUNDED]


@query(
    "a8_usage_report",
    over_requests(
        "SELECT day, coalesce(max(n) FILTER (WHERE dim = 'global_count'), 0) AS global_count, "
        "coalesce(max(n) FILTER (WHERE dim = 'crawler_count'), 0) AS crawler_count, "
        + ", ".join(f"count(*) FILTER (WHERE dim = '{d}') AS {d}_seen" for d in _WIDE)
        + ", "
        + ", ".join(f"{_MAP_TEXT.format(d=d)} AS {d}" for d in us.BOUNDED)
        + " FROM with_totals GROUP BY day",
        _FACTS, COUNTERS,
        f"""retained AS (SELECT * FROM counters WHERE day >= DATE '{TODAY}' - 29),
        with_totals AS (SELECT day, dim, key, n FROM retained
          UNION ALL SELECT NULL, dim, key, CAST(sum(n) AS BIGINT) FROM retained GROUP BY dim, key)""",
    ),
)
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = us.usage_report(us.usage_by_date(enriched(spark, sf_dir)), TODAY)

    def as_text(name: str):
        pairs = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        return F.array_join(pairs, "|")

    return made.withColumns({d: as_text(d) for d in us.BOUNDED})


@query("a8_usage_entries", over_requests(f"SELECT day, dim, key, n FROM counters WHERE day >= DATE '{TODAY}' - 29", _FACTS, COUNTERS))
def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.usage_entries(us.usage_by_date(enriched(spark, sf_dir)), TODAY)


@query("f7_retention", over_requests(f"SELECT day, dim, key, n FROM counters WHERE day >= DATE '{TODAY}' - 29", _FACTS, COUNTERS))
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.retained(us.usage_by_date(enriched(spark, sf_dir)), TODAY)


@query(
    "n18_upgrade_buckets",
    over_requests(
        """SELECT day, CAST(count(*) AS DOUBLE) AS global_count, CAST(0 AS DOUBLE) AS crawler_count,
        count(DISTINCT country) AS devices, count(DISTINCT country) AS sdk_devices FROM enriched GROUP BY day"""
    ),
)
def upgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Daily buckets as an older version stored them: text numbers, no crawler count, a devices map only.
    # The map is filled with country codes, whose number is bounded.
    rows = enriched(spark, sf_dir).groupBy("day", "country").agg(F.count("*").alias("n"))
    old = rows.groupBy("day").agg(
        F.sum("n").cast("string").alias("global_count"),
        F.map_from_entries(F.collect_list(F.struct("country", "n"))).alias("devices"),
    )
    sizes = [F.size(d).cast("long").alias(d) for d in ("devices", "sdk_devices")]
    return us.upgrade_buckets(old).select("day", "global_count", "crawler_count", *sizes)
