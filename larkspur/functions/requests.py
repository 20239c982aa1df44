"""Request enrichment rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import URL_START, blank_if_null, collapse_space, trim, url_host

# Named crawlers, found by these words in this order, and the pattern for any other one.
KNOWN_CRAWLERS = (
    ("googlebot", "googlebot"),
    ("oai-searchbot", "oai-searchbot"),
    ("facebookexternalhit", "facebookexternalhit"),
    ("bingbot", "bingbot"),
    ("applebot", "applebot"),
    ("duckduckbot", "duckduckbot"),
    ("baiduspider", "baiduspider"),
    ("yandexbot", "yandex"),
)
SLURP = r"\bslurp\b"
OTHER_CRAWLER = "(bot|crawler|spider|slurp|archiver|fetcher|preview)"
SKIPPED_PATHS = ("/.netlify/", "/usage-dashboard")


def is_trackable(method: Column, url: Column, skipped: tuple[str, ...] = SKIPPED_PATHS) -> Column:
    """GET or HEAD on a valid URL whose path starts with none of ``skipped``."""
    kept = F.upper(method).isin("GET", "HEAD") & (url_host(url) != "")
    if skipped:
        paths = "|".join(p.replace(".", r"\.") for p in skipped)
        kept = kept & ~trim(url).rlike(f"{URL_START}(?:{paths})")
    return kept


def detect_crawler(user_agent: Column) -> Column:
    agent = F.lower(blank_if_null(user_agent))
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, word in KNOWN_CRAWLERS:
        found = found.when(F.contains(agent, F.lit(word)), key)
    return found.when(agent.rlike(SLURP), "slurp").when(agent.rlike(OTHER_CRAWLER), "other-crawler")


def _device_name(c: Column) -> Column:
    return F.substring(collapse_space(trim(blank_if_null(c))), 1, 120)


def platform_name(platform: Column) -> Column:
    """The client's own platform text without quotes."""
    return _device_name(F.replace(blank_if_null(platform), F.lit('"'), F.lit("")))


def bracket_name(user_agent: Column) -> Column:
    """The first bracketed text of the user agent."""
    return _device_name(F.regexp_extract(blank_if_null(user_agent), r"\(([^)]+)\)", 1))


def device_kind(user_agent: Column) -> Column:
    agent = F.lower(blank_if_null(user_agent))
    return (
        F.when(agent.rlike(r"\b(iphone|android.+mobile|mobile)\b"), "mobile")
        .when(agent.rlike(r"\b(ipad|tablet)\b"), "tablet")
        .when(agent.rlike(r"\b(macintosh|mac os x|windows nt|x11|linux)\b"), "desktop")
        .otherwise("unknown")
    )


def device(user_agent: Column, platform: Column) -> Column:
    named, bracket = platform_name(platform), bracket_name(user_agent)
    return (
        F.when(~named.isin("", "unknown"), named)
        .when(~bracket.isin("", "unknown"), bracket)
        .otherwise(device_kind(user_agent))
    )


def client_ip(*candidates: Column) -> Column:
    """First part of the first candidate that says anything; 'unknown' counts as nothing."""
    parts = [F.substring(trim(F.substring_index(blank_if_null(c), ",", 1)), 1, 96) for c in candidates]
    return F.coalesce(*[F.when(~p.isin("", "unknown"), p) for p in parts], F.lit("unknown"))


def country(*candidates: Column) -> Column:
    codes = [F.upper(trim(blank_if_null(c))) for c in candidates]
    return F.coalesce(*[F.when(code.rlike(r"^[A-Z]{2}\z"), code) for code in codes], F.lit("ZZ"))


def foreign_host(host: Column, own: Column) -> Column:
    """The host unless it is empty, the own host, or one of its sub-domains."""
    internal = (own != "") & ((host == own) | host.endswith(F.concat(F.lit("."), own)))
    return F.when((host != "") & ~internal, host)


def external_referrer(referer: Column, url: Column) -> Column:
    return foreign_host(url_host(referer), url_host(url))
