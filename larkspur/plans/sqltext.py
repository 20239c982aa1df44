"""SQL texts of the scalar rules, for the SQL counterparts."""

from __future__ import annotations

from larkspur.functions import text as tx
from larkspur.functions.requests import KNOWN_CRAWLERS, OTHER_CRAWLER, SLURP
from larkspur.operators.companies import INDUSTRY_PATTERNS, OTHER_INDUSTRY
from larkspur.plans.views import view_sql

WS = f"[{tx.SPACE}]"
WS_CHARS = "concat(" + ", ".join(f"chr({ord(ch)})" for ch in tx.SPACE_CHARS) + ")"


def trim(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace({collapse(x)}, '(?i)^nan\\z', ''))"


def clean_location(x: str) -> str:
    a = f"regexp_replace({clean(x)}, '(?i)^Location: *', '')"
    return f"regexp_replace({a}, '(?i), *US,? *[0-9]*\\z', ', United States')"


def split_tags(x: str) -> str:
    marked = f"regexp_replace({clean(x)}, ', ([A-Z0-9])', ';\\1', 'g')"
    return f"list_filter(list_transform(string_split({marked}, ';'), lambda v: trim(v)), lambda v: v <> '')[1:10]"


def city_key(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower({x}), 'los angeles|lynwood|inglewood|lax|santa monica|burbank|pasadena') THEN 'Los Angeles' "
        f"WHEN regexp_matches(lower({x}), 'new york|brooklyn|queens|manhattan') THEN 'New York' "
        f"WHEN regexp_matches(lower({x}), 'san francisco|oakland|san jose|palo alto|redwood|mountain view') THEN 'Bay Area' "
        f"WHEN regexp_matches(lower({x}), 'chicago') THEN 'Chicago' "
        f"WHEN regexp_matches(lower({x}), 'austin') THEN 'Austin' ELSE 'United States' END"
    )


def pay_max(x: str) -> str:
    return (
        f"coalesce(list_max(list_transform(regexp_extract_all({x}, '(?i)[0-9]+(?:\\.[0-9]+)?k?'), "
        "lambda v: CAST(regexp_replace(lower(v), 'k', '') AS DOUBLE) * CASE WHEN lower(v) LIKE '%k' THEN 1000 ELSE 1 END)), 0)"
    )


def to_number(x: str) -> str:
    return f"CASE WHEN {trim(x)} = '' THEN 0.0 ELSE coalesce(TRY_CAST({x} AS DOUBLE), CAST('NaN' AS DOUBLE)) END"


def freshness(x: str) -> str:
    return f"coalesce(epoch_ms(CAST(TRY_CAST({x} AS DATE) AS TIMESTAMP)), 0)"


def slug(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-')"


def domain_guess(x: str, words: tuple[str, ...]) -> str:
    stop = "|".join(words)
    return (
        f"concat(regexp_replace(regexp_replace(replace(lower({x}), '&', 'and'), '\\b({stop})\\b', '', 'g'), "
        "'[^a-z0-9]', '', 'g'), '.com')"
    )


def url_host(x: str) -> str:
    # Written apart from the engine's pattern: the given URLs are absolute, without user, port or brackets.
    return f"split_part(split_part(split_part(split_part(lower({trim(x)}), '://', 2), '/', 1), '?', 1), '#', 1)"


def url_path(x: str) -> str:
    rest = f"split_part(split_part(split_part({trim(x)}, '://', 2), '?', 1), '#', 1)"
    return f"CASE WHEN contains({rest}, '/') THEN substr({rest}, strpos({rest}, '/')) ELSE '' END"


def host_of_url(x: str) -> str:
    return f"regexp_replace({url_host(x)}, '^www\\.', '')"


def infer_industry(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({x}), '{p}') THEN '{v}'" for p, v in INDUSTRY_PATTERNS)
    return f"CASE {whens} ELSE '{OTHER_INDUSTRY}' END"


def crawler(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN '{k}'" for k, p in (*KNOWN_CRAWLERS, ("slurp", SLURP)))
    return f"CASE {whens} WHEN regexp_matches({x}, '(?i){OTHER_CRAWLER}') THEN 'other-crawler' END"


def device(agent: str, platform: str) -> str:
    named = f"substr({collapse(trim(f'''replace({platform}, '\"', '')'''))}, 1, 120)"
    bracket = f"substr({collapse(trim(f'''regexp_extract({agent}, '\\(([^)]+)\\)', 1)'''))}, 1, 120)"
    return (
        f"CASE WHEN {named} NOT IN ('', 'unknown') THEN {named} WHEN {bracket} NOT IN ('', 'unknown') THEN {bracket} "
        f"WHEN regexp_matches(lower({agent}), '\\b(iphone|android.+mobile|mobile)\\b') THEN 'mobile' "
        f"WHEN regexp_matches(lower({agent}), '\\b(ipad|tablet)\\b') THEN 'tablet' "
        f"WHEN regexp_matches(lower({agent}), '\\b(macintosh|mac os x|windows nt|x11|linux)\\b') THEN 'desktop' "
        "ELSE 'unknown' END"
    )


def with_ctes(names: list[str], body: str, *extra: str) -> str:
    """A query over input views, further common table expressions and a final SELECT."""
    parts = [view_sql(n) for n in names] + list(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body


MAPPED = """mapped AS (SELECT ordinal, id, job_title, company_name, job_location, job_seniority_level, job_employment_type,
  coalesce(nullif(job_industries, ''), industries) AS job_industries,
  coalesce(nullif(industries, ''), job_industries) AS industries, job_summary, job_base_pay_range, job_posted_date,
  competitiveness_score, skills, certifications, achievements, url, apply_link, country_code, ingest_utc_date
  FROM listings_raw)"""

DEDUPED = """deduped AS (SELECT * FROM mapped QUALIFY row_number() OVER (
  PARTITION BY CASE WHEN trim(id) <> '' THEN id ELSE concat_ws('|', job_title, company_name, job_location) END
  ORDER BY ordinal) = 1)"""

LISTINGS = f"""listings AS (SELECT ordinal,
  CASE WHEN id <> '' THEN id ELSE concat('job-', CAST(row_number() OVER (ORDER BY ordinal) - 1 AS VARCHAR)) END AS id,
  {clean('job_title')} AS title, {clean('company_name')} AS company, {clean_location('job_location')} AS location,
  {clean('job_seniority_level')} AS seniority, {clean('job_employment_type')} AS employment,
  {split_tags("coalesce(nullif(industries, ''), job_industries)")} AS industries, {clean('job_summary')} AS summary,
  {clean('job_base_pay_range')} AS pay, coalesce(nullif(job_posted_date, ''), ingest_utc_date) AS posted,
  {to_number('competitiveness_score')} AS score, {split_tags('skills')} AS skills,
  {split_tags('certifications')} AS certifications, {split_tags('achievements')} AS achievements, url,
  coalesce(nullif(apply_link, ''), url) AS apply, coalesce(nullif(country_code, ''), 'US') AS country,
  {city_key(clean_location('job_location'))} AS city_key
  FROM deduped WHERE job_title <> '' AND company_name <> '')"""

FRESH = freshness("posted")
LISTING_CTES = (MAPPED, DEDUPED, LISTINGS)


def over_listings(body: str, *extra: str, views: tuple[str, ...] = ()) -> str:
    return with_ctes(["listings_raw", *views], body, *LISTING_CTES, *extra)
