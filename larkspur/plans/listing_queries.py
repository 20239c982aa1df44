"""Queries over listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import companies as co
from larkspur.operators import insights as ins
from larkspur.operators import listings as ls
from larkspur.operators.numbering import with_position
from larkspur.operators.state import job_state, jobs_of
from larkspur.plans import sqltext as q
from larkspur.plans.catalog import query
from larkspur.plans.views import view
from larkspur.session import run_dir, stored
from larkspur.sources.listings import first_available, land_listings_csv, payload_listings, read_listings_json, read_payloads
from larkspur.sources.shards import build_shards, read_page, read_shards, shard_keys, shard_pagination
from larkspur.sources.snapshots import SNAPSHOT_ROWS, add_snapshot, normalized_listings, snapshot_store
from larkspur.sources.textindex import search_indexed, write_indexed

RAW_COLUMNS = ", ".join(ls.ALIASES)


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.map_aliases(view(spark, sf_dir, "listings_raw"))


def listings(spark: SparkSession, sf_dir: str, with_id: bool = True) -> DataFrame:
    rows = mapped(spark, sf_dir)
    return ls.normalize_snapshot(rows) if with_id else ls.normalize_listings(ls.dedupe_listings(rows), False)


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text and NaN as -1, for comparison."""
    arrays = [c for c, t in df.dtypes if t.startswith("array")]
    out = df.withColumns({c: F.array_join(c, "|") for c in arrays})
    return out.withColumn("score", F.nanvl("score", F.lit(-1.0))) if "score" in out.columns else out


FLAT_LISTING = """ordinal, id, title, company, location, seniority, employment, array_to_string(industries, '|') AS industries,
  summary, pay, posted, CASE WHEN isnan(score) THEN -1.0 ELSE score END AS score, array_to_string(skills, '|') AS skills,
  array_to_string(certifications, '|') AS certifications, array_to_string(achievements, '|') AS achievements,
  url, apply, country, city_key"""

# One rail query: the first 18 overall, then 18 per city without those.
_RAILS = """ranked AS (SELECT *, row_number() OVER (ORDER BY {order}, ordinal) AS overall FROM {source}),
railed AS (SELECT *, CASE WHEN overall <= 18 THEN 'United States' ELSE city_key END AS r FROM ranked
  WHERE overall <= 18 OR city_key <> 'United States'),
placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY overall) AS rail_position FROM railed)"""
_RAIL_OUT = """SELECT concat('Latest Jobs in ', r) AS rail, rail_position, id, title, company, location, posted, city_key
FROM placed WHERE rail_position <= 18"""


def rail_columns(df: DataFrame) -> DataFrame:
    return df.select("rail", "rail_position", "id", "title", "company", "location", "posted", "city_key")


@query(
    "l1_listing_search",
    q.over_listings(
        _RAIL_OUT,
        "found AS (SELECT * FROM listings WHERE contains(lower(concat_ws(' ', title, company, location, summary, pay, seniority, employment, "
        "array_to_string(industries, ' '), array_to_string(skills, ' '), array_to_string(certifications, ' '), array_to_string(achievements, ' '))), 'machinery'))",
        _RAILS.format(order=f"{q.FRESH} DESC", source="found"),
    ),
)
def listing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ls.search_listings(listings(spark, sf_dir), query=" Machinery ")
    return rail_columns(ls.rails(found))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "listings_raw")


# --- sources -------------------------------------------------------------------------------------

_TRIMMED = ", ".join(f"{q.trim(c)} AS {c}" for c in ls.ALIASES)


#: Rows of one CSV file and blocks of one payload file, about. A file is read and written by one task, so with more data there are more files.
CSV_ROWS, PAYLOAD_BLOCKS = 100_000, 128


def in_files(df: DataFrame, path: str, file_rows: int = CSV_ROWS, **options) -> str:
    """Write rows in order of ``ordinal`` to six files or more of unequal size, later ones larger."""
    files = max(6, -(-df.count() // file_rows))
    part = F.least(F.lit(5), F.floor(F.log2(F.col("ordinal") / 100.0 + 1)).cast("int"))
    ordered = df.repartitionByRange(files, part, "ordinal").sortWithinPartitions("ordinal")
    ordered.drop("ordinal").write.csv(path, header=True, quote='"', escape='"', emptyValue="", **options)
    return path


_PLACED = "placed AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS place FROM listings_raw)"


@query("s1_csv_snapshot_scan", q.with_ctes(["listings_raw"], f"SELECT {_TRIMMED}, place FROM placed", _PLACED))
def csv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = in_files(raw(spark, sf_dir), run_dir(spark, "csv"))
    landed = land_listings_csv(spark, path, run_dir(spark, "landed"))
    return with_position(landed, "ordinal", "place").drop("ordinal").withColumn("place", F.col("place") + 1)


@query(
    "s2_json_payload_scan",
    q.with_ctes(
        ["listings_raw"],
        f"SELECT ordinal, {RAW_COLUMNS} FROM mapped WHERE CAST(floor(ordinal / 500) AS BIGINT) % 4 < 3",
        q.MAPPED,
    ),
)
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Payloads of one block of 500 order keys each, in the three known shapes and one unknown one.
    rows = raw(spark, sf_dir).withColumn("page", F.floor(F.col("ordinal") / 500).cast("long"))
    packed = rows.groupBy("page").agg(F.to_json(F.collect_list(F.struct("ordinal", *ls.ALIASES))).alias("rows"))
    shape = F.col("page") % 4
    payload = (
        F.when(shape == 0, F.col("rows"))
        .when(shape == 1, F.concat(F.lit('{"jobs":'), "rows", F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"data":'), "rows", F.lit("}")))
        .otherwise(F.concat(F.lit('{"error":'), "rows", F.lit("}")))
    )
    found = read_payloads(packed.select(payload.alias("payload")))
    ordinal = F.col("row")["ordinal"].cast("long")
    return ls.map_aliases(payload_listings(found.withColumn("ordinal", ordinal).drop("place")))


def in_payloads(packed: DataFrame, path: str, file_blocks: int = PAYLOAD_BLOCKS) -> str:
    """Write payloads (page, value) in order of ``page`` to six files or more of unequal size, one on each line."""
    files = max(6, -(-packed.select("page").count() // file_blocks))
    part = F.floor(F.log2(F.col("page") + 1)).cast("int")
    packed.repartitionByRange(files, part, "page").sortWithinPartitions("page").select("value").write.text(path)
    return path


@query("s2_json_to_listings", q.over_listings("SELECT ordinal, id, title, company FROM numbered", "numbered AS (SELECT * REPLACE (row_number() OVER (ORDER BY ordinal) AS ordinal) FROM listings)"))
def json_to_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload files of unequal size, from the scan to normalised listings."""
    path = run_dir(spark, "payloads")
    rows = raw(spark, sf_dir).withColumn("page", F.floor(F.col("ordinal") / 500).cast("long"))
    packed = rows.groupBy("page").agg(F.to_json(F.sort_array(F.collect_list(F.struct("ordinal", *ls.ALIASES)))).alias("value"))
    in_payloads(packed, path)
    made = ls.normalize_snapshot(stored(ls.map_aliases(read_listings_json(spark, path)), "mapped"))
    return with_position(made, "ordinal", "place").select((F.col("place") + 1).alias("ordinal"), "id", "title", "company")


@query("s3_map_aliases", q.with_ctes(["listings_raw"], "SELECT * FROM mapped", q.MAPPED))
def alias_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = raw(spark, sf_dir).withColumnsRenamed(
        {
            "job_title": "title", "company_name": "company", "job_location": "location",
            "job_seniority_level": "seniority", "job_employment_type": "employment_type", "job_summary": "summary",
            "job_base_pay_range": "pay_range", "job_posted_date": "posted_date", "competitiveness_score": "score",
            "apply_link": "apply_url",
        }
    )
    return ls.map_aliases(renamed)


_US = "us_rows AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS pos FROM mapped WHERE country_code = '' OR upper(country_code) = 'US')"


@query(
    "s4_union_pages",
    q.with_ctes(
        ["listings_raw"],
        f"SELECT ordinal, {RAW_COLUMNS} FROM firsts ORDER BY ordinal LIMIT 2000",
        q.MAPPED,
        _US,
        "paged AS (SELECT * FROM us_rows WHERE pos < 2000)",
        "firsts AS (SELECT * FROM paged QUALIFY row_number() OVER (PARTITION BY CASE WHEN trim(id) <> '' THEN id "
        "ELSE concat_ws('|', job_title, company_name, job_location) END ORDER BY ordinal) = 1)",
    ),
)
def union_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_position(ls.filter_country(mapped(spark, sf_dir), "US"), "ordinal")
    paged = rows.withColumn("page", F.floor(F.col("position") / 500).cast("long")).drop("position")
    return ls.union_pages(paged, "page")


@query(
    "s5_first_available",
    q.with_ctes(["listings_raw"], f"SELECT ordinal, {RAW_COLUMNS} FROM deduped ORDER BY ordinal LIMIT 4000", q.MAPPED, q.DEDUPED),
)
def preferred_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The order of the rows decides which of two alike is kept and where the cap cuts.
    bundled = run_dir(spark, "bundled")
    raw(spark, sf_dir).write.parquet(bundled)
    path = first_available(spark, [f"{bundled}-remote", bundled])
    rows = ls.dedupe_listings(ls.map_aliases(spark.read.parquet(path)))
    return ls.first_rows(rows)


_SHARDED = f"""sharded AS (SELECT ordinal, {RAW_COLUMNS}, CAST(floor(pos / 500) AS BIGINT) AS shard_index FROM us_rows)"""
_URL = "https://data.example/listings.csv"


@query("s6_build_shards", q.with_ctes(["listings_raw"], f"SELECT ordinal, {RAW_COLUMNS}, shard_index FROM sharded", q.MAPPED, _US, _SHARDED))
def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "shards")
    build_shards(spark, mapped(spark, sf_dir), path, _URL, "2026-05-01T00:00:00Z")
    return read_shards(spark, path, _URL)


@query(
    "s6_shard_meta",
    q.with_ctes(
        ["listings_raw"],
        f"""SELECT '{_URL}' AS csv_url, substr(sha256('{_URL}'), 1, 24) AS source_hash, 'US' AS country_code,
        CAST(500 AS BIGINT) AS rows_per_shard, count(*) AS total_filtered_rows, max(shard_index) + 1 AS shard_count,
        '2026-05-01T00:00:00Z' AS built_at FROM sharded""",
        q.MAPPED, _US, _SHARDED,
    ),
)
def shard_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_shards(spark, mapped(spark, sf_dir), run_dir(spark, "shards"), _URL, "2026-05-01T00:00:00Z").drop("build")


_CA = "ca_rows AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS pos FROM mapped WHERE country_code = '' OR upper(country_code) = 'CA')"


@query("s6_rebuilt_shards", q.with_ctes(["listings_raw"], f"SELECT ordinal, {RAW_COLUMNS}, shard_index FROM sharded", q.MAPPED, _US, _SHARDED))
def rebuilt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build with other titles in a seventh of the rows, then one of the true rows: files without such rows are taken over."""
    path, rows = run_dir(spark, "shards"), mapped(spark, sf_dir)
    other = F.when(F.col("ordinal") % 7 == 0, "other").otherwise(F.col("job_title"))
    build_shards(spark, rows.withColumn("job_title", other), path, _URL, "2026-05-01T00:00:00Z")
    build_shards(spark, rows, path, _URL, "2026-05-02T00:00:00Z")
    return read_shards(spark, path, _URL)


@query(
    "s7_read_shard_page",
    q.with_ctes(
        ["listings_raw"],
        f"""SELECT 'US' AS page_of, ordinal, {RAW_COLUMNS}, shard_index FROM sharded WHERE shard_index = 2
        UNION ALL SELECT 'CA', ordinal, {RAW_COLUMNS}, CAST(floor(pos / 100) AS BIGINT) FROM ca_rows WHERE floor(pos / 100) = 1
        UNION ALL SELECT 'live', ordinal, {RAW_COLUMNS}, NULL FROM us_rows WHERE floor(pos / 40) = 1""",
        q.MAPPED, _US, _SHARDED, _CA,
    ),
)
def shard_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two countries under one root, after a rebuild, and of a source without a build."""
    path, rows, when = run_dir(spark, "shards"), mapped(spark, sf_dir), "2026-05-01T00:00:00Z"
    build_shards(spark, rows, path, _URL, when, rows_per_shard=50)
    build_shards(spark, rows, path, _URL, when, "ca", 100)
    build_shards(spark, rows, path, _URL, when)
    us, ca = read_page(spark, path, _URL, 3, country=" us "), read_page(spark, path, _URL, 2, country="CA")
    live = read_page(spark, path, f"{_URL}?other", 2, rows, per_page=40).withColumn("shard_index", F.lit(None).cast("long"))
    beyond = read_page(spark, path, _URL, 10_000_000)
    pages = [("US", us), ("CA", ca), ("live", live), ("US", beyond)]
    return reduce(DataFrame.unionByName, [p.withColumn("page_of", F.lit(of)) for of, p in pages])


@query(
    "s8_shard_keys",
    q.with_ctes(
        ["listings_raw"],
        """SELECT ordinal, concat('meta:', substr(sha256(url), 1, 24), ':', upper(country_code)) AS meta_key,
        concat('shard:', substr(sha256(url), 1, 24), ':', upper(country_code), ':', CAST(ordinal % 7 AS VARCHAR)) AS shard_key
        FROM listings_raw""",
    ),
)
def keys_of_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta, shard = shard_keys(F.col("url"), F.col("country_code"), F.col("ordinal") % 7)
    return raw(spark, sf_dir).select("ordinal", meta.alias("meta_key"), shard.alias("shard_key"))


# --- scalar rules --------------------------------------------------------------------------------


def scalar(name: str, source: str, key: str, rules: dict[str, tuple]) -> None:
    """Register scalar rules over one view: output name -> (Spark rule, SQL text)."""
    body = f"SELECT {key}, " + ", ".join(f"{sql} AS {out}" for out, (_, sql) in rules.items()) + f" FROM {source}"

    @query(name, q.with_ctes([source], body))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, source).select(key, *[rule().alias(out) for out, (rule, _) in rules.items()])


scalar("n2_clean", "listings_raw", "ordinal", {
    "title": (lambda: tx.clean(F.col("job_title")), q.clean("job_title")),
    "place": (lambda: tx.clean(F.col("job_location")), q.clean("job_location")),
})
scalar("n2_clean_documents", "resumes", "doc_id", {"cleaned": (lambda: tx.clean(F.col("text")), q.clean("text"))})
scalar("n3_clean_location", "listings_raw", "ordinal", {
    "location": (lambda: tx.clean_location(F.col("job_location")), q.clean_location("job_location")),
})
scalar("n4_split_tags", "listings_raw", "ordinal", {
    "tags": (lambda: F.array_join(tx.split_tags(F.col("industries")), "|"), f"array_to_string({q.split_tags('industries')}, '|')"),
})
scalar("n5_city_key", "listings_raw", "ordinal", {
    "city": (lambda: tx.city_key(F.col("job_location")), q.city_key("job_location")),
})
scalar("n6_pay_max", "listings_raw", "ordinal", {
    "pay": (lambda: tx.pay_max(F.col("job_base_pay_range")), q.pay_max("job_base_pay_range")),
    "pay_with_commas": (
        lambda: tx.pay_max(F.col("job_base_pay_range"), commas=True),
        q.pay_max("regexp_replace(job_base_pay_range, '([0-9]),([0-9][0-9][0-9])', '\\1\\2', 'g')"),
    ),
})
scalar("n7_freshness", "listings_raw", "ordinal", {
    "fresh_ms": (lambda: tx.freshness(F.col("job_posted_date")), q.freshness("job_posted_date")),
})
_FORMS = ("yyyy-MM-dd", "d MMM yyyy", "EEE, dd MMM yyyy 10:00:00 'GMT'", "yyyy/MM/dd", "MMM d, yyyy 10:00", "MMMM d yyyy", "M/d/yyyy", "d MMM yyyy 9:30 'PM'", "EEE MMM dd yyyy 10:00:00 'GMT-0500'")
_FORM_HOURS = (0, 0, 10, 0, 10, 0, 0, 21.5, 15)


@query(
    "n7_date_forms",
    q.with_ctes(
        ["listings_raw"],
        f"""SELECT ordinal, CAST(epoch_ms(CAST(try_cast(job_posted_date AS DATE) AS TIMESTAMP)) AS BIGINT)
        + CAST({list(_FORM_HOURS)}[CAST(ordinal % {len(_FORM_HOURS)} AS INTEGER) + 1] * 3600000 AS BIGINT) AS posted_ms FROM listings_raw""",
    ),
)
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posting date written in one of several forms, and read again."""
    day = F.col("job_posted_date").try_cast("date")
    shown = F.element_at(F.array(*[F.date_format(day, form) for form in _FORMS]), (F.col("ordinal") % len(_FORMS) + 1).cast("int"))
    return raw(spark, sf_dir).select("ordinal", tx.date_millis(shown).alias("posted_ms"))


scalar("n9_company_slug", "listings_raw", "ordinal", {
    "slug": (lambda: tx.slug(F.col("company_name")), q.slug("company_name")),
    "industry_slug": (lambda: tx.slug(F.col("industries")), q.slug("industries")),
})
scalar("n10_domain_guess", "listings_raw", "ordinal", {
    "listing_domain": (
        lambda: tx.domain_guess(F.concat_ws(" ", "company_name", "job_summary", F.lit("& the Group llc Insurance"))),
        q.domain_guess("concat_ws(' ', company_name, job_summary, '& the Group llc Insurance')", tx.LISTING_STOP_WORDS),
    ),
    "registry_domain": (
        lambda: tx.domain_guess(F.concat_ws(" ", "company_name", F.lit("& the Group llc Insurance")), tx.REGISTRY_STOP_WORDS),
        q.domain_guess("concat_ws(' ', company_name, '& the Group llc Insurance')", tx.REGISTRY_STOP_WORDS),
    ),
})
scalar("n11_host_of_url", "listings_raw", "ordinal", {"host": (lambda: tx.host_of_url(F.col("url")), q.host_of_url("url"))})
scalar("n11_host_of_page", "job_pages_html", "page_id", {"host": (lambda: tx.host_of_url(F.col("url")), q.host_of_url("url"))})

_NOW = 893980800000  # 1998-05-01 00:00 UTC, inside the order dates


@query(
    "n8_job_card",
    q.over_listings(
        f"""SELECT ordinal, id,
        CASE WHEN ms = 0 THEN '5h' WHEN hours < 24 THEN concat(CAST(hours AS VARCHAR), 'h') WHEN days < 30 THEN concat(CAST(days AS VARCHAR), 'd')
          ELSE concat(CAST(CAST(floor(days / 30.0 + 0.5) AS BIGINT) AS VARCHAR), 'mo') END AS age,
        CASE WHEN length(sent) > 120 THEN concat(trim(substr(sent, 1, 119)), '…') ELSE sent END AS sentence,
        CASE WHEN length(summary) > 260 THEN concat(trim(substr(summary, 1, 259)), '…') ELSE summary END AS snippet,
        short_pay,
        upper(array_to_string(list_transform(list_filter(string_split(company, ' '), lambda w: w <> '')[1:2], lambda w: w[1:1]), '')) AS initials,
        array_to_string(list_filter([location, CASE WHEN pay <> '' THEN short_pay ELSE '' END,
          CASE WHEN employment = '' THEN 'Full Time' ELSE employment END, seniority,
          coalesce(CASE WHEN length(achievements[1]) > 14 THEN concat(substr(achievements[1], 1, 14), '…') ELSE achievements[1] END, ''),
          coalesce(certifications[1], ''), coalesce(industries[1], '')], lambda v: v <> ''), '|') AS tags,
        array_to_string(list_concat(skills[1:4], certifications[1:2]), ', ') AS skill_text
        FROM staged""",
        f"""aged AS (SELECT *, {q.FRESH} AS ms, greatest(1, CAST(floor(({_NOW} - {q.FRESH}) / 3600000.0 + 0.5) AS BIGINT)) AS hours,
          substr(regexp_replace(regexp_replace(pay, '(?i)per hour', '/hr', 'g'), '(?i)hourly', '/hr', 'g'), 1, 28) AS short_pay,
          CASE WHEN regexp_extract(summary, '^(.{{20,}}?[.!?](?: |\\z))', 1) <> '' THEN trim(regexp_extract(summary, '^(.{{20,}}?[.!?](?: |\\z))', 1))
            ELSE summary END AS sent FROM listings)""",
        "staged AS (SELECT *, CAST(floor(hours / 24.0 + 0.5) AS BIGINT) AS days FROM aged)",
    ),
)
def job_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(ls.job_cards(listings(spark, sf_dir), _NOW))


# --- listings ------------------------------------------------------------------------------------


@query("a1_dedupe_listings", q.with_ctes(["listings_raw"], "SELECT * FROM deduped", q.MAPPED, q.DEDUPED))
def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.dedupe_listings(mapped(spark, sf_dir))


@query("n1_normalize_listings", q.over_listings(f"SELECT {FLAT_LISTING} FROM listings"))
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(listings(spark, sf_dir))


@query(
    "w2_dense_ordinal",
    q.with_ctes(
        ["listings_raw"],
        "SELECT ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS position FROM listings_raw WHERE job_title <> ''",
    ),
)
def dense_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(raw(spark, sf_dir).where("job_title <> ''").select("ordinal"), "ordinal")


@query(
    "f1_country_filter",
    q.with_ctes(["listings_raw"], "SELECT ordinal, id, country_code FROM listings_raw WHERE country_code = '' OR upper(country_code) = 'CA'"),
)
def country_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.filter_country(raw(spark, sf_dir), " ca ").select("ordinal", "id", "country_code")


_HAY = (
    "lower(concat_ws(' ', title, company, location, summary, pay, seniority, employment, array_to_string(industries, ' '), "
    "array_to_string(skills, ' '), array_to_string(certifications, ' '), array_to_string(achievements, ' ')))"
)


@query(
    "f2_search_listings",
    q.over_listings(
        f"""SELECT {FLAT_LISTING} FROM listings WHERE list_contains(industries, 'Retail') AND seniority = '1-URGENT'
        AND pay <> '' AND employment <> '' AND contains({_HAY}, 'household') AND contains({_HAY}, 'skill3')"""
    ),
)
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ls.search_listings(
        listings(spark, sf_dir), query=" SKILL3 ", industry="Retail", seniority="1-URGENT", chip="Household",
        need_pay=True, need_employment=True,
    )
    return flat(found)


@query("f2_indexed_search", q.over_listings(f"SELECT {FLAT_LISTING} FROM listings WHERE contains({_HAY}, 'household') AND contains({_HAY}, 'skill3')"))
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "searched")
    write_indexed(listings(spark, sf_dir), path)
    return flat(search_indexed(spark, path, query=" SKILL3 ", chip="Household"))


@query(
    "f3_window_slice",
    q.with_ctes(
        ["listings_raw"],
        f"SELECT ordinal, {RAW_COLUMNS} FROM listings_raw WHERE country_code = '' OR upper(country_code) = 'US' ORDER BY ordinal LIMIT 500 OFFSET 700",
    ),
)
def window_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.slice_window(raw(spark, sf_dir), "us", 700, 0)


@query(
    "f3_deep_window_slice",
    q.with_ctes(["listings_raw"], f"SELECT ordinal, {RAW_COLUMNS} FROM listings_raw ORDER BY ordinal DESC LIMIT 300"),
)
def deep_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The last 300 rows, as a window far from the start: numbered, not sorted into one task.
    rows = raw(spark, sf_dir)
    total = ls.window_totals(rows, "").first()["csv_rows_total"]
    return ls.slice_window(rows, "", total - 300, 300)


_COUNTS = "count(*) FILTER (WHERE country_code = '' OR upper(country_code) = 'US')"


@query(
    "f3_window_totals",
    q.with_ctes(["listings_raw"], f"SELECT {_COUNTS} AS filtered_total, count(*) AS csv_rows_total FROM listings_raw"),
)
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.window_totals(raw(spark, sf_dir), "US")


@query(
    "f4_pagination",
    q.with_ctes(
        ["listings_raw"],
        f"""SELECT CAST(3 AS BIGINT) AS page, CAST(250 AS BIGINT) AS per_page, CAST(500 AS BIGINT) AS "offset", n AS total_filtered_rows,
        CAST(ceil(n / 250.0) AS BIGINT) AS total_pages, true AS has_prev, 3 < ceil(n / 250.0) AS has_next
        FROM (SELECT {_COUNTS} AS n FROM listings_raw)""",
    ),
)
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.pagination(raw(spark, sf_dir), "US", page=3, per_page=250)


@query(
    "f4_shard_pagination",
    q.with_ctes(
        ["listings_raw"],
        """SELECT CAST(2 AS BIGINT) AS page, CAST(500 AS BIGINT) AS per_page, CAST(400 AS BIGINT) AS requested_per_page,
        false AS per_page_matches_shard, CAST(500 AS BIGINT) AS "offset", count(*) AS total_filtered_rows,
        CAST(ceil(count(*) / 500.0) AS BIGINT) AS total_pages, true AS has_prev, 2 < ceil(count(*) / 500.0) AS has_next,
        CAST(1 AS BIGINT) AS shard_index FROM us_rows""",
        q.MAPPED, _US,
    ),
)
def shard_page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "shards")
    build_shards(spark, mapped(spark, sf_dir), path, _URL, "2026-05-01T00:00:00Z")
    return shard_pagination(spark, path, _URL, 2, 400)


def _top(column: str, most: int) -> str:
    values = f"unnest({column})" if column == "industries" else column
    return q.over_listings(
        f"SELECT value, count(*) AS n FROM (SELECT {values} AS value FROM listings) WHERE value <> '' GROUP BY value ORDER BY n DESC, value LIMIT {most}"
    )


@query("a2_top_industries", _top("industries", ls.INDUSTRY_OPTIONS))
def top_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.top_values(listings(spark, sf_dir, with_id=False), "industries", ls.INDUSTRY_OPTIONS)


@query("a2_top_seniority", _top("seniority", ls.SENIORITY_OPTIONS))
def top_seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.top_values(listings(spark, sf_dir, with_id=False), "seniority", ls.SENIORITY_OPTIONS)


_SORTED = "ordinal, id, title, company, pay, posted, CASE WHEN isnan(score) THEN -1.0 ELSE score END AS score"


_ORDERS = {
    "fresh": f"{q.FRESH} DESC",
    "score": f"CASE WHEN isnan(score) THEN CAST('-Infinity' AS DOUBLE) ELSE score END DESC, {q.FRESH} DESC",
    "pay": f"{q.pay_max('pay')} DESC",
    "company": "company ASC",
}


def _sort_query(mode: str) -> None:
    places = f"CAST(row_number() OVER (ORDER BY {_ORDERS[mode]}, ordinal) AS BIGINT) AS place"

    @query(f"o1_sort_{mode}", q.over_listings(f"SELECT {_SORTED}, {places} FROM listings"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        placed = ls.placed_listings(listings(spark, sf_dir), mode)
        return flat(placed.select("ordinal", "id", "title", "company", "pay", "posted", "score", "place"))


for _mode in _ORDERS:
    _sort_query(_mode)


def _rail_query(mode: str) -> None:
    @query(f"w1_rails_{mode}", q.over_listings(_RAIL_OUT, _RAILS.format(order=_ORDERS[mode], source="listings")))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rail_columns(ls.rails(listings(spark, sf_dir), mode))


for _mode in _ORDERS:
    _rail_query(_mode)

_DAYS = 3
_DAILY = f"""daily AS (SELECT * REPLACE ((ordinal % {_DAYS}) * {SNAPSHOT_ROWS} + ordinal AS ordinal) FROM listings_raw)"""


def daily_store(spark: SparkSession, sf_dir: str):
    """The listings dealt to snapshots of three days, each added to a store."""
    rows = mapped(spark, sf_dir)
    store = snapshot_store(spark, run_dir(spark, "snapshots"), rows.schema)
    for day in range(_DAYS):
        add_snapshot(store, day, rows.where(F.col("ordinal") % _DAYS == day))
    return store


@query(
    "n1_daily_snapshots",
    q.with_ctes(["listings_raw"], f"SELECT {FLAT_LISTING} FROM listings", _DAILY, q.MAPPED.replace("FROM listings_raw", "FROM daily"), q.DEDUPED, q.LISTINGS),
)
def daily_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(normalized_listings(daily_store(spark, sf_dir)))


@query(
    "o3_listing_cap",
    q.over_listings("SELECT ordinal, title, company FROM listings ORDER BY ordinal LIMIT 4000"),
)
def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.first_rows(listings(spark, sf_dir, with_id=False)).select("ordinal", "title", "company")


_STATE = """state AS (SELECT user_uid, job_id, CASE action WHEN 'save' THEN 'saved' WHEN 'hide' THEN 'hidden' ELSE action END AS kind,
  max(ts) AS ts FROM job_state_events GROUP BY user_uid, job_id, action HAVING action = 'hide' OR count(*) % 2 = 1)"""


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_state(view(spark, sf_dir, "job_state_events"))


@query("a13_job_state", q.with_ctes(["job_state_events"], "SELECT user_uid, job_id, kind, ts FROM state", _STATE))
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(spark, sf_dir)


def _of_user(kind: str) -> str:
    return f"(SELECT job_id FROM state WHERE user_uid = 'u7' AND kind = '{kind}')"


@query(
    "j1_without_hidden",
    q.over_listings(f"SELECT ordinal, id, title FROM listings WHERE id NOT IN {_of_user('hidden')}", _STATE, views=("job_state_events",)),
)
def not_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = jobs_of(state(spark, sf_dir), "u7", "hidden")
    return ls.without_hidden(listings(spark, sf_dir), hidden).select("ordinal", "id", "title")


@query(
    "j2_only_saved",
    q.over_listings(f"SELECT ordinal, id, title FROM listings WHERE id IN {_of_user('saved')}", _STATE, views=("job_state_events",)),
)
def saved_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = jobs_of(state(spark, sf_dir), "u7", "saved")
    return ls.only_saved(listings(spark, sf_dir), saved).select("ordinal", "id", "title")


@query(
    "w1_rails_saved",
    q.over_listings(
        f"""SELECT 'Saved Job Listings' AS rail, row_number() OVER (ORDER BY {q.FRESH} DESC, ordinal) AS rail_position, id, title, company,
        location, posted, city_key FROM listings WHERE id IN {_of_user('saved')} ORDER BY rail_position LIMIT 80""",
        _STATE, views=("job_state_events",),
    ),
)
def saved_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = jobs_of(state(spark, sf_dir), "u7", "saved")
    return rail_columns(ls.rails(ls.search_listings(listings(spark, sf_dir), saved=saved), saved_only=True))


@query(
    "j3_company_domain",
    q.over_listings(
        f"""SELECT ordinal, l.id, l.company, coalesce(nullif({q.host_of_url('apply')}, ''), nullif(r.domain, ''), o.domain,
          {q.domain_guess('lower(l.company)', tx.LISTING_STOP_WORDS)}) AS company_domain
        FROM listings l LEFT JOIN registry r ON lower(l.company) = r.n LEFT JOIN domain_overrides o ON o.name = l.company""",
        f"""registry AS (SELECT {q.clean('lower(name)')} AS n, domain FROM companies
          QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY ordinal) = 1)""",
        views=("companies", "domain_overrides"),
    ),
)
def company_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = co.with_company_domain(
        listings(spark, sf_dir), view(spark, sf_dir, "companies"), view(spark, sf_dir, "domain_overrides")
    )
    return found.select("ordinal", "id", "company", "company_domain")


# --- profile and trends --------------------------------------------------------------------------


@query(
    "a14_profile",
    q.with_ctes(
        ["listings_raw"],
        f"SELECT count(*) AS row_count, CAST({len(ls.ALIASES) + 1} AS BIGINT) AS column_count, 'ordinal,{','.join(ls.ALIASES)}' AS columns FROM listings_raw",
    ),
)
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.profile(mapped(spark, sf_dir))


@query("a14_preview", q.with_ctes(["listings_raw"], f"SELECT ordinal, {RAW_COLUMNS} FROM mapped ORDER BY ordinal LIMIT 25", q.MAPPED))
def dataset_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.preview(mapped(spark, sf_dir), "ordinal", 25)


_DIST = ["job_seniority_level", "job_employment_type", "job_industries", "country_code"]


@query(
    "a14_distribution",
    q.with_ctes(
        ["listings_raw"],
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM listings_raw) AS share FROM listings_raw GROUP BY {c}"
            for c in _DIST
        ),
    ),
)
def dataset_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.distribution(raw(spark, sf_dir), _DIST)


def _trend(key: str, source: str) -> str:
    return q.over_listings(
        f"SELECT {key}, month, n, n - lag(n) OVER (PARTITION BY {key} ORDER BY month) AS change FROM counted",
        "dated AS (SELECT *, CAST(date_trunc('month', TRY_CAST(posted AS DATE)) AS DATE) AS month FROM listings)",
        f"counted AS (SELECT {key}, month, count(*) AS n FROM ({source}) WHERE month IS NOT NULL GROUP BY {key}, month)",
    )


@query("a15_skill_trend", _trend("skill", "SELECT month, unnest(list_distinct(list_concat(skills, certifications))) AS skill FROM dated"))
def skills_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.skill_trend(listings(spark, sf_dir, with_id=False))


@query("a16_hiring_momentum", _trend("company", "SELECT month, company FROM dated"))
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.hiring_momentum(listings(spark, sf_dir, with_id=False))


@query(
    "a17_job_skill_bridge",
    q.over_listings(
        "SELECT id, 'skill' AS kind, unnest(list_distinct(skills)) AS skill FROM listings UNION ALL "
        "SELECT id, 'certification' AS kind, unnest(list_distinct(certifications)) AS skill FROM listings"
    ),
)
def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.job_skill_bridge(listings(spark, sf_dir))
