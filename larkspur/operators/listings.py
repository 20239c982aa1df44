"""Listing operators: mapping, de-duplication, normalisation, search, sorting, rails and paging."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators.numbering import positions, window_at, with_position
from larkspur.session import stored

# Each listing column with the input names it may come from, first filled one wins.
ALIASES = {
    "id": ("id",),
    "job_title": ("job_title", "title"),
    "company_name": ("company_name", "company"),
    "job_location": ("job_location", "location"),
    "job_seniority_level": ("job_seniority_level", "seniority"),
    "job_employment_type": ("job_employment_type", "employment_type"),
    "job_industries": ("job_industries", "industries"),
    "industries": ("industries", "job_industries"),
    "job_summary": ("job_summary", "summary"),
    "job_base_pay_range": ("job_base_pay_range", "pay_range"),
    "job_posted_date": ("job_posted_date", "posted_date"),
    "competitiveness_score": ("competitiveness_score", "score"),
    "skills": ("skills",),
    "certifications": ("certifications",),
    "achievements": ("achievements",),
    "url": ("url",),
    "apply_link": ("apply_link", "apply_url"),
    "country_code": ("country_code",),
    "ingest_utc_date": ("ingest_utc_date",),
}
# Sizes of pages, rails and option lists.
PAGE_SIZE, PAGE_MAX = 500, 2500
LISTINGS_MAX = 4000
RAIL_SIZE, SAVED_SIZE = 18, 80
CITIES = ("Los Angeles", "New York", "Bay Area", "Chicago", "Austin")
EVERYWHERE = "United States"
INDUSTRY_OPTIONS, SENIORITY_OPTIONS = 35, 20


def map_aliases(df: DataFrame, spec: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Bring input columns to the fixed listing columns; absent ones become ''. ``ordinal`` is kept."""
    present = set(df.columns)

    def pick(names: tuple[str, ...]) -> Column:
        found = [F.col(n).cast("string") for n in names if n in present]
        return tx.first_filled(*found) if found else F.lit("")

    kept = ["ordinal"] if "ordinal" in present else []
    return df.select(*kept, *[pick(names).alias(target) for target, names in spec.items()])


def listing_key() -> Column:
    """The id, or title|company|location where the id is blank."""
    fallback = F.concat_ws("|", "job_title", "company_name", "job_location")
    return F.when(tx.trim(F.col("id")) != "", F.col("id")).otherwise(fallback)


def first_per_key(df: DataFrame, key: Column, order_col: str = "ordinal") -> DataFrame:
    """Keep the first row of each key. Spark limits each key before the shuffle, so copies do not pile up."""
    first = Window.partitionBy("_key").orderBy(order_col)
    return (
        df.withColumn("_key", key)
        .withColumn("_rank", F.row_number().over(first))
        .where("_rank = 1")
        .drop("_key", "_rank")
    )


def dedupe_listings(df: DataFrame) -> DataFrame:
    return first_per_key(df, listing_key())


def union_pages(df: DataFrame, page_col: str, size: int = 500, pages: int = 4) -> DataFrame:
    """Join the pages before the first missing one, de-duplicate and cap at size * pages rows."""
    by_page = Window.orderBy(page_col)
    unbroken = (
        df.where(F.col(page_col).between(0, pages - 1))
        .select(page_col)
        .distinct()
        .withColumn("_rank", F.row_number().over(by_page) - 1)
        .where(F.col("_rank") == F.col(page_col))
        .select(page_col)
    )
    # At most ``pages`` rows are broadcast.
    rows = df.join(F.broadcast(unbroken), page_col, "left_semi").drop(page_col)
    return dedupe_listings(rows).orderBy("ordinal").limit(size * pages)


def first_rows(df: DataFrame, most: int = LISTINGS_MAX) -> DataFrame:
    return df.orderBy("ordinal").limit(most)


def filter_country(df: DataFrame, wanted: str | None) -> DataFrame:
    """Rows of one country; rows without a country pass, a blank wish keeps all."""
    code = (wanted or "").strip().upper()
    if not code:
        return df
    own = F.upper(tx.trim(tx.blank_if_null(F.col("country_code"))))
    return df.where((own == "") | (own == code))


def clamp_size(value: float | None, default: int = PAGE_SIZE, most: int = PAGE_MAX) -> int:
    """0 or nothing means the default; the rest is held between 1 and ``most``."""
    return min(most, max(1, int(value or default)))


def slice_window(df: DataFrame, country: str | None, offset: int | None = 0, limit: int | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the country, sorted in input order."""
    start, size = max(0, int(offset or 0)), clamp_size(limit)
    return window_at(filter_country(df, country), "ordinal", start, size)


def window_totals(df: DataFrame, country: str | None) -> DataFrame:
    """Rows in all and rows of the country, in one pass."""
    code = (country or "").strip().upper()
    own = F.upper(tx.trim(tx.blank_if_null(F.col("country_code"))))
    match = F.lit(True) if not code else (own == "") | (own == code)
    return df.agg(
        F.count_if(match).alias("filtered_total"), F.count("*").alias("csv_rows_total")
    )


def pagination(
    df: DataFrame, country: str | None, page: int | None = 1, per_page: int | None = None, limit: int | None = None
) -> DataFrame:
    """One row describing a page of the filtered listings."""
    size = clamp_size(per_page or limit)
    number = max(1, int(page or 1))
    total = F.col("filtered_total")
    pages = F.ceil(total / size).cast("long")
    return window_totals(df, country).select(
        F.lit(number).cast("long").alias("page"),
        F.lit(size).cast("long").alias("per_page"),
        F.lit((number - 1) * size).cast("long").alias("offset"),
        total.alias("total_filtered_rows"),
        pages.alias("total_pages"),
        F.lit(number > 1).alias("has_prev"),
        (F.lit(number) < pages).alias("has_next"),
    )


def named() -> Column:
    """Whether a mapped listing has a title and a company."""
    return (F.col("job_title") != "") & (F.col("company_name") != "")


def survivors(mapped: DataFrame) -> DataFrame:
    """(ordinal, _position) of the listings left after de-duplication that have a title and a company.

    Worked out on narrow rows and stored, so that the wide rows are read once, in the plan that needs them.
    """
    narrow = mapped.select("ordinal", listing_key().alias("_of"), named().alias("_named"))
    left = first_per_key(narrow, F.col("_of")).where("_named").select("ordinal")
    return stored(positions(left, "ordinal", "_position"), "survivors")


def normalize_snapshot(mapped: DataFrame) -> DataFrame:
    """De-duplicated, numbered and normalised listings of a mapped snapshot.

    The wide rows meet the survivors by ordinal, so conditions on listing columns reach below the join, and only rows that
    are returned are shuffled.
    """
    return _typed(mapped.join(survivors(mapped), "ordinal"), True)


def normalize_listings(df: DataFrame, with_id: bool = True) -> DataFrame:
    """Typed, cleaned listings. A blank id becomes 'job-' and the row's position among the kept rows.

    Without ``with_id`` there is no id column and no shuffle for the positions.
    """
    kept = df.where(named())
    return _typed(with_position(kept, "ordinal", "_position") if with_id else kept, with_id)


def normalize_rows(placed: DataFrame) -> DataFrame:
    """Typed, cleaned listings of rows that are de-duplicated and carry their ``_position`` already."""
    return _typed(placed, True)


def _typed(rows: DataFrame, with_id: bool) -> DataFrame:
    made = F.concat(F.lit("job-"), F.col("_position").cast("string")) if with_id else None
    typed = rows.select(
        "ordinal",
        *([tx.first_filled(F.col("id"), made).alias("id")] if with_id else []),
        tx.clean(F.col("job_title")).alias("title"),
        tx.clean(F.col("company_name")).alias("company"),
        tx.clean_location(F.col("job_location")).alias("location"),
        tx.clean(F.col("job_seniority_level")).alias("seniority"),
        tx.clean(F.col("job_employment_type")).alias("employment"),
        tx.split_tags(tx.first_filled(F.col("industries"), F.col("job_industries"))).alias("industries"),
        tx.clean(F.col("job_summary")).alias("summary"),
        tx.clean(F.col("job_base_pay_range")).alias("pay"),
        tx.first_filled(F.col("job_posted_date"), F.col("ingest_utc_date")).alias("posted"),
        tx.to_number(F.col("competitiveness_score")).alias("score"),
        tx.split_tags(F.col("skills")).alias("skills"),
        tx.split_tags(F.col("certifications")).alias("certifications"),
        tx.split_tags(F.col("achievements")).alias("achievements"),
        F.col("url"),
        tx.first_filled(F.col("apply_link"), F.col("url")).alias("apply"),
        F.coalesce(F.nullif(F.col("country_code"), F.lit("")), F.lit("US")).alias("country"),
    )
    return typed.withColumn("city_key", tx.city_key(F.col("location")))


def haystack() -> Column:
    """All searchable text of a listing in lower case."""
    plain = ["title", "company", "location", "summary", "pay", "seniority", "employment"]
    return F.lower(
        F.concat_ws(" ", *plain, F.col("industries"), F.col("skills"), F.col("certifications"), F.col("achievements"))
    )


def needles(query: str = "", chip: str = "") -> list[str]:
    """The texts that a search looks for in ``haystack``."""
    return [n for n in (chip.lower(), query.strip().lower()) if n]


def search_listings(
    df: DataFrame,
    query: str = "",
    industry: str = "",
    seniority: str = "",
    chip: str = "",
    need_pay: bool = False,
    need_employment: bool = False,
    hidden: DataFrame | None = None,
    saved: DataFrame | None = None,
) -> DataFrame:
    """Listings passing every given condition. ``hidden`` and ``saved`` hold one user's ids in ``job_id``."""
    out = df
    # Conditions on plain columns come first, so that the lists and the long text are made for few rows.
    if seniority:
        out = out.where(F.col("seniority") == seniority)
    if need_pay:
        out = out.where(tx.trim(F.col("pay")) != "")
    if need_employment:
        out = out.where(tx.trim(F.col("employment")) != "")
    if industry:
        out = out.where(F.array_contains("industries", industry))
    wanted = needles(query, chip)
    if wanted:
        # A one-element array binds the long text once for all needles.
        def holds_all(text: Column) -> Column:
            return reduce(and_, [F.contains(text, F.lit(n)) for n in wanted])

        out = out.where(F.exists(F.array(haystack()), holds_all))
    if hidden is not None:
        out = without_hidden(out, hidden)
    if saved is not None:
        out = only_saved(out, saved)
    return out


def without_hidden(df: DataFrame, hidden: DataFrame) -> DataFrame:
    return df.join(hidden.select(F.col("job_id").alias("id")), "id", "left_anti")


def only_saved(df: DataFrame, saved: DataFrame) -> DataFrame:
    return df.join(saved.select(F.col("job_id").alias("id")), "id", "left_semi")


def with_sort_keys(df: DataFrame, mode: str = "fresh") -> tuple[DataFrame, list[Column]]:
    """Compute the keys of a sort mode once per row, so that no comparison evaluates them again.

    Ties keep the input order and a NaN score goes last.
    """
    fresh = tx.freshness(F.col("posted"))
    keys = {
        "score": [F.nanvl(F.col("score"), F.lit(float("-inf"))), fresh],
        "pay": [tx.pay_max(F.col("pay"))],
        "company": [],
    }.get(mode, [fresh])
    keyed = df.withColumns({f"_key{i}": key for i, key in enumerate(keys)})
    order = [F.col(f"_key{i}").desc() for i in range(len(keys))]
    if mode == "company":
        order = [F.collate(F.col("company"), "UNICODE").asc()]
    return keyed, [*order, F.col("ordinal").asc()]


def _without_keys(df: DataFrame) -> DataFrame:
    return df.drop("_key0", "_key1")


def placed_listings(df: DataFrame, mode: str = "fresh", name: str = "place") -> DataFrame:
    """Every listing with its 1-based place in the order of a sort mode, as a column.

    Rows are dealt by ranges of the order and sorted there, once, and stored. A row's number within its partition, and the row
    counts of the partitions before, give its place; no task sees more than its range. The counts are one row a partition.
    """
    keyed, order = with_sort_keys(df, mode)
    dealt = stored(_without_keys(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())), "order")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    joined = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row per shuffle partition
    return joined.select(*df.columns, (F.col("_start") + at + 1).alias(name))


def sort_listings(df: DataFrame, mode: str = "fresh") -> DataFrame:
    keyed, order = with_sort_keys(df, mode)
    return _without_keys(keyed.orderBy(*order))


def rails(df: DataFrame, mode: str = "fresh", saved_only: bool = False, size: int = RAIL_SIZE) -> DataFrame:
    """The first listings overall, then of each city those not shown before, at most ``size`` each.

    The first rail takes at most ``size`` rows from a city, so 2 * size rows per city are enough for all
    rails. Spark applies that limit before the shuffle; what follows handles a few hundred rows.
    """
    keyed, order = with_sort_keys(df, mode)
    overall = Window.orderBy(*order)
    if saved_only:
        best = keyed.orderBy(*order).limit(SAVED_SIZE).withColumn("rail_position", F.row_number().over(overall))
        saved = best.withColumn("rail_position", F.col("rail_position").cast("long"))
        return _without_keys(saved).withColumn("rail", F.lit("Saved Job Listings"))
    per_city = Window.partitionBy("city_key").orderBy(*order)
    candidates = keyed.withColumn("_in_city", F.row_number().over(per_city)).where(F.col("_in_city") <= 2 * size)
    ranked = candidates.withColumn("_overall", F.row_number().over(overall))
    first = F.col("_overall") <= size
    named = ranked.withColumn("_rail", F.when(first, EVERYWHERE).otherwise(F.col("city_key"))).where(
        first | F.col("city_key").isin(*CITIES)
    )
    in_rail = Window.partitionBy("_rail").orderBy("_overall")
    placed = named.withColumn("rail_position", F.row_number().over(in_rail)).where(F.col("rail_position") <= size)
    placed = placed.withColumn("rail_position", F.col("rail_position").cast("long"))
    return _without_keys(
        placed.withColumn("rail", F.concat(F.lit("Latest Jobs in "), F.col("_rail"))).drop("_in_city", "_overall", "_rail")
    )


def top_values(df: DataFrame, column: str, most: int) -> DataFrame:
    """Most frequent values of a text or array column, then by name."""
    is_array = dict(df.dtypes)[column].startswith("array")
    values = df.select(F.explode(column).alias("value") if is_array else F.col(column).alias("value"))
    if not is_array:
        values = values.where(F.col("value") != "")
    return (
        values.groupBy("value")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), F.collate(F.col("value"), "UNICODE"))
        .limit(most)
    )


def job_cards(df: DataFrame, now_ms: int) -> DataFrame:
    """The texts shown on a listing card, as of ``now_ms``."""
    short_pay = F.regexp_replace(F.regexp_replace(tx.clean(F.col("pay")), "(?i)per hour", "/hr"), "(?i)hourly", "/hr")
    base = df.withColumns(
        {
            "_posted": tx.date_millis(F.col("posted")),
            "short_pay": F.substring(short_pay, 1, 28),
            "_achieved": F.get(F.col("achievements"), F.lit(0)),
        }
    )
    hours = F.floor((F.lit(now_ms) - F.col("_posted")) / 3600000.0 + 0.5).cast("long")
    base = base.withColumn("_hours", F.greatest(F.lit(1).cast("long"), hours))
    days = F.floor(F.col("_hours") / 24 + 0.5).cast("long")
    age = (
        F.when(F.col("_posted").isNull() | (F.col("_posted") == 0), "5h")
        .when(F.col("_hours") < 24, F.concat(F.col("_hours").cast("string"), F.lit("h")))
        .when(days < 30, F.concat(days.cast("string"), F.lit("d")))
        .otherwise(F.concat(F.floor(days / 30 + 0.5).cast("string"), F.lit("mo")))
    )
    achieved = F.col("_achieved")
    tag_list = F.array(
        F.col("location"),
        F.when(F.col("pay") != "", F.col("short_pay")),
        tx.first_filled(F.col("employment"), F.lit("Full Time")),
        F.col("seniority"),
        F.when(F.length(achieved) > 14, F.concat(F.substring(achieved, 1, 14), F.lit("…"))).otherwise(achieved),
        F.get(F.col("certifications"), F.lit(0)),
        F.get(F.col("industries"), F.lit(0)),
    )
    return base.select(
        "ordinal",
        "id",
        age.alias("age"),
        tx.first_sentence(F.col("summary"), 120).alias("sentence"),
        tx.snippet(F.col("summary"), 260).alias("snippet"),
        "short_pay",
        tx.initials(F.col("company")).alias("initials"),
        F.filter(tag_list, lambda t: t.isNotNull() & (t != "")).alias("tags"),
        F.array_join(F.concat(F.slice("skills", 1, 4), F.slice("certifications", 1, 2)), ", ").alias("skill_text"),
    )
