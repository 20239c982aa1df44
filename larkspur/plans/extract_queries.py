"""Queries over companies, resumes and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import url_host
from larkspur.operators import companies as co
from larkspur.operators import extract as ex
from larkspur.plans import sqltext as q
from larkspur.plans.catalog import query
from larkspur.plans.forum_queries import _REGISTRY, registry
from larkspur.plans.views import view
from larkspur.session import run_dir
from larkspur.sources.companies import read_jobs_csv, read_registry_csv, read_registry_json, write_jobs_csv

_FIRMS = ["companies", "domain_overrides"]


@query(
    "s9_registry_scan",
    q.with_ctes(
        ["companies"],
        f"""SELECT row_number() OVER (ORDER BY rank) AS ordinal, rank, name, {q.infer_industry('name')} AS industry, '' AS domain
        FROM (SELECT rank, concat(name, ' ', industry) AS name FROM companies WHERE rank % 10 <> 0 ORDER BY rank LIMIT 500)""",
    ),
)
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "registry")
    bad = F.when(F.col("rank") % 10 == 0, F.lit("x")).otherwise(F.lit("1500.5"))
    name = F.concat_ws(" ", "name", "industry")
    lines = view(spark, sf_dir, "companies").select(
        "rank", F.concat_ws(",", F.col("rank").cast("string"), name, bad, F.lit("9")).alias("value")
    )
    header = spark.createDataFrame([(0, "Rank,Company,Revenue,Profit")], "rank bigint, value string")
    lines.unionByName(header).repartitionByRange("rank").sortWithinPartitions("rank").select("value").write.text(path)
    return read_registry_csv(spark, path)


@query(
    "s9_registry_json",
    q.with_ctes(
        ["companies"],
        "SELECT rank, name, industry, domain, '' AS headquarters, 'S' AS state, CAST(rank * 2.5 AS DOUBLE) AS revenue_millions, rank * 10 AS employees "
        "FROM companies ORDER BY ordinal LIMIT 500",
    ),
)
def registry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "registry-json")
    # The registry is capped at 500 companies, so one document holds it.
    firms = co.first_companies(view(spark, sf_dir, "companies"))
    figures = [(F.col("rank") * 2.5).alias("revenueMillions"), (F.col("rank") * 10).alias("employees"), F.lit("S").alias("state")]
    firm = F.struct("ordinal", "rank", "name", "industry", "domain", *figures)
    document = firms.agg(F.sort_array(F.collect_list(firm)).alias("data"))
    document.select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    return read_registry_json(spark, path).drop("ordinal")


@query(
    "n12_infer_industry",
    q.with_ctes(["listings_raw"], f"SELECT ordinal, {q.infer_industry('concat(job_industries, job_location, job_seniority_level)')} AS industry FROM listings_raw"),
)
def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("job_industries", "job_location", "job_seniority_level")
    return view(spark, sf_dir, "listings_raw").select("ordinal", co.infer_industry(name).alias("industry"))


@query("n13_normalize_companies", q.with_ctes(_FIRMS, "SELECT * FROM registry", _REGISTRY))
def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir)


@query(
    "n13_company_by_slug",
    q.with_ctes(
        ["companies"],
        f"""SELECT {q.slug("concat('Seg ', industry)")} AS slug, max(ordinal) AS ordinal FROM (SELECT * FROM companies ORDER BY ordinal LIMIT 500) GROUP BY 1""",
    ),
)
def by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = view(spark, sf_dir, "companies").withColumn("name", F.concat(F.lit("Seg "), "industry"))
    return co.company_by_slug(co.normalize_companies(named)).select("slug", "ordinal")


@query(
    "f5_search_companies",
    q.with_ctes(
        _FIRMS,
        "SELECT * FROM registry WHERE contains(lower(name), 'machine') OR contains(slug, 'machine') OR contains(lower(industry), 'machine') ORDER BY ordinal LIMIT 20",
        _REGISTRY,
    ),
)
def company_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.search_companies(registry(spark, sf_dir), " Machine")


_LINES = f"list_transform(regexp_split_to_array(text, '\\r?\\n')[1:12], lambda v: {q.trim('v')})"
_NAMES = f"list_filter({_LINES}, lambda v: length(v) BETWEEN 4 AND 79 AND regexp_matches(v, '{ex.NAME_LINE.replace(chr(39), chr(39) * 2)}') AND NOT regexp_matches(v, '{ex.EMAIL}'))"


def _contact_sql(text: str) -> str:
    return f"""SELECT doc_id, coalesce(({_NAMES})[1], '') AS full_name, regexp_extract(text, '{ex.EMAIL}') AS email,
    {q.trim(q.collapse(f"regexp_extract(text, '{ex.PHONE}')"))} AS phone, {q.trim(f"substr(text, 1, {ex.SNIPPET})")} AS snippet
    FROM (SELECT doc_id, {text} AS text FROM resumes)"""


@query("x1_extract_contacts", q.with_ctes(["resumes"], _contact_sql("text")))
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.extract_contacts(view(spark, sf_dir, "resumes"), "doc_id")


@query(
    "x1_extract_signed_contacts",
    q.with_ctes(["resumes"], _contact_sql("concat('42 Main St', chr(13), chr(10), ' Ann O''Neil-Ray ', chr(10), text, chr(10), '+1 (555)  010-', CAST(1000 + doc_id % 9000 AS VARCHAR), ' a.', CAST(doc_id AS VARCHAR), '@mail.example')")),
)
def signed_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("42 Main St\r\n Ann O'Neil-Ray \n"), "text", F.lit("\n+1 (555)  010-"),
        (F.col("doc_id") % 9000 + 1000).cast("string"), F.lit(" a."), F.col("doc_id").cast("string"), F.lit("@mail.example"),
    )
    return ex.extract_contacts(view(spark, sf_dir, "resumes").withColumn("text", text), "doc_id")


def _unescape(x: str) -> str:
    # Character references that occur in the given pages, with or without the final semicolon; &amp goes last.
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", "\u00a0"), ("#39", "''")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


_CUT = "(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"
_NODES = f"list_filter(list_transform(regexp_split_to_array(html, '{_CUT}'), lambda v: {q.trim(_unescape('v'))}), lambda v: v <> '')"
_POSTINGS = f"""postings AS (SELECT page_id, url,
  CASE WHEN page_id % 3 = 0 THEN concat('T', CAST(page_id AS VARCHAR)) ELSE {q.trim(_unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} END AS title,
  CASE WHEN page_id % 3 = 0 THEN 'Org' END AS company, CASE WHEN page_id % 3 = 0 THEN 'Austin, US' END AS location,
  CASE WHEN page_id % 3 = 0 THEN '2026-05-01' END AS date_posted, CASE WHEN page_id % 3 = 0 THEN 'FULL_TIME' END AS employment_type,
  CASE WHEN page_id % 3 = 0 THEN 'Do things' ELSE substr(array_to_string({_NODES}, ' '), 1, 5000) END AS description FROM job_pages_html)"""


@query("x2_job_postings", q.with_ctes(["job_pages_html"], "SELECT * FROM postings", _POSTINGS))
def job_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.extract_job_postings(view(spark, sf_dir, "job_pages_html"))


_BACK = "SELECT CAST(page_id AS VARCHAR) AS page_id, url, title, coalesce(company, '') AS company, coalesce(location, '') AS location, coalesce(date_posted, '') AS date_posted, coalesce(employment_type, '') AS employment_type, coalesce(description, '') AS description FROM postings"


@query("s10_job_table_csv", q.with_ctes(["job_pages_html"], _BACK, _POSTINGS))
def job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "jobs")
    write_jobs_csv(job_postings(spark, sf_dir), path)
    return read_jobs_csv(spark, path)


@query(
    "s11_job_table_head",
    q.with_ctes(["listings_raw"], "SELECT CAST(ordinal AS VARCHAR) AS ordinal, id, trim(url) AS url FROM listings_raw ORDER BY listings_raw.ordinal LIMIT 700"),
)
def job_table_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a table in several files of unequal size."""
    path = run_dir(spark, "head")
    part = F.floor(F.log2(F.col("ordinal") / 50.0 + 1)).cast("int")
    rows = view(spark, sf_dir, "listings_raw").select("ordinal", "id", "url")
    write_jobs_csv(rows.repartitionByRange(6, part, "ordinal").sortWithinPartitions("ordinal"), path)
    return read_jobs_csv(spark, path, most=700)


@query(
    "s11_read_job_csv",
    q.with_ctes(
        ["listings_raw"],
        """SELECT id, CASE WHEN job_title = 'nan' THEN '' ELSE trim(job_title) END AS job_title,
        CASE WHEN job_posted_date = 'soon' THEN '' ELSE job_posted_date END AS job_posted_date, url FROM listings_raw""",
    ),
)
def job_table_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "jobs")
    rows = view(spark, sf_dir, "listings_raw").select(
        "id", F.trim("job_title").alias("job_title"),
        F.when(F.col("job_posted_date") == "soon", "N/A").otherwise(F.col("job_posted_date")).alias("job_posted_date"), "url",
    )
    write_jobs_csv(rows, path)
    return read_jobs_csv(spark, path)


_ANSWER_OUTCOME = "(['applied', 'oa', 'phone', 'interview', 'final', 'offer', 'rejected', 'withdrawn', 'unsure'])[CAST(doc_id % 9 AS INTEGER) + 1]"


@query(
    "x3_outcome_records",
    q.with_ctes(
        ["resumes", *_FIRMS],
        f"""SELECT a.doc_id AS id, a.doc_id * 10 AS saved_at, r.rank AS company_rank, r.name AS company_name, r.domain AS company_domain,
        concat('Ann ', CAST(a.doc_id AS VARCHAR)) AS full_name, '' AS email, '' AS phone, a.outcome, a.outcome <> 'unsure' AS known_outcome, '2026-05-01' AS date_applied, 'ok' AS notes,
        substr({q.trim('a.text')}, 1, 1200) AS resume_excerpt
        FROM (SELECT *, {_ANSWER_OUTCOME} AS outcome, concat('customer-', lpad(CAST(doc_id % 700 AS VARCHAR), 9, '0')) AS company_slug FROM resumes) a
        JOIN registry r ON r.slug = a.company_slug ORDER BY a.doc_id DESC LIMIT 200""",
        _REGISTRY,
    ),
)
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(o) for o in (*ex.OUTCOMES, "unsure")])
    answers = view(spark, sf_dir, "resumes").select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") * 10).alias("saved_at"),
        F.concat(F.lit("customer-"), F.lpad((F.col("doc_id") % 700).cast("string"), 9, "0")).alias("company_slug"),
        F.concat(F.lit("  Ann "), F.col("doc_id").cast("string"), F.lit(" ")).alias("full_name"),
        F.lit(None).cast("string").alias("email"), F.lit(" ").alias("phone"),
        F.get(names, (F.col("doc_id") % 9).cast("int")).alias("outcome"),
        F.lit("2026-05-01").alias("date_applied"), F.lit(" ok ").alias("notes"), F.col("text").alias("resume"),
    )
    return ex.outcome_records(answers, registry(spark, sf_dir))


_PAGE_HOST = q.url_host("url")
_PATH_QUERY = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:[/\\\\]*[^/?#\\\\]*([^#]*)', 1)"


@query(
    "f9_allowed_pages",
    q.with_ctes(
        ["job_pages_html"],
        """SELECT page_id, url FROM job_pages_html p WHERE coalesce((SELECT arg_max(r.allow, length(r.prefix)) FROM located l JOIN rules r
        ON r.host = l.host AND starts_with(l.path, r.prefix) WHERE l.page_id = p.page_id), true)""",
        f"located AS (SELECT page_id, {_PAGE_HOST} AS host, {_PATH_QUERY} AS path FROM job_pages_html)",
        """rules AS (SELECT host, prefix, allow FROM (SELECT DISTINCT host FROM located), (VALUES ('/en', false), ('/en/2', true), ('/fr', false), ('/fr/', true), ('/es/1', false)) AS t(prefix, allow))""",
    ),
)
def allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "job_pages_html").select("page_id", "url")
    fixed = (("/en", False), ("/en/2", True), ("/fr", False), ("/fr/", True), ("/es/1", False))
    each = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(a).alias("allow")) for p, a in fixed])
    rules = pages.select(url_host(F.col("url")).alias("host")).distinct().select("host", F.inline(each))
    return ex.allowed_pages(pages, rules)
