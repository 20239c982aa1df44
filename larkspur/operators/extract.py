"""Contacts from resume text, job postings from HTML, outcome records and the URL allow-list."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators.companies import company_by_slug

# Contact patterns, the lines searched for a name, and lengths.
EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
PHONE = r"\+?[0-9][0-9" + tx.SPACE + r"().-]{8,}[0-9]"
NAME_LINE = r"^[A-Za-z" + tx.SPACE + r".'-]+\z"
NAME_LINES, SNIPPET, EXCERPT_MAX, PAGE_TEXT_MAX = 12, 400, 1200, 5000
OUTCOMES = ("applied", "oa", "phone", "interview", "final", "offer", "rejected", "withdrawn")
OUTCOMES_MAX = 200

JOB_PAGE_FIELDS = ("title", "company", "location", "date_posted", "employment_type", "description")


def extract_contacts(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """First e-mail, first phone, a name among the first lines, and the start of the text."""
    text = tx.blank_if_null(F.col(text_col))
    lines = F.transform(F.slice(F.split(text, r"\r?\n", NAME_LINES + 1), 1, NAME_LINES), lambda x: tx.trim(x))

    def is_name(line: Column) -> Column:
        # A line of these characters has no '@', so it holds no e-mail address either.
        return F.length(line).between(4, 79) & line.rlike(NAME_LINE)

    return df.select(
        key,
        F.coalesce(F.get(F.filter(lines, is_name), F.lit(0)), F.lit("")).alias("full_name"),
        F.when(F.contains(text, F.lit("@")), F.regexp_extract(text, EMAIL, 0)).otherwise("").alias("email"),
        tx.trim(tx.collapse_space(F.regexp_extract(text, PHONE, 0))).alias("phone"),
        tx.trim(F.substring(text, 1, SNIPPET)).alias("snippet"),
    )


class _Page(HTMLParser):
    """Collects the text nodes, the first heading or title, and the JSON blocks of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.json_blocks: list[str] = []
        self.heading: list[str] | None = None
        self._node: list[str] = []
        self._raw: str | None = None
        self._is_json = False
        self._open_heading: str | None = None

    def _end_node(self) -> None:
        text = "".join(self._node)
        self._node = []
        if self._raw:
            if self._is_json:
                self.json_blocks.append(text)
            return
        text = text.strip()
        if text:
            self.texts.append(text)
            if self._open_heading and self.heading is not None:
                self.heading.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end_node()
        if tag in ("script", "style"):
            self._raw = tag
            self._is_json = tag == "script" and dict(attrs).get("type") == "application/ld+json"
        elif tag in ("h1", "title") and self.heading is None:
            self.heading, self._open_heading = [], tag

    def handle_endtag(self, tag: str) -> None:
        self._end_node()
        if tag == self._raw:
            self._raw, self._is_json = None, False
        if tag == self._open_heading:
            self._open_heading = None

    def handle_comment(self, data: str) -> None:
        self._end_node()

    def handle_decl(self, decl: str) -> None:
        self._end_node()

    def handle_data(self, data: str) -> None:
        self._node.append(data)

    def close(self) -> None:
        super().close()
        self._end_node()


def _parse(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.close()
    return page


def _plain(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else str(value)


def _posting(block: str) -> dict | None:
    try:
        data = json.loads(block)
    except ValueError:
        return None
    for item in data if isinstance(data, list) else [data]:
        if isinstance(item, dict) and item.get("@type") == "JobPosting":
            return item
    return None


def _job_fields(html: str) -> tuple:
    page = _parse(html)
    for block in page.json_blocks:
        item = _posting(block)
        if item is None:
            continue
        place, org = item.get("jobLocation"), item.get("hiringOrganization")
        if isinstance(place, dict):
            address = place.get("address")
            address = address if isinstance(address, dict) else {}
            parts = (address.get(k) for k in ("addressLocality", "addressRegion", "addressCountry"))
            place = ", ".join(str(p) for p in parts if p)
        return (
            _plain(item.get("title")),
            _plain(org.get("name")) if isinstance(org, dict) else None,
            _plain(place),
            _plain(item.get("datePosted")),
            _plain(item.get("employmentType")),
            " ".join(_parse(str(item.get("description") or "")).texts),
        )
    title = " ".join(page.heading) if page.heading is not None else None
    return title, None, None, None, None, " ".join(page.texts)[:PAGE_TEXT_MAX]


def extract_job_postings(df: DataFrame, key: str = "page_id") -> DataFrame:
    """Job posting of each page: its ld+json JobPosting, else heading and page text. Only key and HTML go to Python."""
    key_type = dict(df.dtypes)[key]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([_job_fields(h or "") for h in batch["html"]], columns=list(JOB_PAGE_FIELDS), dtype=object)
            found.insert(0, "url", batch["url"].to_numpy())
            found.insert(0, key, batch[key].to_numpy())
            yield found

    fields = ", ".join(f"{c} string" for c in ("url", *JOB_PAGE_FIELDS))
    return df.select(key, "url", "html").mapInPandas(parse, f"{key} {key_type}, {fields}")


def outcome_records(answers: DataFrame, registry: DataFrame, most: int | None = OUTCOMES_MAX) -> DataFrame:
    """Newest outcome records with company fields; the company must be in the registry.

    A record with an unknown outcome is kept and marked in ``known_outcome``. Of companies with one slug the last counts.
    """
    firm = company_by_slug(registry).select(
        "slug", F.col("rank").alias("company_rank"), F.col("name").alias("company_name"),
        F.col("domain").alias("company_domain"),
    )

    def said(name: str) -> Column:
        return tx.trim(tx.blank_if_null(F.col(name))).alias(name)

    found = (
        answers.join(firm, answers["company_slug"] == firm["slug"])
        .orderBy(F.col("saved_at").desc(), F.col("id").desc())
        .select(
            "id", "saved_at", "company_rank", "company_name", "company_domain", said("full_name"), said("email"),
            said("phone"), "outcome", F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)).alias("known_outcome"),
            "date_applied", said("notes"),
            F.substring(tx.trim(tx.blank_if_null(F.col("resume"))), 1, EXCERPT_MAX).alias("resume_excerpt"),
        )
    )
    return found if most is None else found.limit(most)


def allowed_pages(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages whose longest matching rule (host, prefix, allow) allows them, or that no rule matches.

    A page is looked up once per prefix length used on its host, by equality, so no page meets all rules.
    Of equal rules the allowing one wins. No broadcast of the rules is needed, and both joins feed another
    shuffle, which lets Spark split a very common host.
    """
    single = rules.groupBy("host", "prefix").agg(F.max("allow").alias("allow"))
    lengths = single.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    rest = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*:[/\\]*[^/?#\\]*([^#]*)", 1)
    located = pages.select(
        key,
        tx.url_host(F.col("url")).alias("host"),
        F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)).alias("_path"),
    )
    matched = (
        located.join(lengths, "host")
        .withColumn("_length", F.explode("_lengths"))
        .where(F.col("_length") <= F.length("_path"))
        .select(key, "host", "_length", F.expr("substring(_path, 1, _length)").alias("prefix"))
        .join(single, ["host", "prefix"])
    )
    blocked = matched.groupBy(key).agg(F.max_by("allow", "_length").alias("_allow")).where(~F.col("_allow"))
    return pages.join(blocked.select(key), key, "left_anti")
