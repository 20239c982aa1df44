"""Extraction and file formats on hand-written input."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import extract as ex
from larkspur.operators.companies import normalize_companies
from larkspur.operators.listings import map_aliases
from larkspur.session import run_dir, shared_dir
from larkspur.sources import companies as sc
from larkspur.sources import listings as sl
from larkspur.sources.requests import read_requests


def test_contacts(spark):
    texts = [
        "Resume\njane.doe@mail.example\n  Jane O'Neil-Doe \nPhone +1 (555)  010-1234 x",
        "a@b.example is mine\r\nBob\r\nAnna Li\r\n", "", None, "x\n" * 12 + "Too Late\n", "Mr 5 Fifth\n12345", "1234567890",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [tuple(r)[1:4] for r in ex.extract_contacts(df, "id").orderBy("id").collect()]
    assert got == [
        ("Resume", "jane.doe@mail.example", "+1 (555) 010-1234"), ("Anna Li", "a@b.example", ""), ("", "", ""), ("", "", ""),
        ("", "", ""), ("", "", ""), ("", "", "1234567890"),
    ]
    long = spark.createDataFrame([(1, " " + "y" * 900)], "id int, text string")
    assert ex.extract_contacts(long, "id").first()["snippet"] == "y" * 399


POSTING = {
    "@type": "JobPosting", "title": "Dev", "hiringOrganization": {"name": "Org"}, "datePosted": "2026-01-01", "employmentType": ["FULL", "PART"],
    "jobLocation": {"address": {"addressLocality": "Rome", "addressRegion": None, "addressCountry": "IT"}}, "description": "<p>A &amp; B</p><p>C</p>",
}


def page(*blocks, body="<h1>Big <b>title</b></h1><p>x</p><style>s{}</style><script>var a;</script>t &lt;"):
    scripts = "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
    return f"<html><!-- c --><body>{scripts}{body}</body></html>"


def test_job_postings(spark):
    pages = [
        page("{bad json", json.dumps([{"@type": "Org"}, POSTING])), page("{bad json"), page(json.dumps({**POSTING, "jobLocation": "Here", "hiringOrganization": "x"})),
        "", None, "<title>T</title><h1>H</h1>plain", page('"text"', "[1, 2]"), "<p>only text", "<h1>unclosed <p>more",
    ]
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[2:] for r in ex.extract_job_postings(df.repartition(3)).collect()}
    assert got[0] == ("Dev", "Org", "Rome, IT", "2026-01-01", "['FULL', 'PART']", "A & B C")
    assert got[1] == ("Big title", None, None, None, None, "Big title x t <")
    assert got[2][1:3] == (None, "Here")
    assert got[3] == got[4] == (None, None, None, None, None, "")
    assert got[5] == ("T", None, None, None, None, "T H plain")
    assert got[6] == got[1]
    assert got[7] == (None, None, None, None, None, "only text")
    assert got[8][0] == "unclosed more"
    big = spark.createDataFrame([(1, "u", "<p>" + "z" * 6000)], "page_id long, url string, html string")
    assert len(ex.extract_job_postings(big).first()["description"]) == 5000


def test_outcomes(spark):
    firms = spark.createDataFrame([(1, 1, "Acme", "I", "a.example")], "ordinal long, rank long, name string, industry string, domain string")
    rows = [(i, i, "acme" if i % 2 else "none", " Ann ", None, "", "offer" if i % 3 else "maybe", "d", " n ", " r" * 900) for i in range(1, 1000)]
    df = spark.createDataFrame(rows, "id long, saved_at long, company_slug string, full_name string, email string, phone string, outcome string, date_applied string, notes string, resume string")
    firms = firms.unionByName(firms.selectExpr("2 ordinal", "2 rank", "'ACME' name", "industry", "domain"))
    got = ex.outcome_records(df, normalize_companies(firms)).collect()
    assert len(got) == 200
    assert [(r["id"], r["known_outcome"]) for r in got[:3]] == [(999, False), (997, True), (995, True)]
    assert ex.outcome_records(df, normalize_companies(firms), most=None).count() == 500
    assert (got[0]["company_domain"], got[0]["full_name"], got[0]["email"], len(got[0]["resume_excerpt"])) == ("a.example", "Ann", "", 1200)


def test_allowed_pages(spark):
    pages = [(1, "https://h.example/private/a"), (2, "https://h.example/private/open/x"), (3, "https://h.example/"), (4, "https://other.example/private"),
             (5, "https://h.example/search?q=1"), (6, "https://H.example/privately"), (7, "https://g.example/x"), (8, "https://h.example")]
    rules = [("h.example", "/private", False), ("h.example", "/private/open", True), ("h.example", "/search?q", False),
             ("g.example", "/", False), ("g.example", "/", True)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = ex.allowed_pages(df, spark.createDataFrame(rules, "host string, prefix string, allow boolean"))
    assert sorted(r["page_id"] for r in got.collect()) == [2, 3, 4, 7, 8]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_listing_csv(spark, tmp_path):
    text = ' id , job_title,company_name,note\r\n1," a ""quoted"" title ",c,"two\nlines"\r\n\r\n , ,,\r\n2,short\r\n3,t,c,n,extra\r\n'
    path = tmp_path / "l.csv"
    path.write_bytes(text.encode())
    got = [tuple(r)[1:] for r in sl.read_listings_csv(spark, str(path)).orderBy("ordinal").collect()]
    assert got == [("1", 'a "quoted" title', "c", "two\nlines"), ("2", "short", "", ""), ("3", "t", "c", "n")]


def test_listing_payloads(spark, tmp_path):
    rows = [{"id": 1, "title": "A", "pay_range": None}, {"id": "2", "job_title": "B"}]
    bodies = [json.dumps(rows), json.dumps({"jobs": rows}), json.dumps({"data": rows, "jobs": None}), json.dumps({"error": rows}), "null", "7", ""]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, payload string")
    found = sl.payload_listings(sl.read_payloads(df))
    got = sorted((r["n"], r["place"], r["id"]) for r in found.collect())
    assert got == [(n, p, str(p + 1)) for n in range(3) for p in range(2)]
    mapped = map_aliases(found.where("n = 1").withColumn("ordinal", F.col("place").cast("long"))).orderBy("ordinal").collect()
    assert [(r["id"], r["job_title"], r["job_base_pay_range"]) for r in mapped] == [("1", "A", ""), ("2", "B", "")]
    (tmp_path / "p.json").write_text("\n".join(bodies[:2]))
    assert [r["id"] for r in sl.read_listings_json(spark, str(tmp_path)).orderBy("ordinal").collect()] == ["1", "2"] * 2
    (tmp_path / "spread").mkdir()
    (tmp_path / "spread" / "q.json").write_text(json.dumps({"jobs": rows}, indent=1))
    whole = sl.read_listings_json(spark, str(tmp_path / "spread"), whole_files=True)
    assert [r["id"] for r in map_aliases(whole).orderBy("ordinal").collect()] == ["1", "2"]


def test_first_available(spark, tmp_path):
    made = tmp_path / "b.csv"
    made.write_text("id\n1\n")
    assert sl.first_available(spark, [str(tmp_path / "a.csv"), str(made)]) == str(made)
    with pytest.raises(FileNotFoundError):
        sl.first_available(spark, [str(tmp_path / "a.csv")])


def test_registry_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Rank,Company\n1,Big Bank, Inc,10.5,3\nx,bad,1,\n2,Acme,7,\n3,NoNumber,x,\n")
    got = [(r["ordinal"], r["rank"], r["name"], r["industry"]) for r in sc.read_registry_csv(spark, str(tmp_path / "r.csv")).collect()]
    assert got == [(1, 1, "Big Bank, Inc", "Financial Services"), (2, 2, "Acme", "Fortune 500")]
    (tmp_path / "r.json").write_text(json.dumps({"data": [{"rank": 1, "company": "A"}, {"rank": 2, "name": "B", "domain": "b.example", "revenue": 7, "state": "TX"}]}))
    names = ["ordinal", "rank", "name", "domain", "revenue_millions", "employees", "state"]
    firms = sc.read_registry_json(spark, str(tmp_path / "r.json"))
    got = [tuple(r) for r in firms.orderBy("ordinal").select(names).collect()]
    assert got == [(0, 1, "A", "", None, None, ""), (1, 2, "B", "b.example", 7.0, None, "TX")]
    kept = normalize_companies(firms).orderBy("ordinal").select("slug", "domain", "revenue_millions", "state").collect()
    assert [tuple(r) for r in kept] == [("a", "a.com", None, ""), ("b", "b.example", 7.0, "TX")]


def test_job_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc', None), (2, "NA", "")], "id int, title string, x string")
    sc.write_jobs_csv(df, str(tmp_path / "jobs"))
    got = sorted(tuple(r) for r in sc.read_jobs_csv(spark, str(tmp_path / "jobs")).collect())
    assert got == [("1", 'a "q", b\nc', ""), ("2", "", "")]
    assert sc.read_jobs_csv(spark, str(tmp_path / "jobs"), 1).count() == 1


def test_requests_are_rejected_or_fixed(spark, tmp_path):
    rows = [{"url": " https://a.example/x ", "method": "head"}, {"url": "https://a.example", "method": "DELETE"}, {"url": "  "}, {"method": "GET"}, {"url": "junk"}]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = sorted((r["url"], r["method"]) for r in read_requests(spark, str(tmp_path)).collect())
    assert got == [("https://a.example", "GET"), ("https://a.example/x", "HEAD")]
    assert read_requests(spark, str(tmp_path), stream=True).isStreaming


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert run_dir(spark, "x").startswith(named + "/x-")
    assert run_dir(spark, "x") != run_dir(spark, "x")
