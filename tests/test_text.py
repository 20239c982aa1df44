"""Scalar rules on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import forum as fo
from larkspur.functions import requests as rq
from larkspur.functions import text as tx
from larkspur.operators.companies import infer_industry


def run(spark, rule, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in rows.select("i", rule(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, rule, cases):
    assert run(spark, rule, [c[0] for c in cases]) == [c[1] for c in cases]


def test_clean(spark):
    check(spark, tx.clean, [
        ("  a \t\r\n b  ", "a b"), ("NaN", ""), (" nan ", "nan"), (None, ""), ("x 　y", "x y"), ("nan\n", "nan"),
        ("é  è ", "é è"), ("plain", "plain"),
    ])


def test_clean_location(spark):
    check(spark, tx.clean_location, [
        ("Location:  Austin, TX, US", "Austin, TX, United States"), ("Brooklyn, NY, US, 11201", "Brooklyn, NY, United States"),
        ("location: Paris", "Paris"), ("Columbus, USA", "Columbus, USA"), ("X,us", "X, United States"),
    ])


def test_split_tags(spark):
    check(spark, tx.split_tags, [
        ("A; b, C, d;;", ["A", "b", "C, d"]), ("", []), (None, []), (";".join("abcdefghijklm"), list("abcdefghij")),
        ("Go,Rust", ["Go,Rust"]), ("x, 3d", ["x", "3d"]),
    ])


def test_city_key(spark):
    check(spark, tx.city_key, [
        ("LAX area", "Los Angeles"), ("Queens", "New York"), ("Palo Alto", "Bay Area"), ("CHICAGO", "Chicago"),
        ("Austin", "Austin"), ("Berlin", "United States"), ("Chicago or New York", "New York"),
    ])


def test_pay_max(spark):
    check(spark, tx.pay_max, [
        ("$120,000 - $95.5k/yr", 95500.0), ("", 0.0), (None, 0.0), ("12.50 per hour", 12.5), ("$1K to $2K", 2000.0), ("none", 0.0),
    ])
    check(spark, lambda c: tx.pay_max(c, commas=True), [("$120,000 - $95.5k/yr", 120000.0), ("1,2", 2.0)])


def test_numbers(spark):
    got = run(spark, tx.to_number, ["", None, " 7 ", "1e3", "-.5", "abc", "Infinity", "1d", "NaN"])
    assert got[:5] == [0.0, 0.0, 7.0, 1000.0, -0.5]
    assert got[6] == float("inf")
    assert all(x != x for x in (got[5], got[7], got[8]))


def test_dates(spark):
    check(spark, tx.freshness, [
        ("2026-05-01", 1777593600000), ("2026-05-01T01:00:00Z", 1777597200000), ("2026-05-01 01:00:00", 1777597200000),
        ("2026-05-01T01:00:00.5+01:00", 1777593600500), ("May 1, 2026", 1777593600000), ("September 12 2025", 1757635200000),
        ("5/1/2026", 1777593600000), ("soon", 0), ("", 0), (None, 0), ("2026-13-45", 0), ("Mayday 1, 2026x", 0),
    ])


def test_slug_and_domain(spark):
    check(spark, tx.slug, [("AT&T Inc.", "at-and-t-inc"), ("--A  b--", "a-b"), (None, "")])
    check(spark, tx.domain_guess, [("The Acme Group, LLC", "acme.com"), ("A&B Industries", "aandbindustries.com")])
    check(spark, lambda c: tx.domain_guess(c, tx.REGISTRY_STOP_WORDS), [("A&B Industries", "aandb.com"), ("Acme LLC", "acmellc.com")])


def test_host(spark):
    check(spark, tx.host_of_url, [
        ("https://WWW.Site.example:8080/a b?q#f", "site.example"), ("http://user:pw@h.example", "h.example"), ("not a url", ""),
        ("", ""), (None, ""), ("mailto:a@b.example", ""), ("ftp://files.example/x", "files.example"), ("/relative", ""),
        ("https://bad host/x", ""), ("https:\\\\h.example\\p", "h.example"), ("  https://h.example  ", "h.example"),
    ])


def test_card_texts(spark):
    long = "This is a sentence that is long enough. Then more."
    check(spark, lambda c: tx.first_sentence(c, 120), [(long, "This is a sentence that is long enough."), ("Short. One", "Short. One")])
    check(spark, lambda c: tx.snippet(c, 10), [("123456789 abc", "123456789…"), ("1234567890", "1234567890")])
    check(spark, tx.initials, [("acme big corp", "AB"), ("", "?"), (None, "?")])


def test_forum_text(spark):
    check(spark, fo.clean_forum_text, [
        ("a  \n\n \n b\t\tc  ", "a\n b c"), ("\n\n x", "x"), (None, ""), (" \n ", ""), ("a\r\nb", "a\nb"), ("a  \nb", "a\nb"),
    ])
    check(spark, lambda c: fo.clean_forum_text(c, 3), [("abcdef", "abc")])
    check(spark, lambda c: fo.age_label(c.cast("long"), 10_000_000_000), [
        ("9999999999", "just now"), ("9999700000", "5 min ago"), ("9900000000", "27 hr ago"), ("9000000000", "11 days ago"),
        ("99990000000", "just now"),
    ])


@pytest.mark.parametrize("agent,platform,bot,device", [
    ("Mozilla/5.0 (compatible; Googlebot/2.1)", "", "googlebot", "compatible; Googlebot/2.1"),
    ("Yahoo! Slurp", "", "slurp", "unknown"),
    ("slurper", "", "other-crawler", "unknown"),
    ("YANDEX images", None, "yandexbot", "unknown"),
    ("my-Preview-tool", '"Windows"', "other-crawler", "Windows"),
    ("plain Android x Mobile", '"unknown"', None, "mobile"),
    ("an iPad here", "", None, "tablet"),
    ("X11 thing (unknown)", "", None, "desktop"),
    ("", "", None, "unknown"),
    ("ua (  a   b )", ' "  " ', None, "a b"),
])
def test_agents(spark, agent, platform, bot, device):
    df = spark.createDataFrame([(agent, platform)], "ua string, p string")
    row = df.select(rq.detect_crawler(F.col("ua")).alias("b"), rq.device(F.col("ua"), F.col("p")).alias("d")).first()
    assert (row["b"], row["d"]) == (bot, device)


def test_addresses_and_countries(spark):
    df = spark.createDataFrame(
        [(" , x", "unknown", "9.9.9.9"), ("1.1.1.1, 2.2.2.2", "", ""), (None, None, None)], "a string, b string, c string"
    )
    cols = [F.col(c) for c in "abc"]
    assert [r[0] for r in df.select(rq.client_ip(*cols)).collect()] == ["9.9.9.9", "1.1.1.1", "unknown"]
    df = spark.createDataFrame([("usa", " de "), ("", ""), ("Fr", "us")], "a string, b string")
    assert [r[0] for r in df.select(rq.country(F.col("a"), F.col("b"))).collect()] == ["DE", "ZZ", "FR"]


def test_referrer_and_tracking(spark):
    own = "https://jobs.example/x"
    df = spark.createDataFrame(
        [("https://Search.example/q",), ("https://jobs.example/",), ("https://m.jobs.example/",), ("https://xjobs.example/",), ("nope",), (None,)],
        "r string",
    )
    got = [r[0] for r in df.select(rq.external_referrer(F.col("r"), F.lit(own))).collect()]
    assert got == ["search.example", None, None, "xjobs.example", None, None]
    rows = [("get", own), ("POST", own), ("HEAD", "https://j.example/.netlify/f"), ("GET", "https://j.example/usage-dashboard/"),
            ("GET", "https://j.example/a?p=/.netlify/"), ("GET", "bad")]
    df = spark.createDataFrame(rows, "m string, u string")
    assert [r[0] for r in df.select(rq.is_trackable(F.col("m"), F.col("u"))).collect()] == [True, False, False, False, True, False]


def test_industry(spark):
    check(spark, infer_industry, [("Visa", "Financial Services"), ("Delta Air", "Aerospace / Defense"), ("Acme", "Fortune 500"),
                                  ("Farm Mutual", "Insurance"), ("Apple Bank", "Financial Services")])
