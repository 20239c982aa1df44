"""Listing operators against brute force and hand-written rows."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import companies as co
from larkspur.operators import insights as ins
from larkspur.operators import listings as ls
from larkspur.operators.numbering import dealt_positions, with_position
from larkspur.plans import listing_queries
from larkspur.operators.state import job_state, overlay
from larkspur.sources import shards
from larkspur.sources.listings import read_listings_csv, read_listings_json
from larkspur.sources.shards import build_shards, read_page, shard_pagination

NAMES = ["ordinal", *ls.ALIASES]


URL = "https://x.example/l.csv"

def raw(spark, rows):
    full = [{**{n: "" for n in NAMES}, **r, "ordinal": i} for i, r in enumerate(rows)]
    schema = "ordinal long, " + ", ".join(f"{n} string" for n in ls.ALIASES)
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in full], schema)


@pytest.mark.parametrize("bits", [1, 3, 14])
def test_position_is_dense_for_any_spread(spark, bits):
    rng = random.Random(bits)
    values = rng.sample(range(10**6), 200) + [2**40 + x for x in rng.sample(range(1000), 100)] + [-5, -1, 2**62 + 1, 2**62, -(2**61)]
    df = spark.createDataFrame([(v,) for v in values], "o long").repartition(5)
    got = {r["o"]: r["position"] for r in with_position(df, "o", bits=bits).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_dedupe_keeps_the_first(spark):
    rows = [{"id": "1", "job_title": "a"}, {"id": "1", "job_title": "b"}, {"job_title": "t", "company_name": "c"},
            {"job_title": "t", "company_name": "c", "url": "x"}, {"id": " ", "job_title": "t", "company_name": "c"}]
    got = ls.dedupe_listings(raw(spark, rows)).select("ordinal").orderBy("ordinal").collect()
    assert [r[0] for r in got] == [0, 2]


def test_dedupe_with_one_hot_key(spark):
    df = spark.range(30000).select(
        F.col("id").alias("ordinal"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k")
    )
    kept = ls.first_per_key(df.repartition(8), F.col("k"))
    assert kept.count() == 20001
    assert kept.where("k = 'hot'").first()["ordinal"] == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # Each key is cut to one row before the shuffle.
    assert plan.count("WindowGroupLimit") == 2


def test_aliases(spark):
    df = spark.createDataFrame([(1, None, "T", "", "lnk", 3.5)], "ordinal long, job_title string, title string, industries string, apply_url string, score double")
    row = ls.map_aliases(df).first()
    assert (row["job_title"], row["apply_link"], row["industries"], row["competitiveness_score"], row["id"]) == ("T", "lnk", "", "3.5", "")
    assert len(row) == 20


def test_normalize(spark):
    rows = [
        {"job_title": "", "company_name": "x"}, {"id": "7", "job_title": " A  b ", "company_name": "nan", "job_location": "Location: LAX, US"},
        {"job_title": "c", "company_name": "d", "competitiveness_score": "bad", "ingest_utc_date": "2026-01-02", "url": "u"},
        {"job_title": "e", "company_name": "f", "industries": "", "job_industries": "I; J", "country_code": "ca", "apply_link": "al"},
    ]
    got = {r["ordinal"]: r for r in ls.normalize_listings(raw(spark, rows)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1]["id"], got[1]["title"], got[1]["company"], got[1]["city_key"], got[1]["location"]) == ("7", "A b", "", "Los Angeles", "LAX, United States")
    assert (got[2]["id"], got[2]["posted"], got[2]["apply"], got[2]["country"]) == ("job-1", "2026-01-02", "u", "US")
    assert got[2]["score"] != got[2]["score"]
    assert (got[3]["id"], got[3]["industries"], got[3]["country"], got[3]["apply"]) == ("job-2", ["I", "J"], "ca", "al")
    assert "id" not in ls.normalize_listings(raw(spark, rows), with_id=False).columns


def jobs(spark, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append({
            "id": str(i), "job_title": "t", "company_name": rng.choice(["b", "B", "a", "Zed", "é"]),
            "job_location": rng.choice(["Austin", "Chicago", "Queens", "Rome", "Oakland", "LAX"]),
            "job_posted_date": f"2026-0{rng.randint(1, 9)}-01", "competitiveness_score": rng.choice(["1", "2", "x", ""]),
            "job_base_pay_range": rng.choice(["$10k", "5", "", "$7k"]),
        })
    return ls.normalize_listings(raw(spark, rows))


def test_sorts_are_stable(spark):
    df = jobs(spark, 120).cache()
    data = [r.asDict() for r in df.collect()]
    fresh = lambda r: -int(r["posted"][5:7])
    score = lambda r: float("inf") if r["score"] != r["score"] else -r["score"]
    pay = {"$10k": -10000, "5": -5, "": 0, "$7k": -7000}
    keys = {"fresh": lambda r: (fresh(r), r["ordinal"]), "score": lambda r: (score(r), fresh(r), r["ordinal"]),
            "pay": lambda r: (pay[r["pay"]], r["ordinal"])}
    for mode, key in keys.items():
        assert [r["ordinal"] for r in ls.sort_listings(df, mode).collect()] == [r["ordinal"] for r in sorted(data, key=key)]
    names = [r["company"] for r in ls.sort_listings(df, "company").collect()]
    assert list(dict.fromkeys(names)) == ["a", "b", "B", "é", "Zed"]


def test_rails_match_brute_force(spark):
    df = jobs(spark, 400).cache()
    order = [r.asDict() for r in ls.sort_listings(df, "fresh").collect()]
    used, expected = set(), {}
    for place in ("United States", *ls.CITIES):
        hits = [r["id"] for r in order if (place == "United States" or r["city_key"] == place) and r["id"] not in used][:18]
        used.update(hits)
        expected[f"Latest Jobs in {place}"] = hits
    got = {}
    for r in ls.rails(df).orderBy("rail", "rail_position").collect():
        got.setdefault(r["rail"], []).append(r["id"])
    assert got == expected


def test_rails_of_few_rows_and_saved(spark):
    df = jobs(spark, 5)
    assert {r["rail"] for r in ls.rails(df).collect()} == {"Latest Jobs in United States"}
    assert ls.rails(df, saved_only=True).count() == 5
    assert ls.rails(df.limit(0)).count() == 0


def test_search(spark):
    df = jobs(spark, 60)
    assert ls.search_listings(df, need_pay=True).where("pay = ''").count() == 0
    hidden = spark.createDataFrame([("1",), ("2",)], "job_id string")
    assert ls.search_listings(df, hidden=hidden).count() == 58
    assert ls.search_listings(df, saved=hidden).count() == 2
    assert ls.search_listings(df, query="  AUSTIN ").count() == df.where("location = 'Austin'").count()
    assert ls.search_listings(df, chip="Remote").count() == 0


def test_windows_and_pages(spark):
    df = raw(spark, [{"id": str(i), "country_code": ["US", "", "ca"][i % 3]} for i in range(30)])
    ids = lambda d: [r["id"] for r in d.orderBy("ordinal").collect()]
    us = [str(i) for i in range(30) if i % 3 != 2]
    assert ids(ls.slice_window(df, "us", 3, 5)) == us[3:8]
    assert [r["id"] for r in ls.slice_window(df.repartition(5), "us", 7, 9).collect()] == us[7:16]
    assert ids(ls.slice_window(df, "", -4, -5)) == ["0"]
    assert ids(ls.slice_window(df, "us", 18, 0)) == us[18:]
    assert [ls.clamp_size(x) for x in (0, None, -5, 99999, 7)] == [500, 500, 1, 2500, 7]
    row = ls.pagination(df, "US", page=3, per_page=8).first()
    assert (row["total_filtered_rows"], row["total_pages"], row["has_prev"], row["has_next"], row["offset"]) == (20, 3, True, False, 16)
    none = ls.pagination(df.limit(0), "US").first()
    assert (none["total_pages"], none["has_next"]) == (0, False)


def test_page_union_stops_at_the_gap(spark):
    rows = [(i, p, f"{i}") for i, p in enumerate([0, 0, 1, 1, 3, 3])]
    df = spark.createDataFrame(rows, "ordinal long, page long, id string").select("page", "ordinal", "id")
    df = df.withColumns({n: F.lit("") for n in ls.ALIASES if n != "id"})
    assert [r["ordinal"] for r in ls.union_pages(df, "page", 2, 4).collect()] == [0, 1, 2, 3]
    assert ls.union_pages(df.where("page > 0"), "page", 2, 4).count() == 0
    assert ls.union_pages(df.withColumn("id", F.lit("same")), "page", 2, 4).count() == 1


def test_shards_cover_all_rows_once(spark, tmp_path):
    df = raw(spark, [{"id": str(i), "country_code": ["US", "", "ca"][i % 3]} for i in range(100)])
    path = str(tmp_path / "shards")
    meta = build_shards(spark, df.repartition(7), path, URL, "now", "us", 9).first()
    assert (meta["total_filtered_rows"], meta["shard_count"], meta["country_code"], meta["rows_per_shard"]) == (67, 8, "US", 9)
    us = [str(i) for i in range(100) if i % 3 != 2]
    for page in range(1, 10):
        got = [r["id"] for r in read_page(spark, path, URL, page).collect()]
        assert got == us[(page - 1) * 9 : page * 9]
    assert [r["id"] for r in read_page(spark, path, URL, -3).collect()] == us[:9]
    last = shard_pagination(spark, path, URL, 9, 9).first()
    assert (last["shard_index"], last["has_next"], last["per_page_matches_shard"]) == (None, False, True)
    live = read_page(spark, str(tmp_path / "none"), URL, 2, live=df, country="US", per_page=10)
    assert [r["id"] for r in live.collect()] == us[10:20]


def test_rebuild_writes_changed_files_only(spark, tmp_path, monkeypatch):
    """One changed row writes one file of the others; builds that are no longer named go with their files."""
    monkeypatch.setattr(shards, "FILE_SHARDS", 2)
    df = spark.range(100).select(F.col("id").alias("ordinal"), F.lit("US").alias("country_code"), F.when(F.col("id") % 3 > 0, F.lit("t")).alias("job_title"))
    path, folder = str(tmp_path / "shards"), tmp_path / "shards" / "shards"

    def built(rows):
        build = build_shards(spark, rows, path, URL, "now", "US", 10).first()["build"]
        return build, sorted(int(p.name.partition("=")[2]) for p in (folder / build).glob("_file=*"))

    first, files = built(df)
    assert files == [0, 1, 2, 3, 4]
    edited = df.withColumn("job_title", F.when(F.col("ordinal") == 45, "new").otherwise(F.col("job_title")))
    second, files = built(edited)
    assert files == [2]
    assert sorted(tuple(r) for r in shards.read_shards(spark, path, URL).drop("shard_index").collect()) == sorted(map(tuple, edited.collect()))
    third, files = built(edited)
    assert files == [] and read_page(spark, path, URL, 5).count() == 10
    assert {r["job_title"] for r in read_page(spark, path, URL, 5).collect()} == {None, "t", "new"}
    # The first build is gone, but for the files that later ones took over.
    assert sorted(p.name for p in (folder / first).glob("_file=*")) == ["_file=0", "_file=1", "_file=3", "_file=4"]
    assert len(list((tmp_path / "shards" / "meta").glob("of=*"))) == shards.KEEP_BUILDS
    shorter, files = built(edited.where("ordinal < 95"))
    assert files == [4] and shards.read_shards(spark, path, URL).count() == 95
    other, files = built(df.withColumn("ordinal", F.col("ordinal") + 1))
    assert files == [0, 1, 2, 3, 4]
    built(df.withColumn("ordinal", F.col("ordinal") + 2))
    assert not (folder / first).exists() and not (folder / second).exists()
    assert build_shards(spark, df.limit(0), path, URL, "now", "US", 10).first()["total_filtered_rows"] == 0
    assert shards.read_shards(spark, path, URL).count() == 0 == read_page(spark, path, URL, 1).count()


def test_shards_of_sources_and_countries_stay_apart(spark, tmp_path):
    df = raw(spark, [{"id": str(i), "country_code": ["US", "ca"][i % 2]} for i in range(60)])
    path = str(tmp_path / "shards")
    ids = lambda url, page, country=None: [r["id"] for r in read_page(spark, path, url, page, country=country).collect()]
    build_shards(spark, df, path, URL, "now", "US", 10)
    with pytest.raises(FileNotFoundError):
        ids(URL, 1, "CA")
    build_shards(spark, df, path, URL, "now", "CA", 10)
    build_shards(spark, df.where("ordinal < 8"), path, "other", "now", "US", 3)
    assert ids(URL, 2) == [str(i) for i in range(20, 40, 2)] and ids(URL, 2, " ca ") == [str(i) for i in range(21, 41, 2)]
    assert ids("other", 2) == ["6"] and ids(URL, 4) == []
    old = read_page(spark, path, URL, 1)
    build_shards(spark, df.where("ordinal >= 30"), path, URL, "later", "US", 10)
    assert ids(URL, 1) == [str(i) for i in range(30, 50, 2)]
    assert [r["id"] for r in old.collect()] == [str(i) for i in range(0, 20, 2)]  # a reader of the old build still finds it


def test_company_domain_order(spark):
    rows = [{"job_title": "t", "company_name": n, "url": u} for n, u in
            [("Acme", "https://www.jobs.example/1"), ("ACME", ""), ("Over", "bad url"), ("New Group", "")]]
    firms = spark.createDataFrame([(1, "acme", "acme.example"), (2, "Acme", "second.example")], "ordinal long, name string, domain string")
    overrides = spark.createDataFrame([("Over", "over.example"), ("Acme", "no.example")], "name string, domain string")
    got = co.with_company_domain(ls.normalize_listings(raw(spark, rows)), firms, overrides).orderBy("ordinal").collect()
    assert [r["company_domain"] for r in got] == ["jobs.example", "acme.example", "over.example", "new.com"]


def test_registry(spark):
    df = spark.createDataFrame([(5, 0, "", "", ""), (6, 3, "Big Bank", "", "b.example"), (7, 4, "Tesla", "Cars", "")],
                               "ordinal long, rank long, name string, industry string, domain string")
    over = spark.createDataFrame([("Tesla", "tesla.example")], "name string, domain string")
    got = [tuple(r) for r in co.normalize_companies(df, over).orderBy("ordinal").select("rank", "name", "industry", "slug", "domain").collect()]
    assert got == [(1, "Company 1", "Fortune 500", "company-1", "1.com"), (3, "Big Bank", "Financial Services", "big-bank", "b.example"),
                   (4, "Tesla", "Cars", "tesla", "tesla.example")]
    assert co.normalize_companies(df, most=2).count() == 2
    assert co.search_companies(co.normalize_companies(df), "  ").count() == 0
    assert [r["name"] for r in co.search_companies(co.normalize_companies(df), "BANK").collect()] == ["Big Bank"]


def test_state_and_overlay(spark):
    rows = [(1, "save"), (2, "save"), (3, "save"), (1, "applied"), (2, "applied"), (1, "hide"), (2, "hide")]
    df = spark.createDataFrame([("u", "j", a, t) for t, a in rows], "user_uid string, job_id string, action string, ts int")
    assert sorted((r["kind"], r["ts"]) for r in job_state(df).collect()) == [("hidden", 2), ("saved", 3)]
    maps = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2"}, None)], "d map<string,string>, s map<string,string>, p map<string,string>")
    assert overlay(maps, ["d", "s", "p"], "m").first()["m"] == {"a": "1", "b": "2"}


def test_cards(spark):
    rows = [{"job_title": "t", "company_name": "Acme Big", "job_posted_date": "2026-05-01", "achievements": "Employee of the year 2020", "skills": "A;B;C;D;E",
             "certifications": "X;Y;Z", "industries": "I;J", "job_base_pay_range": "$20 Per Hour", "job_location": "Rome"},
            {"job_title": "t", "company_name": "c", "job_posted_date": "soon"}]
    got = ls.job_cards(ls.normalize_listings(raw(spark, rows)), 1777593600000 + 40 * 86400000).orderBy("ordinal").collect()
    assert got[0]["age"] == "1mo" and got[1]["age"] == "5h"
    assert got[0]["tags"] == ["Rome", "$20 /hr", "Full Time", "Employee of th…", "X", "I"]
    assert (got[0]["skill_text"], got[0]["initials"], got[1]["tags"]) == ("A, B, C, D, X, Y", "AB", ["Full Time"])


def test_insights(spark):
    rows = [{"id": str(i), "job_title": "t", "company_name": "c", "skills": "SQL; SQL", "certifications": "CPA" if i else "",
             "job_posted_date": ["2026-01-05", "2026-01-09", "2026-02-01", "soon"][i]} for i in range(4)]
    df = ls.normalize_listings(raw(spark, rows))
    trend = sorted((r["skill"], str(r["month"]), r["n"], r["change"]) for r in ins.skill_trend(df).collect() if r["skill"] == "SQL")
    assert trend == [("SQL", "2026-01-01", 2, None), ("SQL", "2026-02-01", 1, -1)]
    assert ins.job_skill_bridge(df).count() == 7
    share = {(r["column"], r["value"]): r["share"] for r in ins.distribution(raw(spark, rows), ["certifications"]).collect()}
    assert share == {("certifications", "CPA"): 0.75, ("certifications", ""): 0.25}
    assert ins.profile(df).first()["row_count"] == 4
    assert ins.preview(df, "ordinal", 2).count() == 2


def test_a_build_works_out_its_rows_once(spark, tmp_path):
    """The rows are shuffled and written once; digests come from what was written."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    df = raw(spark, [{"id": str(k), "job_title": f"t{k}", "country_code": "US"} for k in range(200)]).repartition(7)
    path = str(tmp_path / "shards")
    for when in ("now", "later"):
        build_shards(spark, df.withColumn("job_title", counted("job_title")), path, URL, when, "US", 10)
        assert shards.read_shards(spark, path, URL).where("job_title = concat('t', id) AND shard_index = floor(ordinal / 10)").count() == 200
    assert seen.value == 400


def test_positions_of_dealt_rows(spark):
    """As with_position, also where order values repeat, are null or far apart."""
    rng = random.Random(4)
    values = [rng.randrange(300) for _ in range(200)] + [rng.randrange(1 << 40) for _ in range(50)] + [-5, None, None]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "ordinal long, k long").repartition(5)
    rows = lambda found: sorted(map(tuple, found.select("ordinal", "k", "position").collect()))
    for bits, size in ((3, 7), (14, 1000)):
        assert rows(dealt_positions(df, "ordinal", size, bits=bits)) == rows(with_position(df, "ordinal", bits=bits))


def test_source_files_grow_in_number(spark, tmp_path):
    """A file is one task's, so more rows make more files, and these stay in the order of the rows."""
    df = spark.range(1000).select(F.col("id").alias("ordinal"), F.concat(F.lit("a\nb"), F.col("id").cast("string")).alias("job_title"))
    path = listing_queries.in_files(df, str(tmp_path / "csv"), file_rows=50)
    assert max(len(f.read_text().splitlines()) for f in (tmp_path / "csv").glob("*.csv")) < 2 * 2 * 50
    read = read_listings_csv(spark, path).orderBy("ordinal")
    assert [r["job_title"] for r in read.collect()] == [f"a\nb{k}" for k in range(1000)]
    packed = spark.range(300).select(F.col("id").alias("page"), F.concat(F.lit('[{"id": "'), F.col("id").cast("string"), F.lit('"}]')).alias("value"))
    path = listing_queries.in_payloads(packed, str(tmp_path / "json"), file_blocks=10)
    assert max(len(f.read_text().splitlines()) for f in (tmp_path / "json").glob("*.txt")) < 2 * 10 + 1
    assert [r["id"] for r in read_listings_json(spark, path).orderBy("ordinal").collect()] == [str(k) for k in range(300)]
