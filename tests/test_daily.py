"""Daily snapshots, places in sort orders, and searches that skip files."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import listings as ls
from larkspur.sources import textindex
from larkspur.sources.snapshots import SNAPSHOT_ROWS, add_snapshot, normalized_listings, seen_listings, snapshot_store, unseen
from tests.test_listings import raw


def snapshots(spark, days, rows):
    """Snapshots that share ids and, where the id is blank, titles."""
    rng = random.Random(2)
    made = []
    for _ in range(days):
        made.append(ls.map_aliases(raw(spark, [
            {"id": rng.choice(["", " ", f"i{rng.randrange(60)}"]), "job_title": rng.choice(["", "t1", "t2", "t3"]), "company_name": rng.choice(["", "c", "d"]),
             "job_location": f"place {rng.randrange(4)}", "url": f"u{rng.randrange(1000)}"} for _ in range(rows)
        ])))
    return made


def test_snapshots_equal_one_pass_over_all(spark, tmp_path):
    days = snapshots(spark, 10, 40)
    store = snapshot_store(spark, str(tmp_path / "store"), days[0].schema)
    for number, day in enumerate(days):
        add_snapshot(store, number, day)
        add_snapshot(store, number, day)  # a second time changes nothing
    for number in (0, 3):
        add_snapshot(store, number, days[5])
    every = [day.withColumn("ordinal", F.col("ordinal") + n * SNAPSHOT_ROWS) for n, day in enumerate(days)]
    whole = every[0]
    for more in every[1:]:
        whole = whole.unionByName(more)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(seen_listings(store)) == rows(ls.dedupe_listings(whole))
    assert rows(normalized_listings(store)) == rows(ls.normalize_listings(ls.dedupe_listings(whole)))
    # Ten snapshots have left two levels of folders.
    assert sorted(f.level for f in store.manifest().folders["seen"]) == [0, 0, 1]
    add_snapshot(store, 10, days[0].limit(0))
    assert rows(seen_listings(store)) == rows(ls.dedupe_listings(whole))


def test_a_snapshot_reads_keys_and_its_own_rows(spark, tmp_path):
    days = snapshots(spark, 2, 30)
    days[1].write.parquet(str(tmp_path / "day"))
    store = snapshot_store(spark, str(tmp_path / "store"), days[0].schema)
    add_snapshot(store, 0, days[0])
    new = unseen(store, spark.read.parquet(str(tmp_path / "day")))
    read = {f.split(str(tmp_path))[1].split("/")[1:3][-1 if "/store/" in f else 0] for f in new.inputFiles()}
    assert read == {"seen", "day"}
    scans = [line for line in new._jdf.queryExecution().executedPlan().toString().splitlines() if "store/seen" in line or "ReadSchema: struct<key:string>" in line]
    assert scans and all("position" not in line for line in scans)


@pytest.mark.parametrize("mode", ["fresh", "score", "pay", "company"])
def test_places_follow_the_sorted_rows(spark, mode):
    """Ties, scores that are no numbers, and rows alike but for their ordinal, over many partitions."""
    rng = random.Random(7)
    rows = [
        {"job_title": "t", "company_name": rng.choice(["Zeta", "alpha", "Äther", "beta"]), "job_base_pay_range": rng.choice(["", "$10 - $20", "$30"]),
         "job_posted_date": rng.choice(["", "2026-01-02", "2026-03-04", "soon"]), "competitiveness_score": rng.choice(["", "x", "1", "2.5"])}
        for _ in range(500)
    ]
    df = ls.normalize_listings(ls.map_aliases(raw(spark, rows)).repartition(7))
    want = [r["ordinal"] for r in ls.sort_listings(df, mode).select("ordinal").collect()]
    got = {r["place"]: r["ordinal"] for r in ls.placed_listings(df, mode).select("place", "ordinal").collect()}
    assert [got[k + 1] for k in range(len(want))] == want and len(got) == 500
    assert ls.placed_listings(df.limit(0), mode).count() == 0


def test_trigrams(spark):
    texts = ["", "ab", "abc", "abcabc", "a😀é b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", textindex.trigrams(F.col("t")).alias("g"))
    got = {r["t"]: r["g"] for r in df.collect()}
    assert got == {t: list(dict.fromkeys(t[k : k + 3] for k in range(len(t) - 2))) for t in texts}


def test_trigrams_of_batches():
    texts = ["", "ab", "abc", "abcabc", "a😀é b", "\0\0\0\0", "\U0010ffff" * 3, "éab", "x\ny"]
    for some in (texts, texts[:2], [], [texts[4]]):
        want = {t[k : k + 3] for t in some for k in range(len(t) - 2)}
        got = textindex.batch_grams(some)
        assert set(got) == want and len(got) == len(want)


def test_searches_skip_files_and_find_the_same(spark, tmp_path):
    rng = random.Random(3)
    names = [f"Company {k:02d}" for k in range(20)]
    words = "lorem ipsum dolor sit amet Größe 😀x consectetur".split()
    rows = [
        {"job_title": " ".join(rng.choices(words, k=3)), "company_name": (name := rng.choice(names)), "job_summary": f"made of quark{name[-2:]} " + " ".join(rng.choices(words, k=9)),
         "job_seniority_level": rng.choice(["a", "b"]), "industries": rng.choice(["x, y", "z"])} for _ in range(600)
    ]
    df = ls.normalize_listings(ls.map_aliases(raw(spark, rows)))
    path = str(tmp_path / "indexed")
    textindex.write_indexed(df, path, file_rows=20)
    total = len(spark.read.parquet(f"{path}/rows").inputFiles())
    for query, chip in [(" QUARK07 ", ""), ("quark1", "lorem"), ("größe 😀x", ""), ("it", ""), ("", ""), ("no such text", ""), ("sit amet", "Company 1")]:
        found = textindex.search_indexed(spark, path, query, chip, seniority="a", industry="y")
        want = ls.search_listings(df, query, "y", "a", chip)
        assert sorted(r["ordinal"] for r in found.collect()) == sorted(r["ordinal"] for r in want.collect()), query
    assert len(textindex.search_indexed(spark, path, "quark07").inputFiles()) <= 4 < 20 < total
    assert textindex.search_indexed(spark, path, "no such text").inputFiles() == []
    assert len(textindex.search_indexed(spark, path, "it").inputFiles()) == total


def test_listings_are_worked_out_once_for_the_index(spark, tmp_path):
    """Dealing by ranges looks at the rows twice, but what they come from runs once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    df = ls.normalize_listings(ls.map_aliases(raw(spark, [{"job_title": f"t{k}", "company_name": f"c{k % 7}"} for k in range(100)])))
    textindex.write_indexed(df.withColumn("title", counted("title")), str(tmp_path / "once"), file_rows=20)
    assert seen.value == 100
    assert [r["title"] for r in textindex.search_indexed(spark, str(tmp_path / "once"), "t42").collect()] == ["t42"]
