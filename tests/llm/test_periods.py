"""Periodic runs against a scan of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from larkspur.llm import periods
from larkspur.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every maximal stretch of each period, with the smallest period of a stretch."""
    best = {}
    for q in range(1, len(words) // 4 + 1):
        start = 0
        while start + q < len(words):
            end = start + q
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            if end - start >= max(6, 4 * q):
                best.setdefault((start, end), q)
            start = max(end - q, start) + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def judged(spark, texts):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, periods string")
    rows = periods.find_runs(docs).collect()
    return {r["doc_id"]: (r["periods"]["n_words"], [tuple(x) for x in r["periods"]["runs"]], r["periods"]["collapsed"]) for r in rows}


def periodic_texts(seed, n):
    """Texts of few words with planted runs of all exponents, nested and side by side."""
    rng = random.Random(seed)
    for _ in range(n):
        words = []
        while len(words) < rng.randint(0, 120):
            root = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17]))]
            words += (root * rng.randint(1, 7))[: rng.randint(1, 60)]
        yield rng.choice([" ", "\n", " \t"]).join(words)


def test_equals_brute_force(spark):
    texts = [None, "", " \n", "a", "a a a a a a", "a a a a a", "a b " * 4, "x a b a b a b a b y", "é b   é b " * 9, *periodic_texts(1, 400)]
    texts += ["a b c d e " * 5000 + "z", " ".join(f"w{k % 37}" for k in range(3000)) + " end", "a " * 3000 + "b " + "a " * 3000]
    got = judged(spark, texts)
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        words = WORD.findall(text or "")
        runs = brute_runs(words) if len(words) < 2000 else None
        assert got[k][0] == len(words)
        if runs is not None:
            assert got[k][1] == runs, text
        assert got[k][2] == collapsed(words, got[k][1])
    assert got[len(texts) - 3][1] == [(0, 25_000, 5)]
    assert got[len(texts) - 2][1] == [(0, 3000, 37)]
    assert got[len(texts) - 1][1] == [(0, 3000, 1), (3001, 3000, 1)]


def test_slices_do_not_matter(monkeypatch):
    texts = [t.encode() for t in periodic_texts(2, 60)]
    together = list(periods.handle(texts))
    assert together == [next(periods.handle([t])) for t in texts]


def test_wavelet_tree_finds_successors():
    rng = np.random.default_rng(3)
    for size in (1, 2, 63, 64, 65, 1000):
        values = rng.permutation(size)
        tree = periods.WaveletTree(values, size)
        low = rng.integers(0, size + 1, 300)
        high = rng.integers(low, size + 1)
        least = rng.integers(0, size + 2, 300)
        want = [min([v for v in values[a:b] if v >= x], default=size) for a, b, x in zip(low, high, least)]
        assert tree.successors(low, high, least).tolist() == want


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    n_dealt = 0
    for r in rows:
        words = WORD.findall(texts[r["doc_id"]] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            n_dealt += 1
        runs = brute_runs(words) if n < 1500 else periods.runs_of(np.unique(words, return_inverse=True)[1], n)
        runs = runs if isinstance(runs, list) else list(zip(*(x.tolist() for x in runs)))
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r["collapsed_sha256"] == sha(collapsed(words, runs))
    assert n_dealt > 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periods.find_runs(docs).count() == 0
