"""Operators over whole corpora: lines, sentences, mixes, searches and the pipeline."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import jaccard, lines, maxscore, mixing, quality, sentences
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in docs], COLUMNS)


def line_docs(seed):
    rng = random.Random(seed)
    pool = [f"line {k}" for k in range(14)] + ["", " ", "\t", " a b" * 25, "\ta " * 50, "a " * 49, "words " * 24]
    block = ["b1", "b2", "", "b3", "b4", "b5", "b6", "b7"]
    docs = [None, "", "\n\n", "b1\nb2", "one"]
    for _ in range(50):
        body = [rng.choice(pool) for _ in range(rng.randint(0, 7))]
        if rng.random() < 0.4:
            body += block[rng.randint(0, 3) : rng.randint(4, 8)] + [rng.choice(pool)]
        docs.append("\n".join(body))
    return list(enumerate(docs + docs[8:14]))


def brute_lines(docs, least=2):
    seen, out = set(), {}
    for i, text in sorted(docs):
        every = (text or "").split("\n")
        full = [k for k, line in enumerate(every) if brute.WORD.search(line)]
        taken = set()
        for p in range(len(full) - least + 1):
            run = tuple(every[k] for k in full[p : p + least])
            if run in seen:
                taken.update(range(p, p + least))
            seen.add(run)
        for p, k in enumerate(full):
            if len(brute.WORD.findall(every[k])) >= 50:
                if every[k] in seen:
                    taken.add(p)
                seen.add(every[k])
        gone = {k for p in taken for k in (range(full[p], full[p + 1]) if p + 1 in taken else [full[p]])}
        runs = sum(p - 1 not in taken for p in taken)
        out[i] = (len(full), len(gone & set(full)), runs, "\n".join(line for k, line in enumerate(every) if k not in gone))
    return out


@pytest.mark.parametrize("seed,least", [(1, 2), (2, 3), (3, 5), (4, 1)])
def test_line_runs(spark, seed, least):
    docs = line_docs(seed)
    got = lines.judge_lines(frame(spark, docs).withColumn("lines", F.lit(0)), least=least).select("doc_id", "lines.*").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_lines(docs, least)


def test_helper_columns_give_way(spark):
    """Columns of the operators' own helper names are data like any others."""
    names = ("_doc", "_tie", "_runs", "_full", "_lines", "_gone", "_copies", "_copy", "_doc_id", "_lang", "_source", "verdict", "limits", "measured")
    docs = frame(spark, [(1, "a b c d e f\nb"), (2, "a b c d e f\nb\nx"), (None, None)])
    docs = docs.withColumns({name: F.lit(k) for k, name in enumerate(names)})
    for keep in (quality.keep_good, lines.drop_repeated_lines, jaccard.keep_one, mixing.take_mix):
        kept = keep(docs)
        assert kept.columns == docs.columns
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in kept.collect())


def test_lines_odd_inputs(spark):
    docs = frame(spark, [(3, "a\nb"), (3, "a\nb"), (None, "a\nb\nc"), (5, "x\na\nb"), (6, None), (7, "a\nb")])
    left = lines.drop_repeated_lines(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in left.collect()) == [(0, "a\nb\nc", 5), (5, "x", 1), (6, None, 0)]
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0


def brute_sentences(docs):
    """{doc_id: (sentences, removed, kept)}"""
    split = []
    for i, text in sorted(docs):
        text = text or ""
        cut, words = [], list(brute.WORD.finditer(text))
        for n, w in enumerate(words):
            if n == 0 or re.search(r"([.!?]|。|！|？)$", words[n - 1][0]) or "\n" in text[words[n - 1].end() : w.start()]:
                cut.append((n, w.start()))
        split.append((i, text, cut, [brute.lower_az(w[0]) for w in words]))
    seen, out = set(), {}
    for i, text, cut, words in split:
        gone = set()
        starts = [n for n, _ in cut] + [len(words)]
        for s in range(len(cut)):
            for e in (s + 1, s + 2):
                if e < len(starts) and (e == s + 2 or starts[e] - starts[s] >= 50):
                    span = e - s, *words[starts[s] : starts[e]]
                    if span in seen:
                        gone.update(range(s, e))
                    seen.add(span)
        ends = [p for _, p in cut[1:]] + [len(text)]
        kept = (text[: cut[0][1]] if cut else text) + "".join(text[p:e] for k, ((_, p), e) in enumerate(zip(cut, ends)) if k not in gone)
        out[i] = (len(cut), len(gone), kept)
    return out


def test_sentence_spans(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("ab cd Ef gh é".split()) for _ in range(rng.randint(1, 12))) + rng.choice([".", "!", "?", "。", "\n", "..", ""]) for _ in range(25)]
    docs = [None, "", " ", "One.", "no end"] + [rng.choice([" ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(1, 15))) for _ in range(60)]
    docs = list(enumerate(docs + docs[10:14]))
    got = sentences.remove_repeats(frame(spark, docs).withColumn("kept", F.lit(1))).collect()
    assert {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["kept"]) for r in got} == brute_sentences(docs)
    assert sentences.remove_repeats(frame(spark, docs).limit(0)).count() == 0


def test_sentences_of_the_given_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sentences.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["kept"]) for r in got} == brute_sentences(docs)


def brute_runs(docs):
    """{doc_id: (sentences, removed)} by looking up every run of sentences that is long enough."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        split = [tuple(brute.WORD.findall(brute.lower_az(s))) for s in re.findall(r"[^.]+\.", text)]
        gone = set()
        for s in range(len(split)):
            for e in range(s + 1, len(split) + 1):
                n = sum(map(len, split[s:e]))
                if n >= 50 or (n >= 16 and e - s >= 2):
                    run = tuple(split[s:e])
                    if run in seen:
                        gone.update(range(s, e))
                    seen.add(run)
        out[i] = (len(split), len(gone))
    return out


def test_every_run_of_sentences(spark):
    rng = random.Random(6)
    sentence = lambda n: " ".join(rng.choice("ab cd Ef gh".split()) + str(rng.randrange(9)) for _ in range(n)) + "."
    pool = [sentence(rng.choice([1, 2, 3, 7, 12, 12, 15, 16, 49, 50, 60])) for _ in range(20)]
    new = lambda: sentence(rng.choice([3, 12]))
    docs = [" ".join([sentence(12), sentence(12), sentence(3)]), pool[0], sentence(50)]
    docs += docs + [" ".join(rng.choice([rng.choice(pool), new()]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for _ in range(25):
        other = docs[rng.randrange(len(docs))].split(". ")
        docs.append(" ".join([new(), *(s.rstrip(".") + "." for s in other[rng.randrange(len(other)) :]), new()]))
    docs += ["One. " * 40, "a. b. " * 20]
    docs = [(i, t.strip()) for i, t in enumerate(docs)]
    got = {r["doc_id"]: r for r in sentences.remove_repeats(frame(spark, docs), least_words=16).collect()}
    assert {i: (r["n_sentences"], r["n_removed"]) for i, r in got.items()} == brute_runs(docs)
    assert got[3]["kept"] == got[5]["kept"] == ""


def leaves(spark, rows):
    return spark.createDataFrame(rows, "domain string, lang string, source string, tokens long, n_docs long")


def test_shortages_go_to_siblings_first(spark):
    rows = [
        ("hub", "en", "a0", 10, 1), ("hub", "en", "b0", 1000, 1), ("hub", "fr", "c0", 1000, 1),
        ("edge", "en", "x", 1000, 1), ("edge", "en", None, 1000, 1),
    ]
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(leaves(spark, rows), 700 / 4010, 1).collect()}
    # 700 tokens: hub 280 and edge 420; hub's en 200 and fr 80; a0 has 10 only, and b0 takes the rest of en's.
    assert got == {("hub", "en", "a0"): 10, ("hub", "en", "b0"): 190, ("hub", "fr", "c0"): 80, ("edge", "en", "x"): 210, ("edge", "en", None): 210}
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(leaves(spark, rows), 1.0, 1).collect()}
    assert got == {(d, la, s): t for d, la, s, t, _ in rows}


def test_mix_spends_its_budget_in_seeded_order(spark):
    docs = spark.createDataFrame([(k, "x" * (4 * (k % 7)), "en", "a0" if k % 3 else "b", 0) for k in range(3000)] + [(9, "x" * 8, None, None, 0)], COLUMNS)
    mixed = mixing.mix(docs, share=0.8, epochs=3).collect()
    assert len(mixed) == 3001
    tokens = sum(r["n_tokens"] for r in mixed)
    spent = sum(r["n_tokens"] * r["n_copies"] for r in mixed)
    assert 0.8 * tokens - 20 < spent <= 0.8 * tokens
    for leaf in {(r["lang"], r["source"]) for r in mixed}:
        copies = {r["n_copies"] for r in mixed if (r["lang"], r["source"]) == leaf}
        assert max(copies) - min(copies) <= 1
    taken = mixing.take_mix(docs, share=0.8, epochs=3)
    assert taken.columns == docs.columns and taken.count() == sum(r["n_copies"] for r in mixed)
    assert mixing.take_mix(docs.limit(0)).count() == 0


def want_top(held, k, step=50):
    found = []
    for n, (query, q) in enumerate(held):
        if query % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for m, (i, v) in enumerate(held) if m != n)[:k]
            found += [(query, rank, i, -s if abs(s) < 1 << 63 else None) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(found, key=repr)


def test_top_k_equals_comparing_everything(spark):
    """Every finite vector takes part: components of 2**40 and 1e300, repeated ids, ties, short and empty vectors."""
    rng = np.random.default_rng(1)
    data = [(k, [float(x) for x in rng.normal(size=6) * (0.2 if k % 3 else 1.0)]) for k in range(300)]
    data += [(300, data[0][1]), (301, None), (302, [0.1, None]), (303, [float("nan")]), (304, [float("inf"), 1.0]), (305, []), (306, [1.0, 2.0])]
    data += [(5, data[5][1]), (5, data[7][1]), (50, data[8][1]), (307, [9000.5] * 6), (350, [-7000.25] * 6), (None, [1.0])]
    data += [(308, [float(1 << 40)] * 6), (400, [1e300] * 6), (401, [-1e300, 1e300]), (402, [1.7e308] * 2), (450, [0.5] * 5 + [-float(1 << 45)])]
    vectors = maxscore.finite_vectors(spark.createDataFrame(data, "id long, x array<double>").repartition(5), "id", "x")
    got = sorted((tuple(r) for r in maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, block=3).collect()), key=repr)
    usable = [(i, x) for i, x in data if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    used = [(i, [math.floor(256 * v) if abs(v) < 1e15 else 256 * int(v) for v in x]) for i, x in usable]
    assert got == want_top(used, 5)
    assert maxscore.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_of_common_scales(spark):
    """Thresholds above zero split the terms; the rows found stay those of comparing everything."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 24))
    data = [(k, [float(x) for x in centres[k % 9] * (k % 4 > 0) + rng.normal(size=24) * 0.3]) for k in range(6000)]
    vectors = maxscore.finite_vectors(spark.createDataFrame(data, "id long, x array<double>").coalesce(2), "id", "x")
    got = sorted((tuple(r) for r in maxscore.top_k(vectors, vectors.where("vec_id % 200 = 0"), 5).collect()), key=repr)
    assert got == want_top([(i, [math.floor(256 * v) for v in x]) for i, x in data], 5, 200)


def test_pipeline(spark):
    """Each stage against its plain version on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "copies", "mix", "pieces"]
    kept, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == docs.columns
        steps[name] = ({r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in kept.collect()})
    before, after = steps["quality"]
    judged = {r["doc_id"]: r["quality"] for r in quality.judge(docs).collect()}
    assert set(after) == {i for i in before if judged[i]["kept"]} and all(after[i] == before[i] for i in after)
    before, after = steps["lines"]
    plain = brute_lines([(i, r["text"]) for i, r in before.items()])
    assert {i: r["text"] for i, r in after.items()} == {i: p[3] for i, p in plain.items() if p[1] < p[0] or not p[0]}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    before, after = steps["copies"]
    parts = brute.components([(i, r["text"]) for i, r in before.items()])
    assert set(after) == {i for i, (_, c) in parts.items() if c == i}
    before, after = steps["mix"]
    assert set(after) <= set(before) and 0 < len(after)
    end = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(end) == set(after)
    assert all(end[i]["decoded_sha256"] == brute.sha(r["text"]) for i, r in after.items())
    assert jaccard.join_documents(docs.limit(0)).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, a long text, further columns; all rows rejected; no rows at all."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    good = [(k, "\n".join(prose(9) for _ in range(5)), "en", f"s{k % 3}", 0) for k in range(60)]
    odd = [(None, prose(30), "en", "s0", 0), (70, prose(30), None, None, None), (71, None, None, None, None), (72, "", "en", "s1", 0)]
    odd += [good[3], good[3], (73, prose(30_000), "en", "s1", 0), (74, good[5][1], "de", "s2", 0)]
    junk = [(k, f"{prose(4)} # # #", "en", "s0", 0) for k in range(40)] + [(41, None, None, None, None)]
    for name, data in (("mixed", good + odd), ("junk", junk), ("empty", [])):
        docs = frame(spark, []).unionByName(spark.createDataFrame(data, COLUMNS)) if data else frame(spark, [])
        docs.withColumn("_tie", F.lit("x")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/mixed").collect()]
    assert set(ids) <= {*range(60), None, 70, 73} and len(ids) > 20
    for _ in range(3):
        assert corpus_pipeline.run(spark, f"{tmp_path}/junk").count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
