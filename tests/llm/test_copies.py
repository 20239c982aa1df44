"""Operators that find copies, against comparisons of everything with everything."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import jaccard, suffix
from larkspur.llm.components import components
from larkspur.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def frame(spark, docs):
    data = [(i, t, "en", f"s{(i or 0) % 3}", 0) for i, t in docs]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


def made_docs(seed, families=12, copies=30):
    """Families of edited copies with common passages, exact copies, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 3) + rng.choice("xyz")
    passage = [word() for _ in range(40)]
    texts = [None, "", " \n", "a", "A", "a b c d", "A B\tC\nd", "a b c d e", "a b c d e", "é ü", "x " * 90]
    for f in range(families):
        base = [word() for _ in range(rng.choice([6, 15, 22, 40, 90, 300]))]
        if f % 3 == 0:
            base = base + passage
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                k = rng.randrange(len(t))
                t[k : k + rng.choice([0, 1])] = [word()]
            texts.append((" " if rng.random() < 0.8 else "\n").join(t))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    docs = made_docs(seed)
    got = jaccard.join_documents(frame(spark, docs).withColumn("n", F.lit(1))).collect()
    want = brute.components(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len(got) == len(docs)


def test_jaccard_on_the_given_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op2_jaccard_join"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(docs)


def test_jaccard_odd_inputs(spark):
    docs = frame(spark, [(5, "a b c"), (3, "A b C"), (3, "A b C"), (None, "a b c"), (7, None)])
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(docs).collect())
    assert got == [(-1, 1, 3), (3, 1, 3), (3, 1, 3), (5, 1, 3), (7, 0, 7)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 3, 7]
    assert jaccard.join_documents(docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (300, 300), (None, 1)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 300}


def byte_docs(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    parts = [text(rng.choice([99, 100, 101, 130, 250, 700])) for _ in range(12)] + ["ab" * 120, "x" * 400]
    docs = [None, "", "x" * 99, "x" * 100, "x" * 101, "é" * 80]
    for _ in range(60):
        docs.append("".join(rng.choice([text(rng.randint(0, 150)), rng.choice(parts), rng.choice(parts)]) for _ in range(rng.randint(1, 6))))
    docs += rng.sample(docs, 8)
    return list(enumerate(docs))


def removed(df):
    rows = df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("d")).collect()
    return {r["doc_id"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("seed", [3, 4])
def test_removed_bytes(spark, seed):
    docs = byte_docs(seed)
    assert removed(suffix.remove_repeats(frame(spark, docs))) == brute.removed_bytes(docs)


def test_removed_bytes_of_the_given_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op4_suffix_dedup"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == brute.removed_bytes(docs)


def test_a_passage_in_many_surroundings_is_no_repeat(spark):
    """Too short a passage to be removed; its grams are sampled in each document, with other bytes around them."""
    rng = random.Random(11)
    passage = f"{rng.getrandbits(320):080x}"
    docs = [(i, f"{rng.getrandbits(400):0100x}{passage}{rng.getrandbits(400):0100x}") for i in range(40_000)]
    assert suffix.remove_repeats(frame(spark, docs)).where("n_removed > 0").count() == 0


def test_a_hot_passage_sends_one_sample_per_batch():
    """A passage in a third of the documents, and one long text of one byte, stay far below their number of samples in each shard."""
    rng = random.Random(12)
    passage = f"{rng.getrandbits(1600):0400x}"
    texts = [f"{rng.getrandbits(800):0200x}" + (passage if k % 3 == 0 else "") for k in range(3000)] + ["x" * 50_000]
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts)]
    made = list(suffix.sample_rows(32)(iter([pa.RecordBatch.from_arrays(columns, names=["doc", "tie", "text"])])))
    codes: dict[bytes, int] = {}
    n_known = 0
    for row in (r for batch in made for r in batch.to_pylist()):
        more = np.frombuffer(row["more"], np.uint8)
        n_known += int((more >= suffix.KNOWN).sum())
        for code in np.frombuffer(row["code"], np.uint64)[more < suffix.KNOWN]:
            codes[code] = codes.get(code, 0) + 1
    assert max(codes.values()) <= -(-len(texts) // suffix.MOST_DOCS) and n_known > 1000 + 40_000
    sizes = [sum(len(r["code"]) // 8 for batch in made for r in batch.to_pylist() if r["shard"] == s) for s in range(32)]
    assert max(sizes) < 2 * sorted(sizes)[16]


def test_removed_bytes_of_a_hot_gram(spark):
    """More samples of one gram than HOT, among them pairs that share 100 bytes and more, and rarer ones."""
    rng = random.Random(14)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, tail, rare = text(60), text(90), text(80)
    docs = [text(rng.randrange(120)) + passage + tail[: rng.randrange(90)] + text(60) for _ in range(2 * suffix.HOT)]
    docs += [text(60) + rare + tail[: rng.randrange(90)] + text(50) for _ in range(100)]
    assert removed(suffix.remove_repeats(frame(spark, list(enumerate(docs))))) == brute.removed_bytes(list(enumerate(docs)))


def test_open_runs_are_sent_as_bytes():
    """One open run of 60 stretches takes about its 159 bytes, not a fingerprint of each stretch."""
    rng = random.Random(13)
    texts = [f"{rng.getrandbits(1600):0400x}" for _ in range(500)]
    columns = [pa.array(range(500), pa.int64()), pa.array([0] * 500, pa.int64()), pa.array(texts)]
    columns += [pa.array([[k]] * 500, pa.list_(pa.int64())) for k in (100, 159)] + [pa.array([[i % 4] for i in range(500)], pa.list_(pa.int32()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc", "tie", "text", "firsts", "lasts", "goes"])
    made = pa.Table.from_batches(list(suffix.open_rows(4)(iter([batch]))))
    assert made.nbytes < 200 * 500
    got = [suffix.scan_open(made.slice(k, 1)).num_rows for k in range(4)]
    assert made.num_rows == 4 and got == [0] * 4


def test_levels_stay_few():
    levels = suffix.Levels()
    for k in range(64):
        codes = np.arange(k * 10, k * 10 + 10, dtype=np.uint64)
        assert not levels.known(codes).any()
        levels.add(codes, np.arange(10))
        assert len(levels.arrays) <= 8
    assert levels.known(np.arange(650, dtype=np.uint64)).sum() == 640 and len(levels.all()[0]) == 640


def test_removed_bytes_odd_inputs(spark):
    long = "0123456789" * 11
    docs = frame(spark, [(2, long), (2, long), (1, "q" + long), (None, long[:105]), (3, None)]).withColumn("doc", F.lit(1))
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(docs).collect())
    assert got == [(0, 105, 0, 0), (1, 111, 110, 1), (2, 110, 110, 1), (2, 110, 110, 1), (3, 0, 0, 0)]
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_jaccard_of_frequent_tokens(spark):
    """More copies than a rare token may have, so that only combinations find them, beside sets that nearly match."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(700):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            k = rng.randrange(len(t))
            t[k : k + 1] = [rng.choice(["", f"u{i}", f"v{rng.randrange(3)}"])]
        docs.append((i, " ".join(t + (["tail", str(rng.randrange(4))] if rng.random() < 0.5 else []))))
    got = jaccard.join_documents(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(docs)


def edited_copies(seed, n, odd=True):
    """Copies of one text with so many edits that most of them are linked with no other; odd ones are copies of copies, cut short or
    share words."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(110)]
    docs = []
    for i in range(n):
        t = list(docs[rng.randrange(len(docs))][1].split()) if odd and docs and i % 9 == 0 else list(base)
        for j in range(rng.choice([0, 1, 2, 3, 4, 4, 5])):
            k = rng.randrange(len(t))
            t[k : k + rng.choice([0, 1, 1])] = rng.choice([[f"u{i}_{j}"], [f"v{rng.randrange(9)}"] if odd else [f"v{i}_{j}"], []])
        docs.append((i, " ".join(t[: -rng.randrange(1, 20)] if odd and i % 7 == 0 else t)))
    return docs


def test_jaccard_compares_few_pairs_of_edited_copies(spark, monkeypatch):
    docs = edited_copies(5, 400, odd=False)
    compared = []

    def counted(pairs, sets, verify=jaccard.verified):
        compared.append(pairs.count())
        return verify(pairs, sets)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = jaccard.join_documents(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(docs)
    assert sum(compared) < 15 * len(docs)


@pytest.mark.parametrize(("seed", "rounds"), [(6, 4), (7, 1)])
def test_jaccard_of_groups_split_often(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(jaccard, "SMALL", 0)
    monkeypatch.setattr(jaccard, "MOST_ROUNDS", rounds)
    docs = edited_copies(seed, 150) + [(1000 + i, t) for i, t in made_docs(seed, 6, 15)]
    got = jaccard.join_documents(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(docs)


def kept_lines(seed, n):
    """Copies of one text that keep some of its lines, with edits: each two have hundreds of shingles in common, few are linked."""
    rng = random.Random(seed)
    lines = [[f"l{k}w{j}" for j in range(30)] for k in range(7)]
    docs = []
    for i in range(n):
        t = [w for k in sorted(rng.sample(range(7), rng.choice([2, 3, 4, 5]))) for w in lines[k]]
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(40)}"
        docs.append((i, " ".join(t)))
    return docs


def test_jaccard_splits_no_groups_of_unlike_sets(spark, monkeypatch):
    docs = kept_lines(15, 240)
    made = []

    def counted(df, name, store=jaccard.stored):
        out = store(df, name)
        if name in ("rest", "signed"):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    got = jaccard.join_documents(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(docs)
    assert sum(made) < 15 * len(docs)


@pytest.mark.parametrize(("wide", "rounds"), [(0, 4), (20, 2)])
def test_jaccard_of_unlike_sets_split_all_the_same(spark, monkeypatch, wide, rounds):
    monkeypatch.setattr(jaccard, "SMALL", 0)
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "MOST_ROUNDS", rounds)
    docs = kept_lines(16, 120) + [(1000 + i, t) for i, t in edited_copies(17, 80)]
    got = jaccard.join_documents(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(docs)


def test_sketches_tell_no_more_differences_than_there_are(spark):
    rng = random.Random(18)
    sets = [{rng.randrange(1 << 62) for _ in range(rng.choice([0, 1, 30, 900]))} for _ in range(6)]
    sets += [s | {k} for k, s in enumerate(sets)]
    rows = [(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets)]
    bits = spark.createDataFrame(rows, "i int, tokens binary").select("i", jaccard.sketch("tokens").alias("bits")).collect()
    for x in bits:
        for y in bits:
            apart = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(x["bits"], y["bits"]))
            differ = len(sets[x["i"]] ^ sets[y["i"]])
            assert apart <= differ and (differ > 1 or apart == differ)
