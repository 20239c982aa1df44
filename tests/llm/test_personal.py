"""Personal data: base patterns against plain searches, messages against enumeration, added spans."""

import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import personal
from larkspur.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 16 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, *m.span()))
    return found


def test_base_equals_plain_search():
    rng = random.Random(4)
    pieces = ["a@b.c", "@", ".", "-", "_", "+1", " ", "(", ")", "1.2.3.4", "255", "256.1.1.1", "4111 1111 1111 1111", "4111-1111", "0", "12345678", "é", "x.y", "%"]
    texts = ["", "a@b.c_d@e.f", "a@b@c.d", "1.2.3.4.5.6.7.8", "0001.02.3.4", "+1 (663) 555-6869 (", "4" * 20, "٣@b.c 1２3.4.5.6"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for text in texts:
        assert [(personal.KINDS[k], a, b) for k, a, b in personal.base_spans(text)] == plain_spans(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 1_000_000, "1." * 500_000, "+1" + " " * 1_000_000, "a@" * 500_000, "é" * 1_000_000 + "7"):
        personal.Graph(text)


def test_messages_equal_enumeration_on_trees():
    rng = np.random.default_rng(1)
    w = personal.Weights(rng.normal(size=(personal.FEATURES, 5)), rng.normal(size=(5, 5)), (lambda x: x + x.T)(rng.normal(size=(5, 5))))
    codes = rng.integers(0, np.prod(list(personal.FORM.values())), 5)
    labels = np.array([0, 0, 3, 0, 0])
    edges, is_skip = np.array([(0, 1), (2, 3), (1, 3), (3, 4)]), np.array([False, False, True, True])
    own = personal.form_vectors(codes) @ w.of_form
    p = np.zeros((5, 5))
    for y in itertools.product(range(5), repeat=5):
        if y[2] == 3:
            energy = sum(own[k, y[k]] for k in range(5) if k != 2)
            energy += sum((w.of_skip if s else w.of_chain)[y[a], y[b]] for (a, b), s in zip(edges, is_skip))
            for k in range(5):
                p[k, y[k]] += np.exp(energy)
    p /= p.sum(axis=1, keepdims=True)
    assert np.abs(personal.beliefs(codes, labels, edges, is_skip, w) - p).max() < 1e-3


def test_beliefs_do_not_depend_on_the_group():
    texts = [f"call +1 (663) 555-68{k:02d} or 663.555.68{k:02d} on {k} May, a{k}@b.org" for k in range(30)]
    graphs = [personal.Graph(t) for t in texts]
    counts = {}
    for g in graphs:
        for key in personal.neighbours(g):
            counts[key] = counts.get(key, 0) + 1
    w = personal.fit(np.array([(*k, n) for k, n in counts.items()], np.int64))
    assert personal.added_spans(graphs, w) == [personal.added_spans([g], w)[0] for g in graphs]


def letter(rng, k):
    """A letter with its writer's number, card and mail, and one more mention of each in another form."""
    number = f"555-{rng.randint(1000, 9999)}"
    filler = lambda n: " ".join(rng.choice(["the", "of", "rain", "in", "2019", "42", "spain", "room", "7"]) for _ in range(n))
    text = f"{filler(30)} +1 (663) {number} or {filler(30)} w{k}x@mail.example.com {filler(20)}"
    return text, number


def test_repeats_in_another_form_are_added(spark):
    rng = random.Random(7)
    data, wanted = [], {}
    for k in range(300):
        text, number = letter(rng, k)
        if k % 3 == 0:
            wanted[k] = f"663.{number}"
            text += f" again {wanted[k]} bye"
        data.append((k, text))
    data += [(300 + k, f"plain {k}.555-1234 and 2019, 2019 and room 42") for k in range(9)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("personal", F.lit(1))
    found = {r["doc_id"]: r for r in personal.find_personal(docs).collect()}
    assert len(found) == len(data)
    hit = 0
    for k, text in data:
        spans = found[k]["personal"]
        assert [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]] == plain_spans(text or "")
        added = [(s["kind"], text[s["start"] : s["end"]]) for s in spans if not s["base"]]
        hit += added == [("phone", wanted[k])] if k in wanted else 0
        assert k in wanted or not added  # clean documents are left alone
    assert hit >= 0.9 * len(wanted)


def test_query_equals_plain_search(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in base) for k in PLAIN]
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(r["spans"].split(","))


def test_empty_and_unmatched_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert personal.find_personal(empty).count() == 0
    plain = spark.createDataFrame([(1, "room 42"), (1, "room 42"), (None, None)], "doc_id long, text string")
    assert [r["personal"] for r in personal.find_personal(plain).collect()] == [[], [], []]
