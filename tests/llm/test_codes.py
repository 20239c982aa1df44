"""Vector codes against plain k-means in Python integers."""

import hashlib
import math
import random

import numpy as np

from larkspur.llm import codes
from larkspur.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, label, code, error, label_error, digest) of the usable rows, by the definition alone."""
    used = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not used:
        return []
    width = max(1, -(-max(len(r[1]) for r in used) // parts))
    ints = [[codes.whole(x) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in used]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    first = sorted(range(len(used)), key=lambda k: (used[k][0] is None, used[k][0] or 0, used[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(first)), key=lambda e: (away(v[p], books[p][e]), e))
    for _ in range(rounds):
        own = [[near(v, p) for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(first)):
                mine = [v[p] for v, o in zip(cut, own) if o[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    own = [[near(v, p) for p in range(parts)] for v in cut]
    errors = [sum(away(v[p], books[p][o[p]]) for p in range(parts)) for v, o in zip(cut, own)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    fits = lambda n: n if n is not None and n < 1 << 63 else None
    total = {}
    for r, error in zip(used, errors):
        total[r[2]] = None if total.get(r[2], 0) is None or fits(error) is None else total.get(r[2], 0) + error
    return sorted(
        ((r[0], r[2], bytes(o).hex(), fits(e), fits(total[r[2]]), digest) for r, o, e in zip(used, own, errors)), key=repr
    )


def compressed(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return sorted((tuple(r) for r in codes.compress(df).collect()), key=repr)


def some_rows(seed, n, dim, size=1.0):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, size) for _ in range(dim)], rng.choice([None, 1, 2])) for k in range(n)]


def test_equals_plain_k_means(spark):
    rows = some_rows(1, 150, 16)
    rows += [(7, rows[7][1], 1), (7, rows[8][1], None), (None, rows[9][1], 2), (500, None, 1), (501, [0.0] * 15 + [None], 1)]
    rows += [(502, [float("nan")] + [0.0] * 15, 1), (503, [float("inf")] * 16, 1)]
    assert compressed(spark, rows) == brute(rows)


def test_ties_and_few_rows(spark):
    """Coarse values tie in distance and in sum; fewer rows than entries make a small codebook."""
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1, 0, 1]) / 4096 for _ in range(16)], k % 2) for k in range(60)]
    assert compressed(spark, rows) == brute(rows)
    assert compressed(spark, rows[:3]) == brute(rows[:3])
    assert compressed(spark, [(1, [], None)]) == brute([(1, [], None)])
    assert compressed(spark, []) == [] == compressed(spark, [(1, None, 1)])


def test_large_components_and_ragged_vectors(spark):
    """Sums and distances beyond 64 bits stay exact; an error that no long holds is null."""
    rows = some_rows(3, 40, 16) + [(k, v, None) for k, v, _ in some_rows(4, 10, 11, 1e5)]
    rows = [(n, v, label) for n, (_, v, label) in enumerate(rows)]
    rows += [(100, [1e308] * 16, 1), (101, [-1e300] + [2.0**60] * 15, 2), (102, [3e9] * 16, 1), (103, [5e-324] * 16, 2)]
    assert compressed(spark, rows) == brute(rows)


def test_search_ends_early_and_is_exact():
    rng = np.random.default_rng(5)
    entries = rng.integers(-9000, 9000, (16, 8)).tolist()
    parts = rng.integers(-9000, 9000, (500, 8))
    index, distance = codes.Codebook(entries, 8).nearest(parts)
    every = ((parts[:, None] - np.array(entries)[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_clashing_columns_play_no_part(spark):
    rows = some_rows(6, 20, 8)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, code int, x int, of_label int")
    assert sorted((tuple(r) for r in codes.compress(df).collect()), key=repr) == brute(rows)


def test_equals_sql_at_two_sizes(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        assert compare(spark, connect(sf), "op13_vector_codes", QUERIES["op13_vector_codes"], ORACLES["op13_vector_codes"], sf) is None
