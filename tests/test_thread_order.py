"""Display order and depth of comments by list ranking."""

import random

from larkspur.operators import threads as th

SCHEMA = "id long, post_id long, parent_id long, created_ms long, status string"


def brute(rows):
    """(post, depth, place) of each reachable comment by walking the tree; the others are missing."""
    active = {r[0]: r for r in rows if r[4] == "active"}
    below = {}
    for r in active.values():
        owner = ("c", r[2]) if r[2] in active else ("p", r[1])
        below.setdefault(owner, []).append((r[3], r[0]))
    found = {}
    for kind, post in list(below):
        if kind == "p":
            stack, n = [(0, x) for x in sorted(below["p", post], reverse=True)], 0
            while stack:
                depth, (_, cid) = stack.pop()
                n += 1
                found[cid] = (post, depth, n)
                stack += [(depth + 1, x) for x in sorted(below.get(("c", cid), []), reverse=True)]
    return found


def placed(spark, rows):
    out = th.thread_order(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r["id"] for r in out}) == len(out)
    return {r["id"]: (r["root_post_id"], r["depth"], r["place"]) for r in out if not r["in_cycle"]}, {r["id"] for r in out if r["in_cycle"]}


def test_random_trees_with_ties_and_cycles(spark):
    rng = random.Random(9)
    rows = []
    for cid in range(600):
        parent = rng.choice([None, rng.randrange(600), rng.randrange(max(cid, 1)), cid if rng.random() < 0.05 else None])
        rows.append((cid, rng.randrange(12), parent, rng.randrange(5) * 50_000_000, rng.choice(["active"] * 6 + ["removed"])))
    got, cyclic = placed(spark, rows)
    want = brute(rows)
    assert got == want
    assert cyclic == {r[0] for r in rows if r[4] == "active"} - set(want) and cyclic


def test_a_long_chain_and_a_wide_comment(spark):
    """A chain of 100,000 replies and a comment with 20,000 of them, in rows of constant width."""
    chain = [(k, 1, k - 1 if k else None, 1000, "active") for k in range(100_000)]
    wide = [(200_000, 2, None, 0, "active")] + [(200_001 + k, 2, 200_000, (k * 7919 % 20_000) * 100_000, "active") for k in range(20_000)]
    got, cyclic = placed(spark, chain + wide)
    assert not cyclic
    assert all(got[k] == (1, k, k + 1) for k in range(100_000))
    order = sorted(wide[1:], key=lambda r: r[3])
    assert [got[r[0]] for r in order] == [(2, 1, k + 2) for k in range(20_000)]


def test_same_as_paths_and_empty(spark):
    rows = [(1, 1, None, 5, "active"), (2, 1, 1, 6, "active"), (3, 2, 2, 4, "active"), (4, 1, None, 5, "active"), (5, 1, 9, 1, "active"), (6, 1, 6, 1, "active")]
    df = spark.createDataFrame(rows, SCHEMA)
    paths = {r["id"]: (r["root_post_id"], r["depth"]) for r in th.thread_paths(df).where("NOT in_cycle").collect()}
    got, cyclic = placed(spark, rows)
    assert {k: v[:2] for k, v in got.items()} == paths and cyclic == {6}
    assert th.thread_order(df.limit(0)).count() == 0
    only_first = spark.createDataFrame([(1,)], "id long")
    assert {r["id"] for r in th.thread_order(df, only_first).collect()} == {1, 2, 4, 5, 6}
