"""Jaccard join of word shingles by token-combination prefixes.

Tokens are hashed shingles. Documents with one set of tokens are one set. The steps, all over packed arrays that Spark
shuffles:

1. Every token of every set goes to its token bucket, which finds the tokens that at least two sets hold, and how many
   sets hold each. Tokens of one set alone cannot be shared; they only use up prefix positions.
2. The shared tokens go back to their sets. A set with too few of them has no partner. The others order their tokens by
   frequency, then value, and take the prefix that must meet any partner's prefix. Rare tokens are indexed alone.
   Frequent tokens are dealt to classes by hash; the prefix is extended by one token per class, so that some class
   holds two shared tokens, and two-token combinations of each class are indexed. Each signature carries how many tokens
   can be shared if it is the first that two sets share, which bounds the similarity.
3. Sets with a common signature are candidates. Each group is first compared with one leader, the member with the fewest
   tokens of its own. Groups whose members are then in one component are done. In the others, all pairs between the
   largest component and the rest, and among the rest, are compared, if the rest has SMALL members at most: the pairs are so
   many times the members. So they are in larger groups, up to WIDE, whose sets are mostly unlike: a few members tell by sketches
   of SKETCH_BITS how many others each is like, and only pairs whose sketches allow a link are compared.
4. The other groups are split by what their members do not have in common with the leader. A set that has under 4/5 of its tokens
   from the leader must share others with each partner; prefixes of those are indexed. Of two sets that both have 4/5 from it, a
   known number of differences from the leader must be the same; prefixes of those, what the leader has last, are indexed.
   Either prefix has about a quarter of the set's tokens at most. Leaders are chosen by what holds for a set in all groups, so that
   groups of much the same members are split once. The groups found so are treated as in 3, again with a leader each.
   After MOST_ROUNDS splits, what is still open is compared in pairs.
5. Candidates are verified on all their shared tokens. Verified links give the components.

Tokens are compared by 40 bits beside the bucket number, sets by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from larkspur.llm import arrays as A
from larkspur.llm.components import components, free_names
from larkspur.session import stored

SIZE = 5
#: Link: 100 * intersection >= 80 * union, or 9 * intersection >= 4 * (sum of both sizes).
#: Tokens in one bucket, about; a bucket is one task's array.
BUCKET_TOKENS = 2_000_000
LEAST_BUCKETS = 32
#: Tokens held by more sets are frequent.
RARE = 256
#: Sets from so many tokens on use combinations; one class for so many tokens.
COMBINED_FROM = 20
CLASS_TOKENS = 8
#: Open groups with more sets outside their largest component are split by differences from their leader, so many times at most, if
#: some PROBES of these sets may each be linked with more than so many others, or if they are more than WIDE.
SMALL = 32
WIDE = 2000
MOST_ROUNDS = 4
PROBES = 16
SKETCH_BITS = 1024
#: Documents that one packed row names at most; it bounds the arrays of a task, too.
MOST_SETS = 2048
#: So much text at most, but for a longer single one.
MOST_BYTES = 6_000_000


def bands(most: int = 1 << 40) -> np.ndarray:
    """Edges of size bands; sizes that differ by a factor of 1.25 at most are in one band or in neighbours."""
    edges = [1]
    while edges[-1] < most:
        edges.append(edges[-1] * 5 // 4 + 1)
    return np.array(edges, np.int64)


EDGES = bands()
CLASSES = np.where(EDGES >= COMBINED_FROM, np.maximum(EDGES // CLASS_TOKENS, 1), 0)


def batch_sets(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of the texts of a batch in order of their hash, the row of each, and each row's set size."""
    found, rows = [], []
    for lo, _, data, bounds in A.slices(column):
        starts, ends, first = A.words(data, bounds)
        h = A.Fingerprints(data, A.LOWER).of(starts, ends)
        text = A.texts_of(first) + lo
        shingles = A.runs(h, SIZE)
        ok = A.whole_runs(first, SIZE, len(shingles))
        found.append(shingles[ok])
        rows.append(text[: len(shingles)][ok])
        sizes = np.diff(first)
        for size in range(1, SIZE):
            short = np.flatnonzero(sizes == size)
            if len(short):
                found.append(A.mixed(A.runs(h, size)[first[short]] + A.U64(size)))
                rows.append(short + lo)
    n = len(column)
    if not found:
        return np.zeros(0, A.U64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    h, row = np.concatenate(found), np.concatenate(rows)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, row, np.bincount(row, minlength=n)


def parts(column) -> Iterator[tuple[int, int]]:
    """First row and number of rows of consecutive parts of MOST_SETS texts and MOST_BYTES at most."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < len(column):
        most = int(np.searchsorted(ends, ends[lo] + MOST_BYTES, "right")) - 1
        hi = min(max(most, lo + 1), lo + MOST_SETS, len(column))
        yield lo, hi - lo
        lo = hi


def set_ids(h: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ids = np.zeros(len(sizes), A.U64)
    np.add.at(ids, row, A.mixed(h ^ A.U64(A.STEPS[7])))
    return A.mixed(ids + sizes.astype(A.U64) * A.U64(A.STEPS[8])).view(np.int64)


@F.arrow_udf(StructType([StructField("n", LongType()), StructField("set_id", LongType())]))
def set_of(column: pa.Array) -> pa.Array:
    """Size and id of each text's set."""
    found = []
    for lo, n in parts(column):
        h, row, sizes = batch_sets(column.slice(lo, n))
        found.append((sizes, set_ids(h, row, sizes)))
    sizes, ids = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    A.release()
    return pa.StructArray.from_arrays([pa.array(sizes), pa.array(ids)], ["n", "set_id"])


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def joined(column, kind) -> np.ndarray:
    """The arrays of a binary column, one after the other."""
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def lengths(column, kind) -> np.ndarray:
    return np.array([len(x.as_py()) for x in column], np.int64) // np.dtype(kind).itemsize


def lost_tokens(key: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many tokens of each row agree with another one of that row in all compared bits."""
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    lost = np.zeros(n, np.int64)
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
        order = np.lexsort((row[at], key[at]))
        key, row = key[at][order], row[at][order]
        np.add.at(lost, row[1:][(key[1:] == key[:-1]) & (row[1:] == row[:-1])], 1)
    return lost


TOKENS = "bucket int, sets binary, sizes binary, lost binary, at binary, low binary, high binary"


def token_rows(buckets: int):
    """For mapInArrow: the tokens of each batch's distinct sets, one row per token bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, n in parts(whole.column(0)):
                column = whole.column(0).slice(lo, n)
                h, row, sizes = batch_sets(column)
                if not len(h):
                    continue
                ids = set_ids(h, row, sizes)
                firsts = np.unique(ids, return_index=True)[1]
                wanted = np.zeros(len(ids), bool)
                wanted[firsts] = True
                keep = wanted[row]
                h, row = h[keep], row[keep]
                bucket = ((h >> A.U64(32)) * A.U64(buckets)) >> A.U64(32)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=A.U64))
                low, high = h.astype(np.uint32), ((h >> A.U64(32)) * A.U64(0x9E3779B1) >> A.U64(24)).astype(np.uint8)
                lost = lost_tokens(low | (high.astype(A.U64) << A.U64(32)) | (bucket << A.U64(40)), row, len(ids))
                out: dict[str, list] = {name: [] for name in ("bucket", "sets", "sizes", "lost", "at", "low", "high")}
                for b in range(buckets):
                    part = slice(cuts[b], cuts[b + 1])
                    if cuts[b] == cuts[b + 1]:
                        continue
                    here = np.zeros(len(ids), bool)
                    here[row[part]] = True
                    place = np.cumsum(here) - 1
                    out["bucket"].append(b)
                    out["sets"].append(packed(ids[here]))
                    out["sizes"].append(packed(sizes[here].astype(np.int32)))
                    out["lost"].append(packed(np.minimum(lost[here], 255).astype(np.uint8)))
                    out["at"].append(packed(place[row[part]].astype(np.uint16)))
                    out["low"].append(packed(low[part]))
                    out["high"].append(packed(high[part]))
                types = [pa.int32()] + [pa.binary()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))
            A.release()

    return rows


SHARED = "home int, bucket int, sets binary, sizes binary, lost binary, counts binary, low binary, high binary, df binary"


def shared_tokens(homes: int):
    """For applyInArrow on one token bucket: tokens of two sets or more, one row per home of the sets."""

    def rows(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        heads = lengths(table.column("sets"), np.int64)
        place = np.repeat((np.cumsum(heads) - heads).astype(np.int32), lengths(table.column("at"), np.uint16))
        place += joined(table.column("at"), np.uint16)
        key = joined(table.column("low"), np.uint32).astype(np.uint64)
        key |= joined(table.column("high"), np.uint8).astype(np.uint64) << A.U64(32)
        ids, sizes, lost = (joined(table.column(c), kind) for c, kind in (("sets", np.int64), ("sizes", np.int32), ("lost", np.uint8)))
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        twice = same[1:] | same[:-1]
        key, place = key[twice], place[twice]
        del order, same, twice
        owner = ids[place]
        order = np.lexsort((owner, key))
        key, place, owner = key[order], place[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, place, owner = key[new], place[new], owner[new]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        df = np.repeat(np.diff(edge), np.diff(edge))
        many = df > 1
        key, place, owner, df = key[many], place[many], owner[many], df[many]
        home = (owner.view(np.uint64) >> A.U64(7)) % A.U64(homes)
        order = np.lexsort((key, owner, home))
        key, place, owner, df, home = key[order], place[order], owner[order], df[order], home[order]
        cuts = np.searchsorted(home, np.arange(homes + 1, dtype=np.uint64))
        out: dict[str, list] = {n: [] for n in ("home", "bucket", "sets", "sizes", "lost", "counts", "low", "high", "df")}
        for k in range(homes):
            part = slice(cuts[k], cuts[k + 1])
            if cuts[k] == cuts[k + 1]:
                continue
            own = owner[part]
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out["home"].append(k)
            out["bucket"].append(bucket)
            out["sets"].append(packed(own[edge]))
            out["sizes"].append(packed(sizes[place[part][edge]]))
            out["lost"].append(packed(lost[place[part][edge]]))
            out["counts"].append(packed(np.diff(np.append(edge, len(own))).astype(np.int32)))
            out["low"].append(packed(key[part].astype(np.uint32)))
            out["high"].append(packed((key[part] >> A.U64(32)).astype(np.uint8)))
            out["df"].append(packed(np.minimum(df[part], 65535).astype(np.uint16)))
        types = [pa.int32()] * 2 + [pa.binary()] * 7
        A.release()
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return rows


def combinations(owner: np.ndarray, token: np.ndarray, scheme: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all two-token combinations within a class of a set's frequent prefix tokens."""
    part = (A.mixed(token + scheme.astype(A.U64)) % CLASSES[scheme].astype(A.U64)).astype(np.int64)
    order = np.lexsort((token, part, owner))
    owner, token, scheme, part = owner[order], token[order], scheme[order], part[order]
    owners, signs = [], []
    for step in range(1, len(token)):
        pair = (owner[step:] == owner[:-step]) & (part[step:] == part[:-step])
        if not pair.any():
            break
        a, b = token[:-step][pair], token[step:][pair]
        signs.append(A.mixed(A.mixed(a) * A.U64(A.STEPS[11]) + b * A.U64(A.STEPS[12]) + scheme[step:][pair].astype(A.U64)))
        owners.append(owner[step:][pair])
    if not signs:
        return owner[:0], token[:0]
    return np.concatenate(owners), np.concatenate(signs)


SETS = "set_id long, n long, lost long, tokens binary, signs array<long>, lefts array<long>"


def signatures(table: pa.Table) -> pa.Table:
    """For applyInArrow on the sets of one home: sets that may have partners, with shared tokens and signatures."""
    counts = joined(table.column("counts"), np.int32)
    ids = np.repeat(joined(table.column("sets"), np.int64), counts)
    sizes = np.repeat(joined(table.column("sizes"), np.int32), counts).astype(np.int64)
    lost = np.repeat(joined(table.column("lost"), np.uint8), counts).astype(np.int64)
    bucket = np.repeat(np.asarray(table.column("bucket").combine_chunks(), np.uint64), lengths(table.column("low"), np.uint32))
    token = joined(table.column("low"), np.uint32).astype(np.uint64)
    token |= (joined(table.column("high"), np.uint8).astype(np.uint64) << A.U64(32)) | (bucket << A.U64(40))
    df = joined(table.column("df"), np.uint16)
    order = np.lexsort((token, df, ids))
    ids, sizes, lost, token, df = ids[order], sizes[order], lost[order], token[order], df[order]
    edge = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    m = np.diff(np.append(edge, len(ids)))
    n, lost = sizes[edge], lost[edge]
    least = (4 * n + 4) // 5
    shared = m + lost  # tokens that agree within a set may be shared as well
    able = shared >= least
    owner = np.repeat(np.arange(len(edge)), m)
    rank = np.arange(len(ids)) - np.repeat(edge, m)
    band = np.searchsorted(EDGES, n, "right") - 1
    basic = n - least + 1 - (n - shared)
    inside = able[owner] & (rank < basic[owner])
    frequent = df > RARE
    extended = np.zeros(len(edge), bool)
    extended[owner[inside & frequent]] = True
    more = np.where(extended, CLASSES[band + 1], 0)
    inside = able[owner] & (rank < (basic + more)[owner])
    # Of the two schemes a set takes part in, those below COMBINED_FROM index every token alone.
    alone = inside & (rank < basic[owner]) & (~frequent | (CLASSES[band] == 0)[owner])
    # If a token is the first that two sets share, they share none before it. If that is a frequent one, all are frequent.
    many = np.bincount(owner[frequent], minlength=len(edge)) + lost
    owners, signs, left = [owner[alone]], [A.mixed(token[alone] ^ A.U64(A.STEPS[13]))], [(shared[owner] - rank)[alone]]
    for step in (0, 1):
        scheme = (band + step)[owner]
        pick = inside & frequent & (CLASSES[scheme] > 0) & (many >= least)[owner]
        o, s = combinations(owner[pick], token[pick], scheme[pick])
        owners.append(o)
        signs.append(s)
        left.append(many[o])
    o, s, left = np.concatenate(owners), np.concatenate(signs), np.concatenate(left)
    order = np.lexsort((s, o))
    o, s, left = o[order], s[order], left[order]
    chosen = np.flatnonzero(able)
    A.release()
    ends = np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(edge))[chosen])]).astype(np.int32)
    return pa.Table.from_arrays(
        [
            pa.array(ids[edge][chosen]),
            pa.array(n[chosen]),
            pa.array(lost[chosen]),
            pa.array([packed(np.sort(token[edge[k] : edge[k] + m[k]])) for k in chosen], pa.binary()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(s.view(np.int64))),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(left)),
        ],
        names=["set_id", "n", "lost", "tokens", "signs", "lefts"],
    )


@F.arrow_udf(LongType())
def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many tokens two sorted arrays share."""
    found = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        found.append(int((y[at] == x).sum()) if len(y) else 0)
    A.release()
    return pa.array(found, pa.int64())


@F.arrow_udf(StructType([StructField("near", LongType()), StructField("apart", ArrayType(LongType()))]))
def differences(tokens: pa.Array, leader: pa.Array) -> pa.Array:
    """How many tokens a sorted array shares with its leader's, and those that one of both has: first those the leader lacks, each
    part in an order that is the same for all."""
    near, apart = [], []
    for x, y in zip(tokens, leader):
        x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        gained, lost = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
        near.append(len(x) - len(gained))
        apart += [part[np.argsort(A.mixed(part))] for part in (gained, lost)]
    ends = np.concatenate([[0], np.cumsum([len(part) for part in apart], dtype=np.int64)[1::2]]).astype(np.int32)
    values = np.concatenate(apart).view(np.int64) if apart else np.zeros(0, np.int64)
    A.release()
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
    return pa.StructArray.from_arrays([pa.array(near, pa.int64()), lists], ["near", "apart"])


@F.arrow_udf(ArrayType(LongType()))
def sketch(tokens: pa.Array) -> pa.Array:
    """For each bit whether an odd number of tokens falls on it: two arrays differ in so many tokens at least as their sketches in bits."""
    owner = np.repeat(np.arange(len(tokens)), lengths(tokens, np.uint64))
    place = (A.mixed(joined(tokens, np.uint64) ^ A.U64(A.STEPS[9])) % A.U64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(owner * SKETCH_BITS + place, minlength=len(tokens) * SKETCH_BITS) % 2
    words = np.packbits(odd.astype(np.uint8)).view(np.int64)
    A.release()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1) * (SKETCH_BITS // 64), pa.int32()), pa.array(words))


def n_tokens(column: str) -> Column:
    return (F.octet_length(column) / 8).cast("long")


def of(row: str | Column, name: str) -> Column:
    return F.col(f"{row}.{name}") if isinstance(row, str) else row[name]


def admissible(a: str | Column, b: str | Column) -> Column:
    """Whether two sets may be linked, by their sizes and by how many tokens they can share from a signature on."""
    shared = F.least(of(a, "left"), of(b, "left")) + of(a, "near") + of(b, "near") - of(a, "base")
    return 9 * shared >= 4 * (of(a, "n") + of(b, "n"))


def like(a: str | Column, b: str | Column) -> Column:
    """Whether two sets may be linked, by their sketches."""
    apart = reduce(Column.__add__, [F.bit_count(of(a, "bits")[k].bitwiseXOR(of(b, "bits")[k])) for k in range(SKETCH_BITS // 64)])
    return of(a, "room") + of(b, "room") + 18 * F.least(of(a, "lost"), of(b, "lost")) >= 9 * apart


def may_link(a: str | Column, b: str | Column) -> Column:
    """Whether two members of one group, of different components, have to be compared there."""
    sides = (of(a, "side") == 0) | (of(a, "side") != of(b, "side"))
    return (of(a, "label") != of(b, "label")) & sides & admissible(a, b)


def ordered_pair(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.set_id", f"{b}.set_id").alias("a"), F.greatest(f"{a}.set_id", f"{b}.set_id").alias("b")]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    tokens = sets.select("set_id", "n", "lost", "tokens")
    left = tokens.toDF("b", "n_b", "lost_b", "tokens_b")
    right = tokens.toDF("a", "n_a", "lost_a", "tokens_a")
    both = pairs.join(left, "b").join(right, "a")
    both = both.withColumn("both", overlap("tokens_a", "tokens_b") + F.least("lost_a", "lost_b"))
    return both.where("9 * both >= 4 * (n_a + n_b)").select("a", "b")


def set_links(members: DataFrame, docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Labels (node, label) of linked sets, and the verified links (a, b) that connect them."""
    total = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_TOKENS))
    sets = stored(
        docs.select(text)
        .mapInArrow(token_rows(buckets), TOKENS)
        .groupBy("bucket")
        .applyInArrow(shared_tokens(buckets), SHARED)
        .groupBy("home")
        .applyInArrow(signatures, SETS),
        "sets",
    )
    own = F.col("n") - F.col("lost") - n_tokens("tokens")
    signed = sets.select("set_id", "n", own.alias("own"), F.explode(F.arrays_zip("signs", "lefts")).alias("x"))
    none = [F.lit(0).cast("long").alias(c) for c in ("near", "base", "side")]
    signed = signed.select(F.col("x.signs").alias("sign"), "set_id", "n", F.col("x.lefts").alias("left"), "own", *none)
    tried, every, labels = None, None, None
    for step in range(MOST_ROUNDS + 1):
        leaders = (
            signed.groupBy("sign")
            .agg(F.min(F.struct("own", "set_id", "n", "left", "near", "base")).alias("l"), F.count(F.lit(1)).alias("size"))
            .where("size > 1")
        )
        groups = signed.alias("s").join(leaders, "sign")
        stars = groups.where(F.col("s.set_id") != F.col("l.set_id")).where(admissible("s", "l")).select(*ordered_pair("l", "s")).distinct()
        stars = stored(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"), "stars")
        links = stored(verified(stars, sets), "links")
        if every is None or not links.isEmpty():
            every = links if every is None else every.unionByName(links)
            labels = components(every)
        tried = stars if tried is None else tried.unionByName(stars)

        opened = open_members(groups, labels)
        large = crowding(opened.where(F.col("outside") > SMALL), sets)
        crowded = F.col("crowded") & F.lit(step < MOST_ROUNDS)
        rest = open_pairs(opened.where(F.col("outside") <= SMALL), may_link("x", "y"))
        rest = rest.unionByName(open_pairs(large.where(~crowded), may_link("x", "y") & like("x", "y")))
        rest = stored(rest.distinct().join(tried, ["a", "b"], "left_anti"), "rest")
        late = stored(verified(rest, sets), "late")
        if not late.isEmpty():
            every = every.unionByName(late)
            labels = components(every)
        split = large.where(crowded & F.col("able"))
        if split.isEmpty():
            return labels, every
        tried = tried.unionByName(rest)
        signed = stored(split_groups(split, sets, labels), "signed")


def open_members(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the groups that their leaders left open, those of several components, with their component and the largest one, the
    leader and how many are outside the largest one; ``able`` says whether a member may be linked with some other."""
    labelled = groups.select("s.*", F.col("l.set_id").alias("leader"), "size").join(labels, F.col("set_id") == F.col("node"), "left")
    labelled = labelled.drop("node").withColumn("label", F.coalesce("label", "set_id"))
    reach = [F.min("n").alias("least"), F.max("left").alias("most"), F.max("near").alias("most_near")]
    parts = labelled.groupBy("sign", "label").agg(F.count(F.lit(1)).alias("size"), *reach)
    largest = parts.groupBy("sign").agg(
        F.max(F.struct("size", "label")).alias("top"), F.count(F.lit(1)).alias("parts"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.max("most_near").alias("most_near"),
    )
    open_groups = largest.where("parts > 1").select("sign", "top.label", "top.size", "least", "most", "most_near").toDF("sign", "top", "alike", "least", "most", "most_near")
    able = 9 * (F.least("left", "most") + F.col("near") + F.col("most_near") - F.col("base")) >= 4 * (F.col("n") + F.col("least"))
    opened = labelled.join(open_groups, "sign").withColumn("able", able).withColumn("outside", F.col("size") - F.col("alike"))
    return stored(opened.drop("least", "most", "most_near", "size", "alike"), "opened")


def open_pairs(opened: DataFrame, wanted: Column) -> DataFrame:
    """The wanted pairs (a, b) of a set outside the largest component and another one of its group."""
    x = opened.where((F.col("label") != F.col("top")) & F.col("able")).alias("x")
    return x.join(opened.alias("y"), F.col("x.sign") == F.col("y.sign")).where(wanted).select(*ordered_pair("x", "y"))


def crowding(opened: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of open groups with their sketches, and whether the group is ``crowded``: sets outside its largest component may be
    linked with more than SMALL others each, as some of them tell, or are more than WIDE. It decides how pairs are found, not which."""
    sketches = sets.join(opened.select("set_id").distinct(), "set_id", "left_semi").select(
        "set_id", "lost", sketch("tokens").alias("bits"), (9 * n_tokens("tokens") - 8 * F.col("n")).alias("room")
    )
    sketched = stored(opened.join(sketches, "set_id"), "sketched")
    member = F.struct("label", "side", "left", "near", "base", "n", "bits", "room", "lost")
    chosen = (F.col("label") != F.col("top")) & F.col("able") & (F.pmod(F.xxhash64("set_id"), "outside") < PROBES)
    probes = sketched.where(chosen).groupBy("sign").agg(F.collect_list(member).alias("probes"))  # about PROBES
    met = F.size(F.filter("probes", lambda p: may_link(p, F.col("member")) & like(p, F.col("member"))))
    counted = sketched.withColumn("member", member).join(probes, "sign").groupBy("sign").agg((F.sum(met) / F.first(F.size("probes"))).alias("met"))
    return sketched.join(counted, "sign", "left").withColumn("crowded", F.coalesce(F.col("met") > SMALL, F.lit(False)) | (F.col("outside") > WIDE)).drop("met")


def split_groups(opened: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Smaller groups that hold each pair of members of one leader that may be linked, but for pairs within one component.

    Let x share i tokens with the leader, which has m, and y share j. Linked sets share 4/5 of either size at least. If i is less
    than that, x is outer, and the rest must be tokens that both have and the leader lacks. Outer sets (side 0) meet each other and the
    inner ones (side 1) by these. Inner sets share i + j - m tokens and as many as they both differ in from the leader; that must be
    4/9 of both sizes at least, and all they differ in is a quarter of a size at most. An inner set outside the leader's component
    meets the other ones outside it (side 0) and those inside it (sides 1 and 2) in groups of their own, as the latter have few
    differences.
    """
    tokens = sets.select("set_id", "n", "lost", "tokens")
    heads = tokens.select(F.col("set_id").alias("leader"), F.col("tokens").alias("of_leader"))
    ranks = labels.select(F.col("node"), F.col("label").alias("part"))
    pairs = opened.where("set_id <> leader").select("leader", "set_id").distinct()
    pairs = pairs.join(ranks, F.col("set_id") == F.col("node"), "left").select("leader", "set_id", F.coalesce("part", "set_id").alias("part"))
    pairs = pairs.join(ranks.toDF("node", "home"), F.col("leader") == F.col("node"), "left").drop("node")
    pairs = pairs.withColumn("far", F.col("part") != F.coalesce("home", "leader")).drop("part", "home")
    told = pairs.join(tokens, "set_id").join(heads, "leader").withColumn("d", differences("tokens", "of_leader"))
    told = told.select(
        "leader", "set_id", "n", "lost", "far", "d.near", "d.apart", n_tokens("tokens").alias("held"), n_tokens("of_leader").alias("base")
    )
    owed = F.expr("(4 * n + 4) div 5") - F.col("lost") - F.col("near")
    told = stored(told.withColumns({"needs": 4 * F.col("n") - 9 * F.col("near"), "owed": owed}), "apart")
    inner = told.where("owed <= 0")
    least = inner.groupBy("leader").agg(
        F.min(F.when(F.col("far"), F.col("needs"))).alias("least_far"), F.min(F.when(~F.col("far"), F.col("needs"))).alias("least_near")
    )
    both = inner.join(least, "leader")

    def exploded(rows: DataFrame, shown: Column, kind: int, side: int, **made: Column) -> DataFrame:
        rows = rows.withColumns(made).select("*", F.posexplode(shown).alias("rank", "token"))
        sign = F.xxhash64("leader", F.lit(kind), "token").alias("sign")
        left = (F.col("most") - F.col("rank") + F.col("lost")).alias("left")
        return rows.select(sign, "set_id", "n", left, "own", "near", "base", F.lit(side).cast("long").alias("side"))

    def prefixes(rows: DataFrame, others: str, side: int, kind: int) -> DataFrame:
        # So many equal differences at least; if that may be none, the differences end with one that all sets have.
        size = F.size("apart").cast("long")
        of_both = F.ceil((F.col("needs") + F.col(others) + 9 * (F.col("base") - F.col("lost"))) / 9)
        alone = F.ceil(size - F.col("held") - 2 * F.col("lost") + 3 * F.col("n") / 4)
        rows = rows.where(F.col(others).isNotNull()).withColumn("length", size - F.greatest(of_both, alone, F.lit(0)) + 1).where("length > 0")
        shown = F.slice(F.concat("apart", F.array(F.lit(0).cast("long"))), 1, F.col("length").cast("int"))
        return exploded(rows, shown, kind, side, own=size, most=size)

    def gained(rows: DataFrame, side: int) -> DataFrame:
        # Tokens that the leader lacks, without as many as must be shared but for one.
        none = F.lit(0).cast("long")
        length = F.col("held") - F.col("near") - F.greatest(F.col("owed"), F.lit(1)) + 1
        own = F.col("n") - F.col("lost") - F.col("held") + (1 << 40) * side  # outer sets lead
        shown = F.slice("apart", 1, F.col("length").cast("int"))
        return exploded(rows.withColumn("length", length).where("length > 0"), shown, 2, side, own=own, most=F.col("held"), near=none, base=none)

    among = prefixes(both.where("far"), "least_far", 0, 0)
    inside = prefixes(both.where("NOT far"), "least_far", 2, 1)
    outside = prefixes(both.where("far"), "least_near", 1, 1).join(inside.select("sign").distinct(), "sign", "left_semi")
    outer = gained(told.where("owed > 0"), 0)
    meeting = gained(inner, 1).join(outer.select("sign").distinct(), "sign", "left_semi")
    return among.unionByName(inside).unionByName(outside).unionByName(outer).unionByName(meeting)


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row (doc_id, n_shingles, component_id), with components of all linked documents.

    Words are split at ASCII white space and A-Z lower-cased; a shorter text is one shingle. Null, empty and blank
    texts have no shingles and no links. component_id is the smallest doc_id of the component; equal texts and repeated rows
    are in one component, as are rows with a null doc_id, which never name it.
    """
    members = stored(
        docs.select(F.col(doc_id).alias("doc_id"), set_of(F.col(text)).alias("s")).select("doc_id", "s.n", "s.set_id"), "members"
    )
    labels, _ = set_links(members, docs, text)
    labelled = members.join(labels, F.col("set_id") == F.col("node"), "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "set_id")).alias("part")
    )
    lowest = labelled.where("part IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("lowest"))
    return labelled.join(lowest, "part", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that name their component, with their columns; documents without words stay. Rows of one doc_id
    are one document."""
    (gone_id,) = free_names(docs.columns, "_gone")
    gone = join_documents(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
