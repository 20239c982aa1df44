"""Mixing of sources to target weights by hierarchical budgets.

Sources are leaves of a tree domain, language, source. A budget of tokens goes down the tree by weights. A node can use
its tokens times the most epochs; what a node cannot use goes to its siblings in proportion to their weights, before anything is
left for the ancestors' other children. Each leaf reads its documents in whole epochs and the prefix, in tokens, of one more, in a
seeded order. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.components import free_names
from larkspur.session import stored

#: Tokens of the mix as a share of all tokens, and how often a document may be read.
SHARE = 0.75
MOST_EPOCHS = 2
SEED = 17
#: Documents in one slot of a leaf's order, about.
SLOT_DOCS = 1000

# Weights of domains and languages; nodes that are not named weigh 1.
DOMAIN_WEIGHTS = {"hub": 2.0, "edge": 3.0}
LANGUAGE_WEIGHTS = {"en": 5.0, "fr": 2.0, "de": 2.0, "es": 1.0}


def domain_of(source: Column) -> Column:
    """Sources whose name ends in 0 are hubs, all others edges."""
    return F.when(source.endswith("0"), "hub").otherwise("edge")


def weight_of(value: Column, weights: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(value == k, F.lit(w)) for k, w in weights.items()], F.lit(1.0))


def token_count(text: Column) -> Column:
    """Tokens of a text: a quarter of its code points, rounded up."""
    return F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / F.lit(4)).cast("long")


def shared_out(nodes: DataFrame, parent: list[str], ties: list[str]) -> DataFrame:
    """``nodes`` (weight, room, given) with ``budget``: the parent's budget ``given`` by weights, none over its room.

    Nodes fill up in order of room per weight; the first that does not, and all after it, share what is left by weight.
    """
    place = Window.partitionBy(*parent).orderBy(F.col("room") / F.col("weight"), *ties)
    before = F.coalesce(F.sum("room").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    on = F.sum("weight").over(place.rowsBetween(0, Window.unboundedFollowing))
    levelled = nodes.withColumns({"nth": F.row_number().over(place), "level": (F.col("given") - before) / on})
    unfilled = F.when(F.col("level") * F.col("weight") < F.col("room"), F.struct("nth", "level"))
    held = levelled.withColumn("held", F.min(unfilled).over(Window.partitionBy(*parent)))
    shared = F.greatest(F.col("held.level"), F.lit(0.0)) * F.col("weight")
    full = F.col("held").isNull() | (F.col("nth") < F.col("held.nth"))
    return held.withColumn("budget", F.when(full, F.col("room")).otherwise(shared)).drop("nth", "level", "held", "given")


TREE = ("domain", "lang", "source")


def same_node(keys) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def budgets(leaves: DataFrame, share: float, epochs: int) -> DataFrame:
    """Leaves (domain, lang, source, tokens, n_docs) with the whole tokens each may spend in ``budget``.

    Null languages and sources are nodes of their own.
    """
    weights = {"domain": weight_of(F.col("domain"), DOMAIN_WEIGHTS), "lang": weight_of(F.col("lang"), LANGUAGE_WEIGHTS), "source": F.lit(1.0)}
    room = (F.sum("tokens") * epochs).cast("double").alias("room")
    spent = leaves.agg((F.sum("tokens") * share).alias("budget"))
    for depth in range(1, len(TREE) + 1):
        above, keys = list(TREE[: depth - 1]), list(TREE[:depth])
        nodes = leaves.groupBy(*keys).agg(room).withColumn("weight", weights[keys[-1]])
        if above:
            parents = spent.select(*[F.col(k).alias(f"_{k}") for k in above], F.col("budget").alias("given"))
            given = nodes.join(parents, same_node(above)).drop(*[f"_{k}" for k in above])
        else:
            nodes = nodes.withColumn("root", F.lit(1))
            given = nodes.join(F.broadcast(spent.select(F.lit(1).alias("root"), F.col("budget").alias("given"))), "root")  # one row
        spent = shared_out(given, above or ["root"], keys)
    held = spent.select(*[F.col(k).alias(f"_{k}") for k in TREE], F.floor(F.col("budget") + 1e-6).alias("budget"))
    return leaves.join(held, same_node(TREE)).drop(*[f"_{k}" for k in TREE])


def seeded(epoch: Column, doc: Column) -> Column:
    """Place of a document in an epoch's order, from 0 up to 2**32."""
    text = F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, share: float = SHARE, epochs: int = MOST_EPOCHS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row (doc_id, tie, domain, lang, source, n_tokens, n_copies): how often the mix reads the document.

    ``tie`` is a fingerprint of the text. A leaf's last epoch takes the documents, in seeded order, as long as their tokens together
    stay within its budget; documents are not split. Rows of one doc_id come in order of the fingerprint, and of rows alike in
    both any may be taken first. Texts without tokens cost nothing. Other columns are ignored.
    """
    source = F.col("source")
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"),
            domain_of(F.coalesce(source, F.lit(""))).alias("domain"), "lang", source.alias("source"), token_count(F.col(text)).alias("n_tokens"),
        ),
        "tokens",
    )
    leaves = rows.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    spent = stored(budgets(stored(leaves, "leaves"), share, epochs), "budgets")
    spent = spent.select(
        *[F.col(k).alias(f"_{k}") for k in TREE],
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1).cast("long").alias("whole"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(-1).alias("rest"),
        F.ceil(F.col("n_docs") / SLOT_DOCS).alias("slots"),
    )
    placed = rows.join(spent, same_node(TREE)).drop(*[f"_{k}" for k in TREE])
    placed = placed.withColumn("place", seeded(F.col("whole"), F.col("doc_id")))
    placed = placed.withColumn("slot", F.expr("(place * slots) div 4294967296"))
    # A leaf may hold a third of all rows: sums within a slot, and slots' starts from one row each.
    slots = placed.groupBy(*TREE, "slot").agg(F.sum("n_tokens").alias("tokens"))
    in_leaf = Window.partitionBy(*TREE).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select(*[F.col(k).alias(f"_{k}") for k in TREE], F.col("slot").alias("_slot"), F.coalesce(F.sum("tokens").over(in_leaf), F.lit(0)).alias("start"))
    in_slot = Window.partitionBy(*TREE, "slot").orderBy("place", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("upto", F.sum("n_tokens").over(in_slot))
    joined = summed.join(starts, same_node([*TREE, "slot"]))
    taken = (F.col("start") + F.col("upto") <= F.col("rest")).cast("long")
    return joined.select("doc_id", "tie", *TREE, "n_tokens", (F.col("whole") + taken).alias("n_copies"))


def take_mix(docs: DataFrame, share: float = SHARE, epochs: int = 1) -> DataFrame:
    """The documents of the mix with their columns, each as often as the mix reads it.

    Rows alike in doc_id, text, language and source are taken alike, as often as the one of them that is read most.
    """
    chosen = mix(docs, share, epochs).where("n_copies > 0")
    of_doc, of_tie, of_lang, of_source, copies, copy = free_names(docs.columns, "_doc_id", "_tie", "_lang", "_source", "_copies", "_copy")
    chosen = chosen.groupBy("doc_id", "tie", "lang", "source").agg(F.max("n_copies")).toDF(of_doc, of_tie, of_lang, of_source, copies)
    same = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(of_tie)
    for own, other in (("doc_id", of_doc), ("lang", of_lang), ("source", of_source)):
        same &= F.col(own).eqNullSafe(F.col(other))
    taken = docs.join(chosen, same).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return taken.select(*docs.columns)
