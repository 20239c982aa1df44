"""Connected components of a table of links, by lowest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import stored


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores in front of those that are taken."""
    held = {c.lower() for c in taken}
    made = []
    for name in wanted:
        while name.lower() in held:
            name = f"_{name}"
        made.append(name)
    return made


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the label is the smallest node of its component.

    Each round a node takes the smallest label among its neighbours, and then its label's label, so that the rounds
    grow with the logarithm of a component's diameter in the usual case. A hub's links are aggregated before the shuffle.
    Self-links and repeated links change nothing; null ends are ignored.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lowered = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        lowered = stored(lowered, "lowered")
        if lowered.where("label < old").isEmpty():
            return lowered.select("node", "label")
        ends = lowered.select(F.col("node").alias("label"), F.col("label").alias("end"))
        labels = stored(lowered.join(ends, "label").select("node", F.least("label", "end").alias("label")), "labels")
