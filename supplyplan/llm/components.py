"""Connected components of links between documents, as joins and aggregations."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label) of the nodes of links (a, b); the label is the least node of the component.

    With a number of rounds it ends after these: equal labels then still mean one component, but one component may have
    several labels (not one whose nodes are all linked to one of them).

    Every round takes the least label of the neighbours and then the label's label, so that paths shrink by half;
    it ends when the labels stay. Only their sum comes to the driver.
    """
    pairs = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(pairs.unionByName(pairs.select("a", F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "labels")
    total = None if rounds else _sum(labels)
    for done in count(1):
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("to"))
        above = labels.select(F.col("node").alias("to"), F.col("label"))
        labels = stored(near.join(above, "to").select(F.col("a").alias("node"), "label"), "labels")
        if rounds:
            if done == rounds:
                return labels
            continue
        after = _sum(labels)
        if after == total:
            return labels
        total = after


def _sum(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
