"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeguard.llm.common import join_hint, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the undirected ``links`` (a, b) reaches.

    Smallest labels of neighbours, then labels of labels, until nothing changes: few rounds even for long chains,
    every round written to the shared folder. Only counts are collected, and labels are broadcast if they are few.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "edges")
    first = edges.groupBy("a").agg(F.min("b").alias("__m"))
    labels = stored(first.select(F.col("a").alias("node"), F.least("a", "__m").alias("label")), "labels")
    how = join_hint(labels)  # it has as many rows in each round
    while True:
        near = edges.join(labels.hint(how), edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("__near"))
        better = labels.join(near.hint(how), labels["node"] == near["a"]).select("node", F.least("label", "__near").alias("__new"), "label")
        heads = labels.select(F.col("node").alias("__head"), F.col("label").alias("__top"))
        step = better.join(heads.hint(how), better["__new"] == heads["__head"]).select(
            "node", F.least("__new", "__top").alias("__next"), "label")
        done = stored(step, "labels")
        labels = done.select("node", F.col("__next").alias("label"))
        if done.filter("__next != label").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The (node, label) of ``components`` after further ``links`` (a, b); a node without a label is its own.

    Links are drawn between components, so the work goes with the new links only.
    """
    how = join_hint(labels)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"__{c}")).hint(how)
    drawn = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b"))
    tops = components(drawn).withColumnsRenamed({"node": "__node", "label": "__top"})
    moved = labels.join(tops.hint(join_hint(tops)), F.col("label") == F.col("__node"), "left").select("node", F.coalesce("__top", "label").alias("label"))
    fresh = tops.join(labels.hint(how), F.col("__node") == F.col("node"), "left_anti").select(F.col("__node").alias("node"), F.col("__top").alias("label"))
    return stored(moved.unionByName(fresh), "joined")
