"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of the undirected edges (a, b): connected nodes, and no others, have the same root.

    The nodes are put into a random but fixed order, that of their hashes. A round points every node at the first of itself
    and its neighbours and replaces each edge by one between the nodes that its ends point at; edges inside a node vanish.
    A constant share of the nodes is expected to go in a round, whatever the numbers of the nodes; a star is gone after two.
    At the end the pointers of all rounds are followed once. Pointers and edges are written to the shared folder.
    A node whose edges all lead to itself is a component. Edges with a null end are ignored.
    """
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("root", F.col("id"))
    edges, rounds = edges.filter("a <> b"), []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a"))
        first = ends.groupBy("id").agg(F.min_by("other", F.xxhash64("other")).alias("other"))
        to = F.when(F.xxhash64("other") < F.xxhash64("id"), F.col("other")).otherwise(F.col("id")).alias("to")
        pointers = written(first.select("id", to), "pointers")
        rounds.append(pointers)
        one = pointers.select(F.col("id").alias("a"), F.col("to").alias("one"))
        two = pointers.select(F.col("id").alias("b"), F.col("to").alias("two"))
        moved = edges.join(one, "a").join(two, "b").filter("one <> two")
        edges = written(moved.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct(), "edges")
    for pointers in rounds:
        follow = pointers.select(F.col("id").alias("root"), "to")
        labels = labels.join(follow, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return written(labels, "labels")
