"""Connected components of a graph of 64-bit keys, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of ``edges`` (``a, b``, either way round): one node of its component.

    In each round a node points to the one with the least hash among itself and its neighbours, and
    the edges are redrawn between what their ends point to. As the order of hashes is random, the
    graph shrinks by a constant factor a round, so all rounds together handle about twice its rows;
    the pointers are put together from the last round back. Each round is written to the shared
    folder, so a lost executor costs one round. A hub's neighbours are never gathered: minima are
    taken before the shuffle.
    """
    left = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    rounds = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("node", "near")
        place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("k"))
        least = both.groupBy("node").agg(F.min(place("near")).alias("near"))
        to = stored(least.select("node", F.least(place("node"), F.col("near"))["k"].alias("to")), "pointers")
        ends = left.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        ends = ends.join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        drawn = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = stored(drawn.filter("a <> b").distinct(), "edges")
        rounds.append(to)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[-1].withColumnRenamed("to", "label")
    for to in reversed(rounds[:-1]):
        # What a node points to has a label from later rounds, or is where its component ended.
        later = labels.withColumnRenamed("node", "to")
        labels = stored(to.join(later, "to", "left").select("node", F.coalesce("label", "to").alias("label")), "labels")
    return labels
