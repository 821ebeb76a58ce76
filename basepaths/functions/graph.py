"""Connected components of a link table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basepaths.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of ``links``; ``component`` is the smallest node of its component.

    Every round points each node to the neighbour (or itself) of least hash and contracts
    the links along these pointers. As the hash differs in each round, a constant share of the
    nodes goes per round whatever the shape of the graph, so the rounds grow with the logarithm
    of the nodes. Rounds are written to the shared folder, so a lost executor costs one round.
    Ids may be of any ordered type; links with a null end and loops are left out.
    """
    edges = cut_lineage(
        links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    )
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.withColumn("rep", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("at")).agg(F.min(rank("b")).alias("other"))
        pointer = least.select("at", F.least(F.col("other"), F.struct(F.xxhash64(F.lit(turn), "at").alias("h"), F.col("at").alias("v")))["v"].alias("to"))
        pointer = cut_lineage(pointer)
        first = edges.join(pointer, edges.a == pointer.at).select(F.col("to").alias("x"), "b")
        moved = first.join(pointer, first.b == pointer.at).select("x", F.col("to").alias("y"))
        edges = cut_lineage(
            moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        labels = cut_lineage(
            labels.join(pointer, labels.rep == pointer.at, "left").select("node", F.coalesce("to", "rep").alias("rep"))
        )
        turn += 1
    smallest = labels.groupBy("rep").agg(F.min("node").alias("component"))
    return labels.join(smallest, "rep").select("node", "component")
