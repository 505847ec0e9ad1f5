"""Connected components of a link table, by contraction (a union-find that runs as joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.common import discard, write_out


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that a link names; root is one node of its component.

    Every round hangs each node under its smallest neighbour, shortens the paths to the roots, and replaces
    the links by links between roots. At least half of the linked nodes go in a round, so the number of
    rounds is logarithmic; every step is an aggregation or an equi-join, whatever the size of a component.
    Self-links and repeated links do no harm; null ends are dropped.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = write_out(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = both.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("root"))
    while True:
        edges = both.where("u <> v")
        if edges.isEmpty():
            return labels
        parents = edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        parents = write_out(parents, "parents")
        while True:  # p(u) <= u, so this ends with every p a root
            up = parents.select(F.col("u").alias("q"), F.col("p").alias("r"))
            jumped = parents.hint("shuffle_merge").join(up, parents["p"] == up["q"]).select("u", F.col("r").alias("p"), (F.col("r") != F.col("p")).alias("moved"))
            jumped = write_out(jumped, "parents")
            still = not jumped.where("moved").isEmpty()
            discard(parents)
            parents = jumped.select("u", "p")
            parents._written_path = jumped._written_path
            if not still:
                break
        to = parents.select(F.col("u").alias("q"), "p")
        relabelled = labels.hint("shuffle_merge").join(to, labels["root"] == to["q"], "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = write_out(relabelled, "labels")
        left = edges.hint("shuffle_merge").join(to, edges["u"] == to["q"]).select(F.col("p").alias("u"), "v").distinct()
        right = left.hint("shuffle_merge").join(to, left["v"] == to["q"]).select("u", F.col("p").alias("v")).where("u <> v").distinct()
        contracted = write_out(right, "links")
        discard(both)
        both = contracted
