"""Connected components of an edge table by repeated minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, c) for every vertex of the edges (a, b): c is the smallest vertex of v's component.

    Each round contracts the graph: every vertex points to the smallest of its
    neighbours and itself, pointers are followed to their roots, and edges are
    rewritten between roots. A component at least halves in each round, so
    rounds are logarithmic. What a round leaves is written, which ends lineage.
    """
    live = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for _ in range(most_rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The smallest neighbour, itself included: a forest whose roots are local minima.
        parent = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")), "parents")
        while True:
            # Two jumps a written table: a way of any length shrinks to a quarter.
            up, top = (parent.select(F.col("v").alias(f"v{i}"), F.col("p").alias(f"p{i}")) for i in (1, 2))
            twice = parent.join(up, F.col("p") == F.col("v1")).join(top, F.col("p1") == F.col("v2"))
            jumped = written(twice.select("v", F.col("p2").alias("p"), (F.col("p2") != F.col("p")).alias("moved")), "jumped")
            parent = jumped.select("v", "p")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select("v", F.col("p").alias("c"))
        else:
            old = labels.select("v", F.col("c").alias("_c"))
            to = parent.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
            labels = written(old.join(to, F.col("_c") == F.col("_v"), "left").select("v", F.coalesce("_p", "_c").alias("c")), "labels")
        left = parent.select(F.col("v").alias("a"), F.col("p").alias("ra"))
        right = parent.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        live = written(live.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("the components didn't settle")
    if labels is None:
        kind = dict(edges.dtypes)["a"]
        return edges.sparkSession.createDataFrame([], f"v {kind}, c {kind}")
    return labels
