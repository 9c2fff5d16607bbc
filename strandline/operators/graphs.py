"""Closures over call graphs, which may be cyclic, and graph sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import cut

from .meetings import met


def reach(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(a, b) for every b reached from a by one call or more. Path doubling: log2(depth) rounds, in which only new ways are extended."""
    known = cut(edges.select("a", "b").distinct())
    fresh = known
    for _ in range(most_rounds):
        # A way found in the last round, with any known one behind it and, but in the first round, any before it.
        tail, head = known.select(F.col("a").alias("m"), F.col("b").alias("to")), fresh.select(F.col("a").alias("m"), F.col("b").alias("to"))
        longer = fresh.join(tail, F.col("b") == F.col("m")).select("a", F.col("to").alias("b"))
        if fresh is not known:
            longer = longer.unionByName(known.join(head, F.col("b") == F.col("m")).select("a", F.col("to").alias("b")))
        fresh = cut(longer.distinct().join(known, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh))
    raise RuntimeError("the closure didn't settle")


def _carried(edges: DataFrame, seeds: DataFrame, most_rounds: int) -> DataFrame:
    calls = cut(edges.select(F.col("a").alias("_from"), F.col("b").alias("_to")).distinct())
    known = cut(seeds.select("node", "tid").distinct())
    fresh = known
    for _ in range(most_rounds):
        if fresh.isEmpty():
            return known
        there = fresh.join(calls, F.col("node") == F.col("_from")).select(F.col("_to").alias("node"), "tid").distinct()
        fresh = cut(there.join(known, ["node", "tid"], "left_anti"))
        known = cut(known.unionByName(fresh))
    raise RuntimeError("the propagation didn't settle")


def propagate(edges: DataFrame, seeds: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node, tid): thread ids carried from the seeds down all call edges. Semi-naive: only new rows are extended.

    Threads with the same seeds reach the same nodes, so their set of seeds is
    carried in their place, once, and the threads are put in at the end.
    """
    alike = cut(seeds.groupBy("tid").agg(F.sort_array(F.collect_set("node")).alias("_seeds")))
    carried = _carried(edges, alike.select("_seeds").distinct().select(F.explode("_seeds").alias("node"), F.col("_seeds").alias("tid")), most_rounds)
    return met(alike, carried.withColumnRenamed("tid", "_seeds"), ["_seeds"], "tid").select("node", "tid")


def withdraw(edges: DataFrame, seeds: DataFrame, removed: DataFrame, carried: DataFrame) -> DataFrame:
    """(node, tid) after seeds (node, tid) are removed, from what was `carried` before: only the threads concerned are carried anew."""
    tids = removed.select("tid").distinct()
    kept = seeds.join(tids, "tid", "left_semi").join(removed, ["node", "tid"], "left_anti")
    return carried.join(tids, "tid", "left_anti").select("node", "tid").unionByName(propagate(edges, kept))


def orphans(edges: DataFrame, roots: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Nodes that fall away when nodes without a caller, other than roots, are removed again and again."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    live, left, gone = cut(nodes.join(roots, "node", "left_anti")), cut(edges.select("a", "b").distinct()), None
    for _ in range(most_rounds):
        called = left.select(F.col("b").alias("node")).distinct()
        now = cut(live.join(called, "node", "left_anti"))
        if now.isEmpty():
            return gone if gone is not None else now
        gone = now if gone is None else cut(gone.unionByName(now))
        live = cut(live.join(now, "node", "left_anti"))
        left = cut(left.join(now.withColumnRenamed("node", "a"), "a", "left_anti"))
    raise RuntimeError("the removal didn't settle")


def graph_sizes(edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges."""
    ends = edges.select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("x"))
    return ends.agg(F.countDistinct("x").alias("n_nodes"), F.expr("count(1) div 2").alias("n_edges"))


def points_to_stats(points_to: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_classes, n_methods, n_pointers, n_objects, n_edges of an analysed program."""
    names = ("n_classes", "n_methods", "n_pointers", "n_objects", "n_edges")
    p = points_to.agg(F.countDistinct("node_id", "value").alias(names[2]), F.countDistinct("obj_id").alias(names[3]), F.count(F.lit(1)).alias(names[4]))
    n = nodes.agg(F.countDistinct("class").alias(names[0]), F.countDistinct("class", "method").alias(names[1]))
    return n.unionByName(p, allowMissingColumns=True).agg(*[F.max(x).alias(x) for x in names])


def latency_stats(log: DataFrame, series: int = 6) -> DataFrame:
    """Of a benchmark log's lines of whole numbers, interleaved series: series, n, total, most, average (two decimals)."""
    from strandline.functions.signatures import two_decimals

    cells = log.select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("i", "x")).filter("x rlike '^-?[0-9]+$'")
    rows = cells.select((F.col("i") % series).alias("series"), F.col("x").cast("long").alias("x"))
    return rows.groupBy("series").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.max("x").alias("most"), two_decimals(F.sum("x") / F.count("x")).alias("average"))
