"""Why a finding stands: the way from an event up to the root thread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import cut


def explain(events: DataFrame, paths: DataFrame) -> DataFrame:
    """idx, step, tid, pos: step 0 is the event itself, then the start of its thread, and so up to the root's first event.

    events: idx, tid, pos. The way is in the thread's path, so nothing recurses here.
    """
    up = events.join(paths, "tid")
    n = F.size("path")
    starts = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("step"), F.element_at("path", n - i + 1).alias("tid"), F.element_at("starts", n - i + 1).alias("pos")))
    own = F.array(F.struct(F.lit(0).alias("step"), F.col("tid").alias("tid"), F.col("pos").alias("pos")))
    return up.select("idx", F.explode(F.concat(own, starts)).alias("x")).select("idx", "x.step", "x.tid", "x.pos")


def call_paths(edges: DataFrame, targets: DataFrame, root: str, most_rounds: int = 10_000) -> DataFrame:
    """target, path: all simple paths of callers (a calls b) from the root to each target. Nodes on a path are distinct, so paths end."""
    back = edges.select(F.col("b").alias("_b"), F.col("a").alias("_a")).distinct()
    at = cut(targets.select(F.col("node").alias("target"), F.array("node").alias("path")))
    done = at.filter(F.col("path")[0] == root)
    for _ in range(most_rounds):
        up = at.filter(F.col("path")[0] != root).join(back, F.col("path")[0] == F.col("_b")).filter(~F.array_contains("path", F.col("_a")))
        at = cut(up.select("target", F.concat(F.array("_a"), "path").alias("path")))
        if at.isEmpty():
            return done.select("target", F.array_join("path", " > ").alias("path"))
        done = done.unionByName(at.filter(F.col("path")[0] == root))
    raise RuntimeError("the call paths didn't end")


def root_distance(parents: DataFrame, most: int = 10_000) -> DataFrame:
    """node, distance: calls (a calls b) up to the top along each node's least caller; a cycle ends the way."""
    first = parents.groupBy("b").agg(F.min("a").alias("a")).select(F.col("b").alias("_at"), F.col("a").alias("_up"))
    nodes = parents.select(F.col("a").alias("node")).unionByName(parents.select(F.col("b").alias("node"))).distinct()
    at, done = cut(nodes.select("node", F.array("node").alias("seen"))), None
    for _ in range(most):
        up = at.join(first, F.element_at("seen", -1) == F.col("_at"), "left")
        on = F.col("_up").isNotNull() & ~F.array_contains("seen", F.col("_up"))
        up = cut(up.select("node", "seen", "_up", F.coalesce(on, F.lit(False)).alias("on")))
        ended = up.filter("not on").select("node", (F.size("seen") - 1).alias("distance"))
        done = ended if done is None else done.unionByName(ended)
        at = up.filter("on").select("node", F.concat("seen", F.array("_up")).alias("seen"))
        if at.isEmpty():
            return done
    raise ValueError("a way is longer than allowed")
