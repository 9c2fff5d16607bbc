"""The forest of threads: paths, descendants, depths, and what may happen in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import cut


def thread_paths(threads: DataFrame, most_rounds: int = 40) -> DataFrame:
    """tid, path, starts, joins: arrays from the root to the thread.

    Pointer doubling: each round joins every thread's known piece with its
    topmost ancestor's, so a forest of depth d takes log2(d) rounds.
    """
    at = cut(threads.select("tid", F.col("ptid").alias("up"), F.array("tid").alias("path"), F.array("s").alias("starts"), F.array("j").alias("joins")))
    known = threads.select(F.col("tid").alias("_k"))
    at = at.join(known, F.col("up") == F.col("_k"), "left").withColumn("up", F.col("_k")).drop("_k")  # an unknown parent makes a root
    for _ in range(most_rounds):
        if at.filter("up is not null").isEmpty():
            return at.drop("up")
        above = at.select(F.col("tid").alias("_t"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("starts").alias("_starts"), F.col("joins").alias("_joins"))
        joined = at.join(above, F.col("up") == F.col("_t"), "left")
        ahead = lambda c: F.when(F.col("_t").isNull(), F.col(c)).otherwise(F.concat(f"_{c}", c)).alias(c)
        at = cut(joined.select("tid", F.col("_up").alias("up"), ahead("path"), ahead("starts"), ahead("joins")))
    raise ValueError("the threads' parents form a cycle")


def descendants(paths: DataFrame) -> DataFrame:
    """anc, desc, child (on the path from anc to desc) of every proper ancestor."""
    each = paths.select("tid", "path", F.posexplode("path").alias("i", "anc"))
    return each.filter("anc <> tid").select("anc", F.col("tid").alias("desc"), F.expr("path[i + 1]").alias("child"))


def under(paths: DataFrame, tids: DataFrame) -> DataFrame:
    """Distinct (tid) of these threads and all below them."""
    return paths.select("tid", F.explode("path").alias("_anc")).join(tids.select(F.col("tid").alias("_anc")), "_anc", "left_semi").select("tid").distinct()


def depths(paths: DataFrame) -> DataFrame:
    return paths.select("tid", (F.size("path") - 1).alias("depth"))


def may_be_parallel(a: str = "a", b: str = "b", distance: int | None = None) -> Column:
    """Whether events of two threads may happen in parallel, by their lowest common ancestor.

    Columns {x}_pos, {x}_path, {x}_starts, {x}_joins for x in a, b. An ancestor's
    event is parallel to those below its child's start, up to its join. Children
    of one ancestor are parallel unless one is joined before the other starts;
    with a distance, unjoined ones only if their starts are at most that far apart.
    """
    p = {"a": a, "b": b}
    common = f"size(filter(sequence(1, least(size({a}_path), size({b}_path))), i -> {a}_path[i - 1] = {b}_path[i - 1]))"
    d = F.expr(common)
    item = lambda x, what, at: F.get(F.col(f"{p[x]}_{what}"), at)
    pos = lambda x: F.col(f"{p[x]}_pos")

    def under(x: str, y: str) -> Column:
        """x's thread is an ancestor of y's."""
        return (item(y, "starts", d) < pos(x)) & (item(y, "joins", d).isNull() | (pos(x) < item(y, "joins", d)))

    before = lambda x, y: item(y, "joins", d).isNull() | (item(x, "starts", d) < item(y, "joins", d))
    siblings = before("a", "b") & before("b", "a")
    if distance is not None:
        unjoined = item("a", "joins", d).isNull() & item("b", "joins", d).isNull()
        siblings &= ~unjoined | (F.abs(item("a", "starts", d) - item("b", "starts", d)) <= distance)
    return (
        F.when(d == 0, F.lit(False))
        .when((d == F.size(f"{a}_path")) & (d == F.size(f"{b}_path")), F.lit(False))
        .when(d == F.size(f"{a}_path"), under("a", "b"))
        .when(d == F.size(f"{b}_path"), under("b", "a"))
        .otherwise(siblings)
    )


def start_threads(starts: DataFrame) -> DataFrame:
    """Threads of START events (node_id, pos, target, parent_tid, in_loop): tid, parent_tid, target, copy.

    A start in a loop makes two threads of its target, and every further start of
    a target one more.
    """
    from pyspark.sql import Window as W

    each = starts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("in_loop"), 2).otherwise(1))))
    first = each.withColumn("n", F.row_number().over(W.partitionBy("target").orderBy("parent_tid", "node_id", "pos", "copy")))
    name = F.when(F.col("n") == 1, F.col("target")).otherwise(F.concat_ws("#", "target", F.col("n").cast("string")))
    return first.select(name.alias("tid"), "parent_tid", "target", "node_id", F.col("pos").alias("s"), "copy")
