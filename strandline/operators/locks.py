"""Critical sections, locksets and lock order.

Within one thread and lock, events are ordered by position. All joins here have
the thread as an equality; a long thread is cut into bins of positions, so that
one thread's accesses are not paired with all its sections. Bins are as wide as
the sections are long, so a section lies in two of them at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The narrowest bins of the interval joins hold 2 ** NARROWEST positions.
NARROWEST = 6


def critical_sections(locks: DataFrame) -> DataFrame:
    """tid, lk, lo, hi: each acquisition with the next release of its lock in its thread; unreleased ones are left out.

    One window over (tid, lk), no join of acquisitions with releases. It runs
    backwards, so the least release so far is kept as it goes: linear in the events.
    A release at an acquisition's own position is none of its.
    """
    w = W.partitionBy("tid", "lk").orderBy(F.desc("pos"), "kind").rowsBetween(W.unboundedPreceding, -1)
    release = F.min(F.when(F.col("kind") == "UNLOCK", F.col("pos"))).over(w)
    return locks.withColumn("hi", release).filter("kind = 'LOCK' and hi is not null").select("tid", "lk", F.col("pos").alias("lo"), "hi")


def merged_sections(sections: DataFrame) -> DataFrame:
    """Sections of a (tid, lk) that end at one release are one: the earliest acquisition holds."""
    return sections.groupBy("tid", "lk", "hi").agg(F.min("lo").alias("lo"))


def ranked(points: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """points with _at, spans (_tid, lk, lo, hi) with _lo and _hi: the positions' dense ranks within their thread."""
    ends = [spans.select(F.col("_tid").alias("tid"), F.col(c).alias("pos")) for c in ("lo", "hi")]
    every = points.select("tid", "pos").unionByName(ends[0]).unionByName(ends[1]).distinct()
    rank = every.withColumn("_rank", F.dense_rank().over(W.partitionBy("tid").orderBy("pos")).cast("long"))
    named = lambda pos, to: rank.select(F.col("tid").alias("_t"), F.col("pos").alias("_p"), F.col("_rank").alias(to)).alias(pos)
    at = points.join(named("at", "_at"), (F.col("tid") == F.col("_t")) & (F.col("pos") == F.col("_p"))).drop("_t", "_p")
    for c in ("lo", "hi"):
        spans = spans.join(named(c, f"_{c}"), (F.col("_tid") == F.col("_t")) & (F.col(c) == F.col("_p"))).drop("_t", "_p")
    return at, spans


def inside(points: DataFrame, sections: DataFrame) -> DataFrame:
    """points (tid, pos, ...) with lk, lo, hi of every section that strictly holds them.

    A section of length n lies in bins of a width above n: two of them. A point
    looks in one bin for each width that its thread has. Positions other than
    whole numbers are ranked first.
    """
    spans = sections.select(F.col("tid").alias("_tid"), "lk", "lo", "hi")
    if dict(points.dtypes)["pos"] in ("int", "bigint"):
        points, spans = points.withColumn("_at", F.col("pos").cast("long")), spans.withColumn("_lo", F.col("lo").cast("long")).withColumn("_hi", F.col("hi").cast("long"))
    else:
        points, spans = ranked(points, spans)
    spans = spans.withColumn("_wide", F.greatest(F.lit(NARROWEST), F.length(F.bin(F.col("_hi") - F.col("_lo")))))
    widths = spans.groupBy(F.col("_tid").alias("_of")).agg(F.collect_set("_wide").alias("_widths"))
    shifted = lambda c: F.expr(f"shiftright({c}, _wide)")
    binned = spans.withColumn("_bin", F.explode(F.sequence(shifted("_lo"), shifted("_hi")))).withColumnRenamed("_wide", "_wide0")
    keyed = points.join(widths, F.col("tid") == F.col("_of")).withColumn("_wide", F.explode("_widths")).withColumn("_bin0", shifted("_at"))
    within = (F.col("_lo") < F.col("_at")) & (F.col("_at") < F.col("_hi"))
    met = keyed.join(binned, (F.col("tid") == F.col("_tid")) & (F.col("_wide") == F.col("_wide0")) & (F.col("_bin0") == F.col("_bin")) & within)
    return met.drop("_of", "_widths", "_wide", "_bin0", "_at", "_tid", "_lo", "_hi", "_wide0", "_bin")


def locksets(accesses: DataFrame, sections: DataFrame) -> DataFrame:
    """Distinct (idx, lk): the locks held at each access."""
    return inside(accesses.select("idx", "tid", "pos"), merged_sections(sections)).select("idx", "lk").distinct()


def with_locksets(accesses: DataFrame, sections: DataFrame) -> DataFrame:
    """accesses with locks: a sorted array, empty without any; as long as locks are nested."""
    held = inside(accesses.select("idx", "tid", "pos"), merged_sections(sections))
    sets = held.groupBy(F.col("idx").alias("_idx"), F.col("tid").alias("_tid"), F.col("pos").alias("_pos")).agg(F.array_sort(F.collect_set("lk")).alias("locks"))
    kind = dict(sections.dtypes)["lk"]
    same = (F.col("idx") == F.col("_idx")) & (F.col("tid") == F.col("_tid")) & (F.col("pos") == F.col("_pos"))
    return accesses.join(sets, same, "left").drop("_idx", "_tid", "_pos").withColumn("locks", F.coalesce("locks", F.array().cast(f"array<{kind}>")))


def nested_acquisitions(sections: DataFrame) -> DataFrame:
    """tid, l1, p1, l2, p2: l2 is acquired at p2 while l1, acquired at p1, is held; the same lock again doesn't count."""
    taken = sections.select("tid", F.col("lo").alias("pos"), F.col("lk").alias("l2"))
    held = merged_sections(sections)
    return inside(taken, held).filter("lk <> l2").select("tid", F.col("lk").alias("l1"), F.col("lo").alias("p1"), "l2", F.col("pos").alias("p2")).distinct()


def lock_order(sections: DataFrame) -> DataFrame:
    """Distinct (tid, l1, l2): thread tid acquires l2 while it holds l1."""
    return nested_acquisitions(sections).select("tid", "l1", "l2").distinct()


def caller_locks(held: DataFrame, callers: DataFrame, hops: int = 5) -> DataFrame:
    """Distinct (node, lk) that every call of a node holds, through at most so many callers.

    held: (caller, call, lk), the locks at a call site; callers: (caller, call,
    node). A lock protects a node only if each of its call sites holds it, itself
    or by its own caller. Calls outside `callers` (thread entries) hold nothing.
    """
    sites = callers.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    known = None
    for _ in range(hops):
        own = callers.join(held, ["caller", "call"]).select("node", "caller", "call", "lk")
        if known is not None:
            up = callers.join(known.select(F.col("node").alias("caller"), "lk"), "caller").select("node", "caller", "call", "lk")
            own = own.unionByName(up)
        counted = own.distinct().groupBy("node", "lk").agg(F.count(F.lit(1)).alias("k"))
        known = counted.join(sites, "node").filter("k = n").select("node", "lk")
    return known
