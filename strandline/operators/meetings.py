"""Pairs of rows of two threads, met at the threads' lowest common ancestor.

A row is set out once for every thread on its thread's way to the root. Two rows
whose ways reach one thread by different children have their lowest common
ancestor there, so every pair of related threads meets exactly once, and plain
columns tell whether the two may be parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import cut

#: Rows of one side that are kept while the other side's pass by; a group with more is dealt out over blocks of about so many.
BLOCK_ROWS = 1000
#: Pairs and rows that one task is meant for, and the most tasks of a join.
TASK_PAIRS, TASK_ROWS, MOST_TASKS = 500_000, 200_000, 2000


def ways(paths: DataFrame, states: tuple[str, ...] = ("",)) -> DataFrame:
    """tid, up, child, cs, cj: each thread on the way from tid to the root, tid too, and by which child, started and joined when; null at tid itself.

    With several states, starts and joins are structs with a field for each, and so cs and cj get their names.
    """
    each = paths.select("tid", "path", "starts", "joins", F.posexplode("path").alias("_i", "up"))
    nth = lambda c: F.get(c, F.col("_i") + 1)
    field = lambda c, v: nth(c)[v] if v else nth(c)
    times = [field(c, v).alias(f"{to}{v}") for v in states for c, to in (("starts", "cs"), ("joins", "cj"))]
    return each.select("tid", "up", nth("path").alias("child"), *times)


def siblings(a: str, b: str, v: str = "", distance: int | None = None) -> Column:
    """Rows below different children: neither child is joined before the other starts; with a distance, unjoined ones start at most that far apart."""
    c = lambda x, what: F.col(f"{x}_{what}{v}")
    before = lambda x, y: c(y, "cj").isNull() | (c(x, "cs") < c(y, "cj"))
    apart = (F.col(f"{a}_child") != F.col(f"{b}_child")) & before(a, b) & before(b, a)
    if distance is not None:
        apart &= c(a, "cj").isNotNull() | c(b, "cj").isNotNull() | (F.abs(c(a, "cs") - c(b, "cs")) <= distance)
    return apart


def within(pos: Column, start: Column, join: Column) -> Column:
    """An ancestor's event beside all below a child: after its start, before its join."""
    return (start < pos) & (join.isNull() | (pos < join))


def parallel(a: str, b: str, v: str = "", distance: int | None = None) -> Column:
    """Whether two rows that met at one thread may be parallel. Columns {x}_child, and for the state v {x}_pos, {x}_cs and {x}_cj."""
    c = lambda x, what: F.col(f"{x}_{what}{v}")
    below = lambda x, y: within(c(x, "pos"), c(y, "cs"), c(y, "cj"))
    own = lambda x: F.col(f"{x}_child").isNull()
    return F.when(own("a"), ~own("b") & below(a, b)).when(own("b"), below(b, a)).otherwise(siblings(a, b, v, distance))


def side(rows: DataFrame, x: str, on: list[str]) -> DataFrame:
    return rows.select(*on, *[F.col(c).alias(f"{x}_{c}") for c in rows.columns if c not in on])


def met(one: DataFrame, two: DataFrame, on: list[str], by: str, least: int = 1, block_rows: int | None = None) -> DataFrame:
    """Inner join of two written tables on `on`, in as many tasks as its pairs need.

    Rows of `one` are dealt by a hash of `by` over their group's blocks, and those of
    `two` go to each, so no key is one task's. Neither few bytes nor few keys make
    few tasks: sizes are counted first. A task keeps a block of `one` at a time.
    Groups with fewer rows of `two` than `least` are left out.
    """
    block_rows = block_rows or BLOCK_ROWS
    n, m = (x.groupBy(*on).agg(F.count(F.lit(1)).alias(c)) for x, c in ((one, "_n"), (two, "_m")))
    sizes = cut(n.join(m, on).filter(F.col("_m") >= least).withColumn("_blocks", F.ceil(F.col("_n") / block_rows).cast("int")))
    pairs, rows = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_m")), F.sum(F.col("_n") + F.col("_m") * F.col("_blocks"))).first()
    tasks = int(min(MOST_TASKS, max(1, (pairs or 0) // TASK_PAIRS, (rows or 0) // TASK_ROWS)))
    sizes = sizes.select(*on, "_blocks")
    left = two.join(sizes, on).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    right = one.join(sizes, on).withColumn("_block", F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")).drop("_blocks")
    key = [*on, "_block"]
    return left.repartition(tasks, *key).join(right.repartition(tasks, *key).hint("merge"), key).drop("_block")
