"""Deadlocks: opposite lock orders of two threads."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import cut

from . import changes
from .locks import inside, merged_sections, nested_acquisitions
from .meetings import met, side, siblings, within

ORDER = ["tid", "l1", "l2"]
FOUND = ["tid1", "tid2", "l1", "l2"]


def _opposite(order: DataFrame) -> DataFrame:
    return order.select(F.col("l2").alias("l1"), F.col("l1").alias("l2"), *[c for c in order.columns if c not in ("l1", "l2")])


def _both_ways(order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders that take the lesser lock first, and all others under the opposite one's l1, l2: each pair of opposite orders once."""
    return order.filter("l1 < l2"), _opposite(order.filter("l1 > l2"))


def _found(pairs: DataFrame) -> DataFrame:
    """tid1, tid2, l1, l2 of pairs in which a takes l1 then l2; tid1 < tid2, and l1, l2 as thread 1 takes them."""
    first = F.col("a_tid") < F.col("b_tid")
    return pairs.select(F.least("a_tid", "b_tid").alias("tid1"), F.greatest("a_tid", "b_tid").alias("tid2"), F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l1"), F.when(first, F.col("l2")).otherwise(F.col("l1")).alias("l2"))


def candidates(order: DataFrame) -> DataFrame:
    """tid1, tid2, l1, l2: thread 1 takes l1 then l2, thread 2 the other way round; tid1 < tid2."""
    order = cut(order)
    on = ["l1", "l2"]
    return met(side(order, "a", on), side(_opposite(order), "b", on), on, "a_tid").filter("a_tid < b_tid").select(F.col("a_tid").alias("tid1"), F.col("b_tid").alias("tid2"), *on)


def with_gates(sections: DataFrame) -> DataFrame:
    """Nested acquisitions with gates: the other locks held at the outer one's acquisition."""
    nested = nested_acquisitions(sections)
    outer = nested.select("tid", F.col("p1").alias("pos"), F.col("l1").alias("_l1")).distinct()
    held = inside(outer, merged_sections(sections)).filter("lk <> _l1").groupBy(F.col("tid").alias("_tid"), F.col("pos").alias("_pos"), F.col("_l1").alias("_of")).agg(F.array_sort(F.collect_set("lk")).alias("gates"))
    kind = dict(sections.dtypes)["lk"]
    same = (F.col("tid") == F.col("_tid")) & (F.col("p1") == F.col("_pos")) & (F.col("l1") == F.col("_of"))
    return nested.join(held, same, "left").drop("_tid", "_pos", "_of").withColumn("gates", F.coalesce("gates", F.array().cast(f"array<{kind}>")))


def _orders(nested: DataFrame, gated: bool, v: str = "") -> DataFrame:
    """One row for each order that a thread has, with all its sets of gates: those that hold no other one."""
    if not gated:
        return nested.select(*ORDER).distinct()
    within_another = lambda x: F.exists("_g", lambda y: (y != x) & (F.size(F.array_except(y, x)) == 0))
    return nested.groupBy(*ORDER).agg(F.collect_set("gates").alias("_g")).select(*ORDER, F.filter("_g", lambda x: ~within_another(x)).alias(f"gates{v}"))


def _ungated(a: Column, b: Column) -> Column:
    """Some set of a's gates has none in common with some set of b's. One that has an empty set has no other."""
    free = lambda g: F.size(g[0]) == 0
    return free(a) | free(b) | F.exists(a, lambda x: F.exists(b, lambda y: ~F.arrays_overlap(x, y)))


#: Locks with a bit of their own in masks of gates, the most frequent ones (bit 0 is all others'), and the masks of an order.
OWN_BITS, MASKS = 62, 4


def _masked(orders: DataFrame) -> DataFrame:
    """orders with m0, m1, ...: their sets of gates as bits, and plain: whether these tell all, as each set has a mask and each lock its bit.

    Where an order has fewer sets, the rest are -1, which has no bit in common with an empty set alone.
    """
    used = orders.select(F.explode(F.flatten("gates")).alias("lk")).groupBy("lk").agg(F.count(F.lit(1)).alias("n"))
    own = used.orderBy(F.desc("n"), "lk").limit(OWN_BITS).agg(F.array_sort(F.collect_list("lk")).alias("_own"))
    bit = lambda lk: F.call_function("shiftleft", F.lit(1).cast("long"), F.array_position("_own", lk).cast("int"))
    masks = F.transform("gates", lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda so_far, lk: so_far.bitwiseOR(bit(lk))))
    each = orders.crossJoin(F.broadcast(own)).withColumn("_m", masks).drop("_own")
    plain = (F.size("_m") <= MASKS) & ~F.exists("_m", lambda m: m.bitwiseAND(F.lit(1)) != 0)
    return each.withColumns({f"m{i}": F.coalesce(F.get("_m", F.lit(i)), F.lit(-1).cast("long")) for i in range(MASKS)} | {"plain": plain}).drop("_m")


def _ungated_masks() -> Column:
    """_ungated of plain orders a and b, without functions that keep Spark from compiling the join."""
    return reduce(or_, [F.col(f"a_m{i}").bitwiseAND(F.col(f"b_m{j}")) == 0 for i in range(MASKS) for j in range(MASKS)])


def _of_siblings(placed: DataFrame, gated: bool) -> DataFrame:
    """Deadlocks of threads that are no ancestors of each other. Gates of plain orders are compared as masks, others one by one."""
    on = ["up", "l1", "l2"]
    pairs = lambda a, b: met(side(a, "a", on), side(b, "b", on), on, "a_tid").filter(siblings("a", "b"))
    one, two = _both_ways(placed)
    if not gated:
        return _found(pairs(one, two))
    (a, x), (b, y) = ((df.filter("plain"), df.filter("not plain")) for df in (one, two))
    bits = [f"m{i}" for i in range(MASKS)]
    found = _found(pairs(a.drop("plain", "gates"), b.drop("plain", "gates")).filter(_ungated_masks()))
    if placed.filter("not plain").isEmpty():
        return found
    for left, right in ((x, two), (a, y)):
        found = found.unionByName(_found(pairs(left.drop("plain", *bits), right.drop("plain", *bits)).filter(_ungated(F.col("a_gates"), F.col("b_gates")))))
    return found


def _of_ancestors(nested: DataFrame, orders: DataFrame, up: DataFrame, gated: bool) -> DataFrame:
    """Deadlocks of a thread with one below it: its acquisitions count one by one, both must lie between the child's start and join."""
    on = ["up", "l1", "l2"]
    below = cut(_opposite(orders).join(up.filter("child is not null"), "tid"))
    own = cut(nested.withColumn("up", F.col("tid")))
    at = met(side(own, "a", on), side(below, "b", on), on, "a_p1")
    for p in ("a_p1", "a_p2"):
        at = at.filter(within(F.col(p), F.col("b_cs"), F.col("b_cj")))
    if gated:
        at = at.filter(_ungated(F.array("a_gates"), F.col("b_gates")))
    return _found(at).distinct()


def _nested(sections: DataFrame, gated: bool) -> DataFrame:
    return cut(with_gates(sections) if gated else nested_acquisitions(sections))


def deadlocks(sections: DataFrame, up: DataFrame, gated: bool = False) -> DataFrame:
    """tid1, tid2, l1, l2 of deadlocks whose outer and inner acquisitions may be parallel.

    up as of meetings.ways. gated: pairs that a further lock, held by both threads,
    keeps apart are left out. Threads that are no ancestors of each other are parallel or not as a whole, so
    one row for each order that a thread has is enough: their pairs need no distinct.
    """
    nested = _nested(sections, gated)
    orders = cut(_orders(nested, gated))
    placed = cut((_masked(orders) if gated else orders).join(up.filter("child is not null"), "tid"))
    return _of_siblings(placed, gated).unionByName(_of_ancestors(nested, orders, up, gated))


def changed_deadlocks(sections: tuple[DataFrame, DataFrame], up: DataFrame, gated: bool = False) -> tuple[DataFrame, DataFrame]:
    """(added, removed) deadlocks between two states, _old and _new, of the sections and of up's cs and cj.

    Only pairs with a changed order, or a child whose start or join changed, are
    formed, and each is judged in both states at once: no findings are compared but
    those of ancestors, of which there are few.
    """
    states = ("_old", "_new")
    nested = [_nested(s, gated) for s in sections]
    orders = [cut(_orders(n, gated, v)) for n, v in zip(nested, states)]
    each = orders[0].withColumns({"in_old": F.lit(True), "in_new": F.lit(False)}).unionByName(orders[1].withColumns({"in_old": F.lit(False), "in_new": F.lit(True)}), allowMissingColumns=True)
    known = each.groupBy(*ORDER).agg(*[f(c).alias(c) for v in states for f, c in ((F.bool_or, f"in{v}"), *([(F.max, f"gates{v}")] if gated else []))])
    other = lambda what: ~F.col(f"{what}_old").eqNullSafe(F.col(f"{what}_new"))
    changed = other("in") | other("cs") | other("cj") | (other("gates") if gated else F.lit(False))
    placed = cut(known.join(up.filter("child is not null"), "tid").withColumn("changed", changed))
    on = ["up", "l1", "l2"]
    # The changed row is the first of a pair; where both are, each is the first once and the lesser thread's counts.
    pairs = met(side(placed.filter("changed"), "a", on), side(_opposite(placed), "b", on), on, "a_tid").filter("not b_changed or a_tid < b_tid")

    def holds(v: str) -> Column:
        known = F.col(f"a_in{v}") & F.col(f"b_in{v}") & siblings("a", "b", v)
        return known & _ungated(F.col(f"a_gates{v}"), F.col(f"b_gates{v}")) if gated else known

    seen = lambda v: F.coalesce(holds(v), F.lit(False))
    of = lambda i, v: _of_ancestors(nested[i], orders[i].withColumnRenamed(f"gates{v}", "gates"), up.withColumnsRenamed({f"cs{v}": "cs", f"cj{v}": "cj"}).select("tid", "up", "child", "cs", "cj"), gated)
    added, removed = changes.difference(of(0, "_old"), of(1, "_new"))
    return _found(pairs.filter(seen("_new") & ~seen("_old"))).unionByName(added), _found(pairs.filter(seen("_old") & ~seen("_new"))).unionByName(removed)
