"""Shared variables and data races."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import cut

from . import meetings

#: Writes of a variable that one task pairs at a time; a variable with more is split into blocks of about so many.
BLOCK_WRITES = 1000


def access_counts(accesses: DataFrame) -> DataFrame:
    """sig, tid, reads, writes."""
    return accesses.groupBy("sig", "tid").agg(F.count_if(F.col("kind") == "READ").alias("reads"), F.count_if(F.col("kind") == "WRITE").alias("writes"))


def method_counts(events: DataFrame) -> DataFrame:
    """sig, tid, read_methods, write_methods: the distinct methods (node_id) by which a thread touches a variable."""
    of = lambda kind: F.countDistinct(F.when(F.col("kind") == kind, F.col("node_id")))
    return events.groupBy("sig", "tid").agg(of("READ").alias("read_methods"), of("WRITE").alias("write_methods"))


def counts_after(counts: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """access_counts after an edit, from those before it and the accesses that go and come; groups that come to nothing fall away."""
    less = access_counts(removed).withColumns({c: -F.col(c) for c in ("reads", "writes")})
    every = counts.unionByName(less).unionByName(access_counts(added))
    return every.groupBy("sig", "tid").agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes")).filter("reads > 0 or writes > 0")


def _shared(accesses: DataFrame) -> DataFrame:
    per_thread = access_counts(accesses)
    return per_thread.groupBy("sig").agg(F.count(F.lit(1)).alias("n_threads"), F.sum("writes").alias("n_writes")).filter("n_threads > 1 and n_writes > 0")


def shared_vars(accesses: DataFrame) -> DataFrame:
    """sig, n_threads of variables that are written, and touched by two threads at least."""
    return _shared(accesses).drop("n_writes")


def nonlocal_accesses(accesses: DataFrame) -> DataFrame:
    """Accesses to shared variables, with n_writes of the variable: a join that shrinks what is paired."""
    return accesses.join(_shared(accesses).select("sig", "n_writes"), "sig")


def pairs(accesses: DataFrame) -> DataFrame:
    """Conflicting pairs of different threads: a write with each read, and with each later write. Columns a_*, b_*, sig.

    The writes of a hot variable are dealt out over blocks, so no task has them
    all; its accesses go to every block.
    """
    one, two = (meetings.side(accesses.drop("n_writes"), x, ["sig"]) for x in ("a", "b"))
    met = meetings.met(one.filter("a_kind = 'WRITE'"), two, ["sig"], "a_idx", 2, BLOCK_WRITES)
    return met.filter("a_tid <> b_tid and (b_kind = 'READ' or a_idx < b_idx)")


def free(a: str, b: str, v: str = "") -> Column:
    """No common lock; where one side holds none, nothing is compared."""
    x, y = F.col(f"{a}_locks{v}"), F.col(f"{b}_locks{v}")
    return (F.size(x) == 0) | (F.size(y) == 0) | ~F.arrays_overlap(x, y)


def race_candidates(accesses: DataFrame) -> DataFrame:
    """sig, wi, xi."""
    return pairs(cut(nonlocal_accesses(accesses).select("idx", "tid", "kind", "sig"))).select("sig", F.col("a_idx").alias("wi"), F.col("b_idx").alias("xi"))


def unprotected(candidates: DataFrame) -> DataFrame:
    """Pairs without a common lock. Locksets travel with the accesses, so no pair is joined again."""
    return candidates.filter(free("a", "b"))


#: Where rows of two threads meet: at a variable and a thread on both ways.
ON = ["sig", "up"]


def placed_ways(ready: DataFrame, up: DataFrame) -> DataFrame:
    """Accesses at every thread on their way to the root, written. Variables are left out wherever one child alone of a thread touches them."""
    placed = ready.join(up, "tid")
    child = F.coalesce(F.col("child"), F.col("up"))
    apart = placed.groupBy(*ON).agg(F.min(child).alias("_x"), F.max(child).alias("_y")).filter("_x <> _y").select(*ON)
    return cut(placed.join(apart, ON))


def racing(ready: DataFrame, up: DataFrame, distance: int | None = None) -> DataFrame:
    """Pairs a_*, b_* of unprotected accesses that no start or join orders; ready: accesses with locks, up as of meetings.ways.

    Each pair meets once, at its threads' lowest common ancestor.
    """
    placed = placed_ways(ready, up)
    one, two = (meetings.side(placed, x, ON) for x in ("a", "b"))
    met = meetings.met(one.filter("a_kind = 'WRITE'"), two, ON, "a_idx", 2)
    return met.filter((F.col("b_kind") == "READ") | (F.col("a_idx") < F.col("b_idx"))).filter(meetings.parallel("a", "b", "", distance) & free("a", "b"))


def racing_some(ready: DataFrame, up: DataFrame, which: str, distance: int | None = None) -> DataFrame:
    """As racing, but only pairs with an access for which the boolean column `which` holds."""
    placed = placed_ways(ready, up)
    one, two = (meetings.side(placed, x, ON) for x in ("a", "b"))
    met = meetings.met(one.filter(f"a_{which}"), two, ON, "a_idx", 2).filter(f"(a_kind = 'WRITE' or b_kind = 'WRITE') and (not b_{which} or a_idx < b_idx)")
    return met.filter(meetings.parallel("a", "b", "", distance) & free("a", "b"))


def with_crowded(accesses: DataFrame) -> DataFrame:
    """accesses with `crowded`: whether another one to the variable has the same place. Two that are not have a race that no other one looks like."""
    places = accesses.groupBy("sig", "loc").agg((F.count(F.lit(1)) > 1).alias("crowded"))
    return accesses.join(places, ["sig", "loc"], "left").withColumn("crowded", F.coalesce("crowded", F.lit(True)))


def changed_races(ready: DataFrame, up: DataFrame, states: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(added, removed) pairs between two states.

    ready: accesses of both states, with in, pos and locks of each; up with cs and cj
    of each. Only pairs are formed of which an access, or the way that leads to its
    thread from the common ancestor, changed. Each is judged in both states at once,
    so no findings are compared.
    """
    other = lambda what: ~F.col(f"{what}{states[0]}").eqNullSafe(F.col(f"{what}{states[1]}"))
    changed = other("in") | other("pos") | other("locks") | other("cs") | other("cj")
    on = ["sig", "up"]
    placed = cut(ready.join(up, "tid").withColumn("changed", changed))
    one, two = (meetings.side(placed, x, on) for x in ("a", "b"))
    met = meetings.met(one.filter("a_changed"), two, on, "a_idx", 2).filter("a_tid <> b_tid and (a_kind = 'WRITE' or b_kind = 'WRITE') and (not b_changed or a_idx < b_idx)")
    holds = lambda v: F.coalesce(F.col(f"a_in{v}") & F.col(f"b_in{v}") & meetings.parallel("a", "b", v) & free("a", "b", v), F.lit(False))
    old, new = (holds(v) for v in states)
    return met.filter(new & ~old), met.filter(old & ~new)


def named(candidates: DataFrame, *more: str) -> DataFrame:
    """Each race once: sig, the two accesses with the smaller idx first, their threads, kinds and places, and further columns."""
    first = F.col("a_idx") < F.col("b_idx")
    pick = lambda c: (F.when(first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"{c}1"), F.when(first, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"{c}2"))
    return candidates.select("sig", *pick("idx"), *pick("tid"), *pick("kind"), *pick("loc"), *[c for m in more for c in pick(m)])


def _ends(races: DataFrame) -> DataFrame:
    return races.withColumn("p1", F.least("loc1", "loc2")).withColumn("p2", F.greatest("loc1", "loc2"))


def distinct_races(races: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """One row for each variable and unordered pair of places. single: further races that are known to be the only ones between their places."""
    grouped = _ends(races).groupBy("sig", "p1", "p2").agg(F.count(F.lit(1)).alias("n_pairs"))
    return grouped if single is None else grouped.unionByName(_ends(single).select("sig", "p1", "p2", F.lit(1).cast("long").alias("n_pairs")))


def relations(races: DataFrame) -> DataFrame:
    """sig, write, n, concurrent: for every racing write the accesses concurrent to it, in order."""
    one = races.filter("kind1 = 'WRITE'").select("sig", F.col("idx1").alias("write"), F.col("idx2").alias("other"), F.col("kind2").alias("kind"))
    two = races.filter("kind2 = 'WRITE'").select("sig", F.col("idx2").alias("write"), F.col("idx1").alias("other"), F.col("kind1").alias("kind"))
    grouped = one.unionByName(two).groupBy("sig", "write").agg(F.array_sort(F.collect_set(F.struct("other", "kind"))).alias("c"))
    return grouped.select("sig", "write", F.size("c").alias("n"), F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["other"].cast("string"), x["kind"])), ",").alias("concurrent"))
