"""Detection as a whole, on fact tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import cut
from strandline.functions.signatures import race_message
from strandline.operators import changes, deadlocks, locks, meetings, partners, races, relations, threads
from strandline.sources.facts import Facts

#: Threads' paths are broadcast up to so many entries of their arrays, some 30 MB; with more, accesses are joined with them by shuffle.
MAX_BROADCAST_STEPS = 300_000


def small(paths: DataFrame, most: int = MAX_BROADCAST_STEPS) -> DataFrame:
    """paths, to be broadcast if their arrays are short enough in all."""
    steps = paths.agg(F.sum(F.size("path"))).first()[0] or 0
    return F.broadcast(paths) if steps <= most else paths.hint("merge")


def _with_locks(accesses: DataFrame, facts: Facts) -> DataFrame:
    return locks.with_locksets(accesses, locks.critical_sections(facts.locks))


def placed(facts: Facts) -> DataFrame:
    """Accesses to shared variables with their locks, ready to be paired. Written once, as pairs read them twice."""
    return cut(_with_locks(races.nonlocal_accesses(facts.accesses), facts).drop("n_writes"))


def unprotected_pairs(facts: Facts) -> DataFrame:
    return races.unprotected(races.pairs(placed(facts)))


def _ways(facts: Facts, paths: DataFrame | None = None) -> DataFrame:
    return meetings.ways(small(threads.thread_paths(facts.threads) if paths is None else paths))


def _racing(facts: Facts, distance: int | None = None, paths: DataFrame | None = None) -> DataFrame:
    return races.racing(placed(facts), _ways(facts, paths), distance)


def detect_races(facts: Facts, distance: int | None = None, paths: DataFrame | None = None) -> DataFrame:
    """sig, idx1, idx2, tid1, tid2, kind1, kind2, loc1, loc2: conflicting, unprotected, parallel."""
    return races.named(_racing(facts, distance, paths))


def racing_accesses(facts: Facts, distance: int | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Distinct (idx, tid) of the accesses of all races, which are not formed for it."""
    return partners.racing_accesses(placed(facts), _ways(facts, paths), distance)


def race_numbers(facts: Facts, distance: int | None = None) -> DataFrame:
    """sig, n_races, n_first of all races, which are not formed for it."""
    return partners.race_numbers(placed(facts), _ways(facts), distance)


def _apart(facts: Facts, crowded: Column | None = None, distance: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(races of accesses that are alone at their places, all other races); each is formed once. crowded: what else makes an access count as not alone."""
    ready = races.with_crowded(placed(facts))
    ready = cut(ready if crowded is None else ready.withColumn("crowded", F.col("crowded") | crowded))
    up = _ways(facts)
    return races.named(races.racing(ready.filter("not crowded"), up, distance)), races.named(races.racing_some(ready, up, "crowded", distance))


def distinct_races(facts: Facts, distance: int | None = None) -> DataFrame:
    """sig, p1, p2, n_pairs. Races of accesses that are alone at their places are not moved."""
    single, rest = _apart(facts, distance=distance)
    return races.distinct_races(rest, single)


def markers(facts: Facts, shown: str, added: str, removed: str, distance: int | None = None) -> DataFrame:
    """Distinct messages of the shown races, less those of removed ones, and of added ones (conditions on races).

    A message with no more brackets and commas than its own tells sig and places, so that of two accesses alone at
    their places is one race's: its own columns decide, and it isn't moved. Others are grouped by message.
    """
    unclear = F.coalesce(F.col("sig").rlike("[(,]") | F.col("loc").rlike("[(,]"), F.lit(True))
    single, rest = _apart(facts, unclear, distance)
    said = lambda df: df.select(race_message(F.col("sig"), F.col("loc1"), F.col("loc2")).alias("message"), *[F.coalesce(F.expr(c), F.lit(False)).alias(n) for n, c in (("shown", shown), ("added", added), ("removed", removed))])
    grouped = said(rest).groupBy("message").agg(*[F.bool_or(c).alias(c) for c in ("shown", "added", "removed")])
    # A message that is null equals no removed one.
    return said(single).unionByName(grouped).filter("added or shown and (message is null or not removed)").select("message")


def race_relations(facts: Facts) -> DataFrame:
    """sig, write, n, concurrent of all races, which are not formed for it."""
    return relations.relations(placed(facts), small(threads.thread_paths(facts.threads)))


def moved_races(facts: Facts, lines: DataFrame, distance: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(removed, added) races whose places got new lines (loc, new_loc). Accesses get them before they are paired, so no race is joined with a line."""
    at = facts.accesses.join(lines.select("loc", "new_loc"), "loc", "left")
    both = races.named(_racing(facts.with_(accesses=at), distance).filter("a_new_loc is not null or b_new_loc is not null"), "new_loc")
    new = both.withColumns({f"loc{i}": F.coalesce(f"new_loc{i}", f"loc{i}") for i in (1, 2)})
    return both.drop("new_loc1", "new_loc2"), new.drop("new_loc1", "new_loc2")


def detect_deadlocks(facts: Facts, gated: bool = False) -> DataFrame:
    """tid1, tid2, l1, l2."""
    return deadlocks.deadlocks(locks.critical_sections(facts.locks), _ways(facts), gated)


@dataclass(frozen=True)
class Detection:
    races: DataFrame
    deadlocks: DataFrame


def detect(facts: Facts, distance: int | None = None, gated: bool = False) -> Detection:
    return Detection(detect_races(facts, distance), detect_deadlocks(facts, gated))


def interest_variables(facts: Facts, locks_changed: DataFrame, threads_changed: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Distinct (sig) accessed under a changed lock (lk), or in a changed thread (tid) or one below it."""
    paths = threads.thread_paths(facts.threads) if paths is None else paths
    under = locks.locksets(facts.accesses, locks.critical_sections(facts.locks)).join(locks_changed.select("lk"), "lk", "left_semi")
    one = facts.accesses.join(under, "idx", "left_semi").select("sig")
    two = facts.accesses.join(threads.under(paths, threads_changed), "tid", "left_semi").select("sig")
    return one.unionByName(two).distinct()


def changed_threads(before: Facts, after: Facts, old_paths: DataFrame, new_paths: DataFrame) -> DataFrame | None:
    """Distinct (tid) of threads whose start, join or parent changed, and of all below them, as their order hangs on it; None if none can have."""
    if before.threads is after.threads:
        return None
    tids = cut(changes.interest(before.threads, after.threads, "tid"))
    return threads.under(old_paths, tids).unionByName(threads.under(new_paths, tids)).distinct()


def _both_paths(before: Facts, after: Facts) -> tuple[DataFrame, DataFrame]:
    old = threads.thread_paths(before.threads)
    return old, old if after.threads is before.threads else threads.thread_paths(after.threads)


#: The two states of a change, as endings of columns.
STATES = ("_old", "_new")


def paths_of_both(before: Facts, after: Facts) -> DataFrame | None:
    """Paths whose starts and joins are structs of both states; None if a thread comes, goes or gets another parent."""
    both = lambda c, o, n: F.struct(o.alias(STATES[0]), n.alias(STATES[1])).alias(c)
    if before.threads is after.threads:
        t = before.threads.select("tid", "ptid", *[both(c, F.col(c), F.col(c)) for c in ("s", "j")])
    else:
        o, n = (f.threads.select("tid", *[F.col(c).alias(f"{c}{v}") for c in ("ptid", "s", "j")], F.lit(True).alias(f"is{v}")) for f, v in ((before, STATES[0]), (after, STATES[1])))
        t = cut(o.join(n, "tid", "full"))
        if not t.filter("is_old is null or is_new is null or not ptid_old <=> ptid_new").isEmpty():
            return None
        t = t.select("tid", F.col("ptid_old").alias("ptid"), *[both(c, F.col(f"{c}_old"), F.col(f"{c}_new")) for c in ("s", "j")])
    return threads.thread_paths(t)


#: Variables of a delta that are broadcast to find their accesses.
MAX_DELTA_KEYS = 50_000


def race_changes(before: Facts, after: Facts) -> tuple[DataFrame, DataFrame]:
    """(added, removed) races between two states; only variables whose accesses changed are judged again.

    If locks or threads aren't the same table, every variable of a thread counts as
    changed whose locks differ, or whose start, join or parent, or an ancestor's, do.
    Both states are judged at once, in pairs with a change; only if threads come, go
    or get other parents, the races of both are compared.
    """
    old_accesses, new_accesses = cut(before.accesses), cut(after.accesses)
    keys = changes.interest(old_accesses, new_accesses, "sig")
    old_paths, new_paths = _both_paths(before, after)
    moved = changed_threads(before, after, old_paths, new_paths)
    if before.locks is not after.locks:
        tids = changes.interest(before.locks, after.locks, "tid")
        moved = tids if moved is None else moved.unionByName(tids)
    if moved is not None:
        touched = old_accesses.unionByName(new_accesses).join(moved.distinct(), "tid", "left_semi").select("sig")
        keys = keys.unionByName(touched).distinct()
    keys = cut(keys)
    old, new = (f.with_(accesses=changes.only(a, keys, "sig")) for f, a in ((before, old_accesses), (after, new_accesses)))
    paths = paths_of_both(before, after)
    if paths is None:
        return changes.difference(detect_races(old, paths=old_paths), detect_races(new, paths=new_paths))
    marked = [f.accesses.withColumns({f"in{w}": F.lit(v == w) for w in STATES}) for f, v in ((old, STATES[0]), (new, STATES[1]))]
    if before.locks is after.locks:
        return _changed(_with_locks(marked[0].unionByName(marked[1]), before), paths)
    return _changed(_with_locks(marked[0], before).unionByName(_with_locks(marked[1], after)), paths)


def _changed(sides: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) races of accesses with locks, in_old and in_new. An access is one row, with its position and locks in each state."""
    at = lambda c, v: F.max(F.when(F.col(f"in{v}"), F.col(c))).alias(f"{c}{v}")
    ready = sides.groupBy("idx", "tid", "kind", "sig", "loc").agg(*[F.bool_or(f"in{v}").alias(f"in{v}") for v in STATES], *[at(c, v) for c in ("pos", "locks") for v in STATES])
    added, removed = races.changed_races(ready, meetings.ways(small(paths), STATES), STATES)
    return races.named(added), races.named(removed)


def race_delta(before: Facts, removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) races after accesses are removed (by idx) and added; locks and threads stay.

    A pair is judged by itself, so only pairs with a changed access are formed:
    what the delta doesn't touch is neither derived nor compared. An access that
    is removed and added again with other columns counts as changed.
    """
    columns = before.accesses.columns
    delta = cut(changes.net(before.accesses, removed, added))
    keys = F.broadcast(delta.select("sig").distinct()) if delta.count() <= MAX_DELTA_KEYS else delta.select("sig").distinct()
    concerned = changes.only(before.accesses, keys, "sig")
    gone, new = delta.filter("not new"), delta.filter("new")
    marked = lambda df, old, now: df.select(*columns, F.lit(old).alias("in_old"), F.lit(now).alias("in_new"))
    both = marked(concerned.join(gone.select("idx"), "idx", "left_anti"), True, True).unionByName(marked(gone, True, False)).unionByName(marked(new, False, True))
    return _changed(_with_locks(both, before), paths_of_both(before, before))


def deadlock_changes(before: Facts, after: Facts, gated: bool = False) -> tuple[DataFrame, DataFrame]:
    """(added, removed) deadlocks; only threads that share a lock with a changed thread are judged again. Threads below one whose start or join changed count as changed."""
    old_locks, new_locks = cut(before.locks), cut(after.locks)
    tids = changes.interest(old_locks, new_locks, "tid")
    moved = changed_threads(before, after, *_both_paths(before, after)) if before.threads is not after.threads else None
    tids = tids if moved is None else tids.unionByName(moved).distinct()
    every = old_locks.unionByName(new_locks)
    concerned = every.join(tids, "tid", "left_semi").select("lk").distinct()
    near = cut(every.join(concerned, "lk", "left_semi").select("tid").distinct())
    old, new = (f.with_(locks=changes.only(k, near, "tid")) for f, k in ((before, old_locks), (after, new_locks)))
    paths = paths_of_both(before, after)
    if paths is None:
        return changes.difference(detect_deadlocks(old, gated), detect_deadlocks(new, gated))
    sections = tuple(locks.critical_sections(f.locks) for f in (old, new))
    return deadlocks.changed_deadlocks(sections, meetings.ways(small(paths), STATES), gated)
