"""Detection on hand-made facts: a small program, each case of the happens-before rule, locks and deltas."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import changes, deadlocks, explain, locks, meetings, races, threads
from strandline.plans import detect
from strandline.sources.facts import Facts

ACCESS = "idx long, tid long, pos long, kind string, sig string, loc string"
LOCK = "idx long, tid long, pos long, kind string, lk string"
THREAD = "tid long, ptid long, s long, j long"


def facts(spark, accesses, locked, forest):
    """accesses: (tid, pos, kind, sig); locked: (tid, pos, kind, lk)."""
    a = [(i, t, p, k, s, f"{t}:{p}") for i, (t, p, k, s) in enumerate(accesses)]
    lk = [(i, *x) for i, x in enumerate(locked)]
    return Facts(spark.createDataFrame(a, ACCESS), spark.createDataFrame(lk, LOCK), spark.createDataFrame(forest, THREAD))


def found(f, **options):
    return sorted((r.sig, *sorted((r.loc1, r.loc2))) for r in detect.detect_races(f, **options).collect())


@pytest.fixture(scope="module")
def example(spark):
    """main (1) starts run (2) at 0 and joins it at 7; both take two locks, in opposite order."""
    accesses = [(1, 2, "WRITE", "Example.y"), (1, 4, "WRITE", "Example.x"), (1, 8, "READ", "Example.z"), (2, 0, "READ", "Example.lock"), (2, 2, "READ", "Example.y"), (2, 4, "READ", "Example.x"), (2, 5, "READ", "Example.y"), (2, 8, "WRITE", "Example.z")]
    locked = [(1, 1, "LOCK", "L3"), (1, 3, "LOCK", "L"), (1, 5, "UNLOCK", "L"), (1, 6, "UNLOCK", "L3"), (2, 1, "LOCK", "L"), (2, 3, "LOCK", "L3"), (2, 6, "UNLOCK", "L3"), (2, 7, "UNLOCK", "L")]
    return facts(spark, accesses, locked, [(1, None, 0, None), (2, 1, 0, 7)])


def test_example_has_one_race_and_one_deadlock(example):
    assert found(example) == [("Example.y", "1:2", "2:2")]
    assert [tuple(r) for r in detect.detect_deadlocks(example).select("tid1", "tid2", "l1", "l2").collect()] == [(1, 2, "L3", "L")]


def test_example_explained(example):
    event = example.accesses.filter("loc = '2:2'").select("idx", "tid", "pos")
    steps = explain.explain(event, threads.thread_paths(example.threads)).orderBy("step").collect()
    assert [(r.step, r.tid, r.pos) for r in steps] == [(0, 2, 2), (1, 2, 0), (2, 1, 0)]


@pytest.mark.parametrize(
    ("forest", "a", "b", "parallel"),
    [
        ([(1, None, 0, None), (2, 1, 5, None)], (1, 3), (2, 9), False),  # before the child's start
        ([(1, None, 0, None), (2, 1, 5, None)], (1, 6), (2, 9), True),
        ([(1, None, 0, None), (2, 1, 5, 8)], (1, 9), (2, 6), False),  # after its join
        ([(1, None, 0, None), (2, 1, 5, 8)], (1, 7), (2, 6), True),
        ([(1, None, 0, None), (2, 1, 5, None), (3, 1, 6, None)], (2, 1), (3, 1), True),  # neither joined
        ([(1, None, 0, None), (2, 1, 5, 6), (3, 1, 7, None)], (2, 1), (3, 1), False),  # one joined before the other starts
        ([(1, None, 0, None), (2, 1, 5, 8), (3, 1, 7, None)], (2, 1), (3, 1), True),
        ([(1, None, 0, None), (2, 1, 5, 6), (3, 1, 7, 9)], (2, 1), (3, 1), False),  # both joined
        ([(1, None, 0, None), (2, 1, 5, 8), (3, 1, 7, 9)], (2, 1), (3, 1), True),
        ([(1, None, 0, None), (2, 1, 5, None), (3, 2, 4, None)], (1, 4), (3, 9), False),  # a grandchild
        ([(1, None, 0, None), (2, 1, 5, None), (3, 2, 4, None)], (1, 6), (3, 9), True),
        ([(1, None, 0, None), (2, None, 0, None)], (1, 6), (2, 9), False),  # no common start
    ],
)
def test_happens_before(spark, forest, a, b, parallel):
    f = facts(spark, [(*a, "WRITE", "v"), (*b, "READ", "v")], [], forest)
    assert bool(found(f)) is parallel


def test_distance_between_unjoined_siblings(spark):
    f = facts(spark, [(2, 1, "WRITE", "v"), (3, 1, "READ", "v")], [], [(1, None, 0, None), (2, 1, 5, None), (3, 1, 2000, None)])
    assert found(f) and not found(f, distance=1000)


def test_one_thread_never_races_with_itself(spark):
    f = facts(spark, [(1000, 1, "WRITE", "v"), (1000, 2, "WRITE", "v"), (1000, 3, "READ", "v")], [], [(1000, None, 0, None)])
    assert not found(f)


def test_reads_alone_are_not_shared(spark):
    f = facts(spark, [(1, 1, "READ", "v"), (2, 1, "READ", "v"), (1, 2, "WRITE", "w"), (2, 2, "READ", "w")], [], [(1, None, 0, None), (2, 1, 0, None)])
    assert [r.sig for r in races.shared_vars(f.accesses).collect()] == ["w"]


def test_reentrant_lock_is_no_deadlock(spark):
    locked = [(t, p, k, "L") for t in (2, 3) for p, k in ((1, "LOCK"), (2, "LOCK"), (3, "UNLOCK"), (4, "UNLOCK"))]
    f = facts(spark, [], locked, [(1, None, 0, None), (2, 1, 0, None), (3, 1, 0, None)])
    assert not detect.detect_deadlocks(f).collect()


def test_gate_lock_keeps_a_deadlock_away(spark):
    def thread(t, first, second):
        return [(t, 1, "LOCK", "G"), (t, 2, "LOCK", first), (t, 3, "LOCK", second), (t, 4, "UNLOCK", second), (t, 5, "UNLOCK", first), (t, 6, "UNLOCK", "G")]

    f = facts(spark, [], thread(2, "A", "B") + thread(3, "B", "A"), [(1, None, 0, None), (2, 1, 0, None), (3, 1, 0, None)])
    assert len(detect.detect_deadlocks(f).collect()) == 1
    assert not detect.detect_deadlocks(f, gated=True).collect()


def test_lock_through_callers(spark):
    callers = spark.createDataFrame([("main", 1, "f"), ("f", 1, "g"), ("main", 2, "h"), ("f", 2, "h")], "caller string, call int, node string")
    held = spark.createDataFrame([("main", 1, "L")], "caller string, call int, lk string")
    got = {(r.node, r.lk) for r in locks.caller_locks(held, callers).collect()}
    assert got == {("f", "L"), ("g", "L")}  # h is also called without the lock


def test_sections_match_brute_force(spark):
    rng = random.Random(3)
    events = [(i, rng.randrange(4), i, rng.choice(["LOCK", "UNLOCK"]), f"l{rng.randrange(3)}") for i in range(300)]
    got = {tuple(r) for r in locks.critical_sections(spark.createDataFrame(events, LOCK)).collect()}
    want = set()
    for _, t, p, k, lk in events:
        if k == "LOCK":
            later = [q for _, u, q, m, n in events if (u, m, n) == (t, "UNLOCK", lk) and q > p]
            if later:
                want.add((t, lk, p, min(later)))
    assert got == want
    points = spark.createDataFrame([(i, i % 4, i, "READ", "v", "") for i in range(300)], ACCESS)
    sets = {tuple(r) for r in locks.locksets(points, spark.createDataFrame(sorted(want), "tid long, lk string, lo long, hi long")).collect()}
    assert sets == {(i, lk) for i in range(300) for t, lk, lo, hi in want if t == i % 4 and lo < i < hi}


def test_paths_refuse_a_cycle_and_take_unknown_parents(spark):
    loose = spark.createDataFrame([(2, 99, 1, None), (3, 2, 4, None)], THREAD)
    assert {r.tid: r.path for r in threads.thread_paths(loose).collect()} == {2: [2], 3: [2, 3]}
    with pytest.raises(ValueError, match="cycle"):
        threads.thread_paths(spark.createDataFrame([(1, 2, 0, None), (2, 1, 0, None)], THREAD), most_rounds=5)


def test_starts_in_loops_make_two_threads(spark):
    starts = spark.createDataFrame([("main", 1, "run", "main", True), ("main", 5, "run", "main", False), ("main", 6, "other", "main", False)], "node_id string, pos int, target string, parent_tid string, in_loop boolean")
    assert sorted(r.tid for r in threads.start_threads(starts).collect()) == ["other", "run", "run#2", "run#3"]


def random_facts(spark, seed):
    rng = random.Random(seed)
    accesses = [(rng.randrange(1, 6), rng.randrange(60), rng.choice(["READ", "WRITE"]), f"v{rng.randrange(6)}") for _ in range(60)]
    locked = [(rng.randrange(1, 6), rng.randrange(60), rng.choice(["LOCK", "UNLOCK"]), f"l{rng.randrange(3)}") for _ in range(60)]
    return facts(spark, accesses, locked, [(1, None, 0, None), (2, 1, 5, None), (3, 1, 9, 40), (4, 2, 3, None), (5, 2, 20, 30)])


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1])
def test_incremental_is_full_recomputation_and_readding_restores(spark, seed):
    f = random_facts(spark, seed)
    gone = f.accesses.filter("idx % 4 = 1")
    after = f.with_(accesses=changes.edited(f.accesses, gone, f.accesses.limit(0)))
    added, removed = detect.race_changes(f, after)
    old, new = rows(detect.detect_races(f)), rows(detect.detect_races(after))
    assert rows(added) == sorted(set(new) - set(old)) and rows(removed) == sorted(set(old) - set(new))
    back = after.with_(accesses=changes.edited(after.accesses, gone.limit(0), gone))
    assert rows(detect.detect_races(back)) == old
    fewer = f.with_(locks=f.locks.filter("idx % 5 <> 2"))
    added, removed = detect.deadlock_changes(f, fewer)
    old, new = rows(detect.detect_deadlocks(f)), rows(detect.detect_deadlocks(fewer))
    assert rows(added) == sorted(set(new) - set(old)) and rows(removed) == sorted(set(old) - set(new))
    added, removed = detect.race_changes(f, fewer)
    old, new = rows(detect.detect_races(f)), rows(detect.detect_races(fewer))
    assert rows(added) == sorted(set(new) - set(old)) and rows(removed) == sorted(set(old) - set(new))


def test_delta_in_gives_what_full_detection_gives(spark):
    f = random_facts(spark, 5)
    gone = f.accesses.filter("idx % 6 = 1")
    moved = f.accesses.filter("idx % 12 = 1").withColumn("pos", (60 - F.col("pos")).cast("long"))  # the same identity elsewhere
    same = f.accesses.filter("idx % 12 = 7")  # comes back as it was
    new = f.accesses.filter("idx % 5 = 0").withColumn("idx", F.col("idx") + 1000).withColumn("kind", F.lit("WRITE"))
    coming = moved.unionByName(same).unionByName(new)
    after = f.with_(accesses=changes.edited(f.accesses, gone, coming))
    added, removed = detect.race_delta(f, gone, coming)
    old, fresh = rows(detect.detect_races(f)), rows(detect.detect_races(after))
    full = lambda x, y: {r[:7] for r in x} - {r[:7] for r in y}
    assert {r[:7] for r in rows(added)} >= full(fresh, old) and {r[:7] for r in rows(removed)} >= full(old, fresh)
    assert set(rows(added)) <= set(fresh) and set(rows(removed)) <= set(old)


def test_hot_variables_are_paired_in_blocks(spark, monkeypatch):
    f = random_facts(spark, 2)
    whole = rows(races.race_candidates(f.accesses))
    monkeypatch.setattr(races, "BLOCK_WRITES", 2)
    assert rows(races.race_candidates(f.accesses)) == whole and whole


def plain_inside(points, sections):
    return sorted((i, lk) for i, t, p in points for u, lk, lo, hi in sections if t == u and lo < p < hi)


@pytest.mark.parametrize("arrays", [False, True])
def test_long_and_short_sections_hold_the_same_points(spark, arrays):
    rng = random.Random(8)
    at = (lambda n: [n // 1000, n % 1000]) if arrays else (lambda n: n)
    ends = [sorted(rng.sample(range(200_000), 2)) for _ in range(40)] + [(n, n + rng.choice([1, 2, 70, 5000])) for n in (0, 63, 64, 127, 4096, 99_999)]
    sections = [(rng.randrange(3), f"l{i}", at(lo), at(hi)) for i, (lo, hi) in enumerate(ends)]
    points = [(i, rng.randrange(3), at(n)) for i, n in enumerate([rng.randrange(200_000) for _ in range(300)] + [x + d for pair in ends for x in pair for d in (0, 1)])]
    kind = "array<int>" if arrays else "long"
    got = locks.inside(spark.createDataFrame(points, f"idx long, tid long, pos {kind}"), spark.createDataFrame(sections, f"tid long, lk string, lo {kind}, hi {kind}"))
    assert sorted((r.idx, r.lk) for r in got.collect()) == plain_inside(points, sections)


def test_sections_of_one_lock_take_linear_time(spark):
    import time

    def seconds(n):
        events = spark.range(n).select(F.col("id").alias("idx"), F.lit(1).cast("long").alias("tid"), F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, "LOCK").otherwise("UNLOCK").alias("kind"), F.lit("l").alias("lk"))
        began = time.perf_counter()
        assert locks.critical_sections(events).count() == n // 2
        return time.perf_counter() - began

    seconds(20_000)
    small, large = seconds(100_000), seconds(800_000)
    assert large < 8 * small + 4  # eight times the events; quadratic would be 64 times


def test_ignored_variables_and_methods(spark):
    f = random_facts(spark, 3)
    left = changes.without_variables(f.accesses, ["v1"])
    assert left.filter("sig = 'v1'").isEmpty() and not left.filter("sig = 'v2'").isEmpty()
    nodes = spark.createDataFrame([(2,)], "tid long")
    assert changes.without_methods(f.accesses, nodes, "tid").filter("tid = 2").isEmpty()


def test_relations_group_by_write(example):
    got = races.relations(detect.detect_races(example)).collect()
    assert [(r.sig, r.n, r.concurrent) for r in got] == [("Example.y", 1, "4:READ")]


def test_candidate_deadlocks_need_two_threads(spark):
    order = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (2, "b", "a")], "tid long, l1 string, l2 string")
    assert [tuple(r) for r in deadlocks.candidates(order).collect()] == [(1, 2, "a", "b")]


def many_threads(spark, seed, n=40, n_locks=4, events=24):
    """A forest of three children each, with nested sections."""
    rng = random.Random(seed)
    forest = [(t, (t - 1) // 3 if t else None, 0 if not t else rng.randrange(20), rng.choice([None, rng.randrange(20, 40)]) if t else None) for t in range(n)]
    locked = [(t, p, rng.choice(["LOCK", "UNLOCK"]), f"l{rng.randrange(n_locks)}") for t in range(n) for p in rng.sample(range(40), events)]
    return facts(spark, [], locked, forest)


def plain_deadlocks(f, gated=False):
    """Every pair of nested acquisitions, one by one."""
    forest = {r.tid: r for r in f.threads.collect()}
    events = [tuple(r)[1:] for r in f.locks.collect()]
    sections = set()
    for t, p, k, lk in events:
        ends = [q for u, q, m, n in events if (u, m, n) == (t, "UNLOCK", lk) and q > p]
        if k == "LOCK" and ends:
            sections.add((t, lk, p, min(ends)))
    first = {}
    for t, lk, lo, hi in sections:
        first[t, lk, hi] = min(lo, first.get((t, lk, hi), lo))
    nested = {(t, lk, lo, l2, p2) for (t, lk, hi), lo in first.items() for u, l2, p2, _ in sections if u == t and l2 != lk and lo < p2 < hi}
    gates = {n: {lk for (t, lk, hi), lo in first.items() if t == n[0] and lk != n[1] and lo < n[2] < hi} for n in nested}

    def up(t):
        way = [t]
        while forest[way[0]].ptid is not None:
            way.insert(0, forest[way[0]].ptid)
        return way

    def parallel(a, pa, b, pb):
        x, y = up(a), up(b)
        d = sum(i == j for i, j in zip(x, y))
        ends = lambda t: (forest[t].s, float("inf") if forest[t].j is None else forest[t].j)
        if d == len(x):
            s, j = ends(y[d])
            return all(s < p < j for p in pa)
        if d == len(y):
            s, j = ends(x[d])
            return all(s < p < j for p in pb)
        return ends(x[d])[0] < ends(y[d])[1] and ends(y[d])[0] < ends(x[d])[1]

    met = {(a, b) for a in nested for b in nested if a[0] < b[0] and (a[1], a[3]) == (b[3], b[1])}
    return sorted({(a[0], b[0], a[1], a[3]) for a, b in met if not (gated and gates[a] & gates[b]) and parallel(a[0], (a[2], a[4]), b[0], (b[2], b[4]))})


@pytest.mark.parametrize("gated", [False, True])
def test_deadlocks_of_a_deep_forest_are_those_of_all_pairs(spark, gated):
    f = many_threads(spark, 4)
    got = rows(detect.detect_deadlocks(f, gated))
    assert got == plain_deadlocks(f, gated) and len(got) > 100


def largest_share(df):
    """The share of the rows that the largest task makes."""
    sizes = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    return max(sizes) / sum(sizes)


@pytest.mark.parametrize("gated", [False, True])
def test_deadlocks_of_one_pair_of_locks_are_dealt_over_tasks(spark, monkeypatch, gated):
    monkeypatch.setattr(meetings, "BLOCK_ROWS", 10)
    monkeypatch.setattr(meetings, "TASK_PAIRS", 500)
    order = lambda t: ("A", "B") if t % 2 else ("B", "A")
    locked = [(t, p, k, order(t)[i]) for t in range(1, 201) for p, k, i in ((1, "LOCK", 0), (2, "LOCK", 1), (3, "UNLOCK", 1), (4, "UNLOCK", 0))]
    f = facts(spark, [], locked, [(0, None, 0, None), *((t, 0, t, None) for t in range(1, 201))])
    got = detect.detect_deadlocks(f, gated)
    assert got.count() == 100 * 100 and largest_share(got) < 0.5


@pytest.mark.parametrize("masks, bits", [(4, 62), (1, 62), (4, 1)])
def test_gates_as_masks_are_those_one_by_one(spark, monkeypatch, masks, bits):
    monkeypatch.setattr(deadlocks, "MASKS", masks)
    monkeypatch.setattr(deadlocks, "OWN_BITS", bits)
    f = many_threads(spark, 5, n=60, n_locks=6, events=30)
    plain, got = plain_deadlocks(f), rows(detect.detect_deadlocks(f, True))
    assert got == plain_deadlocks(f, True) and 100 < len(got) < len(plain)


def test_gates_of_few_sets_keep_no_join_of_siblings_from_being_compiled(spark, monkeypatch):
    ungated, seen = deadlocks._ungated, []
    monkeypatch.setattr(deadlocks, "_ungated", lambda a, b: seen.append(1) or ungated(a, b))
    f = facts(spark, [], [(t, p, k, lk) for t in (1, 2) for p, k, lk in ((1, "LOCK", "G"), (2, "LOCK", f"L{t}"), (3, "LOCK", f"L{3 - t}"), (4, "UNLOCK", f"L{3 - t}"), (5, "UNLOCK", f"L{t}"), (6, "UNLOCK", "G"))], [(0, None, 0, None), (1, 0, 1, None), (2, 0, 2, None)])
    assert not detect.detect_deadlocks(f, True).collect() and len(detect.detect_deadlocks(f).collect()) == 1
    assert len(seen) == 1  # of ancestors


@pytest.mark.parametrize("what", ["deadlocks", "gated"])
def test_opposite_orders_are_paired_once(spark, monkeypatch, what):
    met, formed = deadlocks.met, []

    def counted(*args):
        got = met(*args)
        formed.append(got.count())
        return got

    monkeypatch.setattr(deadlocks, "met", counted)
    order = lambda t: ("A", "B") if t % 2 else ("B", "A")
    locked = [(t, p, k, order(t)[i]) for t in range(1, 41) for p, k, i in ((1, "LOCK", 0), (2, "LOCK", 1), (3, "UNLOCK", 1), (4, "UNLOCK", 0))]
    f = facts(spark, [], locked, [(0, None, 0, None), *((t, 0, t, None) for t in range(1, 41))])
    got = detect.detect_deadlocks(f, what == "gated")
    assert got.count() == 400 and sum(formed) == 400


def one_hot_variable(spark):
    """200 threads of one parent that write one variable each."""
    return facts(spark, [(t, 1, "WRITE", "v") for t in range(1, 201)], [], [(0, None, 0, None), *((t, 0, t, None) for t in range(1, 201))])


def test_races_of_one_variable_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(meetings, "BLOCK_ROWS", 10)
    monkeypatch.setattr(meetings, "TASK_PAIRS", 1000)
    got = detect.detect_races(one_hot_variable(spark))
    assert got.count() == 200 * 199 // 2 and largest_share(got) < 0.5


def test_moved_threads_compare_no_findings(spark, monkeypatch):
    f = random_facts(spark, 7)
    after = f.with_(threads=spark.createDataFrame([(1, None, 0, None), (2, 1, 5, None), (3, 1, 9, None), (4, 2, 30, None), (5, 2, 20, 25)], THREAD))
    old, new = rows(detect.detect_races(f)), rows(detect.detect_races(after))
    monkeypatch.setattr(changes, "difference", None)  # would shuffle all findings of both states
    added, removed = detect.race_changes(f, after)
    assert rows(added) == sorted(set(new) - set(old)) and rows(removed) == sorted(set(old) - set(new)) and added.count()


def test_lines_move_without_a_join_of_races(spark):
    f = random_facts(spark, 6)
    lines = f.accesses.filter("idx % 3 = 0").select("loc", F.concat("loc", F.lit("+")).alias("new_loc")).distinct()
    want = [rows(x) for x in changes.moved_lines(detect.detect_races(f), lines)]
    got = detect.moved_races(f, lines)
    assert [rows(x) for x in got] == want and want[0]


def test_threads_with_equal_seeds_are_carried_once(spark, monkeypatch):
    from strandline.operators import graphs

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3)], "a long, b long")
    seeds = spark.createDataFrame([(1, t) for t in range(50)] + [(4, 50), (1, 50)], "node long, tid long")
    seen, carried = [], graphs._carried
    monkeypatch.setattr(graphs, "_carried", lambda e, s, n: seen.append(s.count()) or carried(e, s, n))
    assert rows(graphs.propagate(edges, seeds)) == sorted([(n, t) for t in range(51) for n in (1, 2, 3)] + [(4, 50)])
    assert seen == [3]
