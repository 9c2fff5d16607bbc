"""A whole program from instructions to findings, and points-to sets."""

import pytest
from test_traces import inst, nodes

from strandline.operators.points_to import points_to
from strandline.plans import detect
from strandline.plans.program import Program, facts_of


@pytest.fixture(scope="module")
def program(spark):
    """main starts run in the method go and joins it; both touch statics under two locks, in opposite order."""
    field = lambda k, f: {"declaring": "Example", "field": f, "is_static": True, "uses": [], "def": -1}
    call = lambda t: {"target": t, "uses": [3]}
    code = inst(
        spark,
        ("main", 0, "INVOKE", call("Example.go()V")), ("main", 1, "ENTER", {"uses": [12]}), ("main", 2, "PUT", field("PUT", "y")), ("main", 3, "ENTER", {"uses": [11]}), ("main", 4, "PUT", field("PUT", "x")),
        ("main", 5, "EXIT", {"uses": [11]}), ("main", 6, "EXIT", {"uses": [12]}), ("main", 7, "INVOKE", call("T.join()V")), ("main", 8, "GET", field("GET", "z")),
        ("go", 0, "PUT", field("PUT", "early")), ("go", 1, "INVOKE", call("T.start()V")), ("go", 2, "PUT", field("PUT", "late")),
        ("run", 0, "GET", field("GET", "early")), ("run", 1, "ENTER", {"uses": [11]}), ("run", 2, "GET", field("GET", "y")), ("run", 3, "ENTER", {"uses": [12]}), ("run", 4, "GET", field("GET", "x")), ("run", 5, "GET", field("GET", "y")),
        ("run", 6, "EXIT", {"uses": [12]}), ("run", 7, "EXIT", {"uses": [11]}), ("run", 8, "PUT", field("PUT", "z")), ("run", 9, "GET", field("GET", "late")),
    )
    who = nodes(spark, *[{"node_id": n, "class": c} for n, c in (("main", "Main"), ("go", "Go"), ("run", "Run"))])
    targets = [(n, v, t, o) for n in ("main", "go", "run") for v, t, o in ((3, "T", "1"), (11, "L", "1"), (12, "L", "3"))]
    edges = spark.createDataFrame([("main", 0, "go")], "caller string, iindex int, callee string")
    return Program(code, who, edges, spark.createDataFrame(targets, "node_id string, value int, obj_type string, obj_id string"), spark.createDataFrame([("T", "run")], "class string, node_id string"))


def test_program_findings(program):
    facts = facts_of(program, "main")
    assert sorted((r.tid, r.ptid, r.s, r.j) for r in facts.threads.collect()) == [("main", None, [], None), ("main/run", "main", [0, 1, 1, 1], [7, 1])]
    found = sorted((r.sig, *sorted((r.loc1, r.loc2))) for r in detect.detect_races(facts).collect())
    assert found == [("Example.late", "Go:2", "Run:9"), ("Example.y", "Main:2", "Run:2")]
    assert [(r.tid1, r.tid2, r.l1, r.l2) for r in detect.detect_deadlocks(facts).collect()] == [("main", "main/run", "L.3", "L.1")]


def racing(spark, calls, edges, *more):
    """Variables raced for when main runs `calls`, set writes a, and run writes it under the lock."""
    field = lambda f: {"declaring": "E", "field": f, "is_static": True, "uses": [], "def": -1}
    code = inst(spark, *calls, ("set", 0, "PUT", field("a")), *more, *[("run", i, k, v) for i, (k, v) in enumerate([("ENTER", {"uses": [11]}), ("PUT", field("a")), ("EXIT", {"uses": [11]})])])
    names = ("main", "set", "mid", "run")
    who = nodes(spark, *[{"node_id": n, "class": n} for n in names])
    targets = spark.createDataFrame([(n, v, t, o) for n in names for v, t, o in ((3, "T", "1"), (11, "L", "1"))], "node_id string, value int, obj_type string, obj_id string")
    program = Program(code, who, spark.createDataFrame(edges, "caller string, iindex int, callee string"), targets, spark.createDataFrame([("T", "run")], "class string, node_id string"))
    return {r.sig for r in detect.detect_races(facts_of(program, "main")).collect()}


START = {"target": "T.start()V", "uses": [3]}
SET = {"target": "E.set()V", "uses": [9]}
LOCK = {"uses": [11]}


def test_a_caller_protects_only_if_every_call_does(spark):
    held = [("main", 0, "INVOKE", START), ("main", 1, "ENTER", LOCK), ("main", 2, "INVOKE", SET), ("main", 3, "EXIT", LOCK)]
    assert racing(spark, [*held, ("main", 4, "INVOKE", SET)], [("main", 2, "set"), ("main", 4, "set")]) == {"E.a"}


def test_a_call_before_a_start_hides_none_after_it(spark):
    early = [("main", 0, "INVOKE", SET), ("main", 1, "INVOKE", START)]
    assert racing(spark, [*early, ("main", 2, "INVOKE", SET)], [("main", 0, "set"), ("main", 2, "set")]) == {"E.a"}


def test_calls_through_a_cycle_settle(spark):
    """mid locks, then calls set and itself: every way to set holds the lock."""
    more = [("mid", 0, "ENTER", LOCK), ("mid", 1, "INVOKE", SET), ("mid", 2, "INVOKE", SET), ("mid", 3, "EXIT", LOCK)]
    calls = [("main", 0, "INVOKE", START), ("main", 1, "INVOKE", SET)]
    edges = [("main", 1, "mid"), ("mid", 1, "set"), ("mid", 2, "mid")]
    assert racing(spark, calls, edges, *more) == set()


def test_a_thread_runs_the_runnable_it_was_given(spark):
    """new Thread(r).start(), r copied ten times before; main and r's class R write one variable."""
    put = {"declaring": "E", "field": "a", "is_static": True, "uses": [], "def": -1}
    code = inst(
        spark,
        ("main", 0, "INVOKE", {"target": "java/lang/Thread.<init>(Ljava/lang/Runnable;)V", "uses": [2, 30]}),
        ("main", 1, "INVOKE", {"target": "java/lang/Thread.start()V", "uses": [2]}), ("main", 2, "PUT", put), ("run", 0, "PUT", put),
    )
    who = nodes(spark, {"node_id": "main", "class": "main"}, {"node_id": "run", "class": "run"})
    targets = spark.createDataFrame([("main", 2, "java/lang/Thread", "1"), ("main", 20, "R", "2")], "node_id string, value int, obj_type string, obj_id string")
    copies = spark.createDataFrame([("main", i + 1, i) for i in range(20, 30)], "node_id string, to int, from int")
    none = spark.createDataFrame([], "caller string, iindex int, callee string")
    program = Program(code, who, none, targets, spark.createDataFrame([("R", "run")], "class string, node_id string"), def_use=copies)
    facts = facts_of(program, "main")
    assert sorted((r.tid, r.s) for r in facts.threads.collect()) == [("main", []), ("main/run", [1, 1])]
    assert {r.sig for r in detect.detect_races(facts).collect()} == {"E.a"}


def test_threads_nest_as_deep_as_they_do(spark):
    """Each body starts the next, twenty deep; the last one and main write one variable."""
    put = {"declaring": "E", "field": "a", "is_static": True, "uses": [], "def": -1}
    names = ["main", *[f"run{i}" for i in range(20)]]
    code = inst(spark, *[(n, 0, "INVOKE", {"target": f"T{i}.start()V", "uses": [3]}) for i, n in enumerate(names[:-1])], ("main", 1, "PUT", put), (names[-1], 0, "PUT", put))
    who = nodes(spark, *[{"node_id": n, "class": n} for n in names])
    targets = spark.createDataFrame([(n, 3, f"T{i}", "1") for i, n in enumerate(names[:-1])], "node_id string, value int, obj_type string, obj_id string")
    entries = spark.createDataFrame([(f"T{i}", f"run{i}") for i in range(20)], "class string, node_id string")
    facts = facts_of(Program(code, who, spark.createDataFrame([], "caller string, iindex int, callee string"), targets, entries), "main")
    assert facts.threads.count() == 21
    assert {r.sig for r in detect.detect_races(facts).collect()} == {"E.a"}


def test_inclusion_constraints(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = points_to(
        t([("a", "o1"), ("b", "o2")], "var string, obj string"), t([("c", "a"), ("d", "c"), ("c", "d")], "to string, from string"),
        t([("e", "d", "f")], "to string, base string, field string"), t([("a", "f", "b")], "base string, field string, from string"),
    )
    assert {tuple(r) for r in got.collect()} == {("a", "o1"), ("b", "o2"), ("c", "o1"), ("d", "o1"), ("e", "o2")}
