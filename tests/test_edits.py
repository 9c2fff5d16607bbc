"""Edits of whole programs: what is derived anew, what comes and goes, and which detector runs."""

import pytest
from test_program import program  # noqa: F401
from test_traces import inst

from strandline.operators import graphs, traces
from strandline.plans import detect, edits
from strandline.plans.program import facts_of
from strandline.sources import scope
from strandline.sources.facts import Facts

FIELD = {"declaring": "Example", "is_static": True, "uses": [], "def": -1}
EMPTY = "node_id string"


def races_of(df):
    return None if df is None else {r.sig for r in df.collect()}


@pytest.fixture(scope="module")
def before(program):  # noqa: F811
    return facts_of(program, "main")


def methods(spark, *names):
    return spark.createDataFrame([(n,) for n in names], EMPTY)


def test_an_edited_body_brings_and_takes_findings(spark, program, before):  # noqa: F811
    # run without its locks: x is a race now, y stays one, and the deadlock goes.
    body = inst(spark, ("run", 0, "GET", FIELD | {"field": "early"}), ("run", 2, "GET", FIELD | {"field": "y"}), ("run", 4, "GET", FIELD | {"field": "x"}), ("run", 8, "PUT", FIELD | {"field": "z"}))
    edit = edits.Edit(methods(spark, "run"), body, program.edges.limit(0))
    after, delta = edits.program_delta(before, program, edit, "main")
    assert races_of(delta.races_added) == {"Example.x"}
    assert races_of(delta.races_removed) == {"Example.late"}
    assert (delta.deadlocks_added.count(), delta.deadlocks_removed.count()) == (0, 1)
    # The edit undone gives the findings back.
    again = edits.facts_delta(after, before)
    assert (races_of(again.races_added), races_of(again.races_removed)) == ({"Example.late"}, {"Example.x"})


def test_an_unchanged_body_concerns_no_detector(spark, program, before):  # noqa: F811
    edit = edits.Edit(methods(spark, "run"), program.inst.filter("node_id = 'run'"), program.edges.limit(0))
    after, delta = edits.program_delta(before, program, edit, "main")
    assert delta == edits.Delta(None, None, None, None)


def test_accesses_alone_concern_no_deadlocks(before):
    runs, after = edits.gate(before, before.with_(accesses=before.accesses.filter("sig <> 'Example.y'")))
    assert (runs, after.locks is before.locks) == (edits.Gate(True, False), True)


def test_an_ignored_method_does_nothing_until_considered(spark, program, before):  # noqa: F811
    ignored = facts_of(edits.without_methods(program, methods(spark, "go")), "main")
    assert ignored.threads.count() == 1
    delta = edits.facts_delta(ignored, before)
    assert races_of(delta.races_added) == {"Example.late", "Example.y"} and delta.deadlocks_added.count() == 1


def test_a_modifier_makes_callers_lock(spark, program):  # noqa: F811
    new = spark.createDataFrame([("go", True)], "node_id string, is_sync boolean")
    after = edits.apply_edit(program, edits.Edit(modifiers=new))
    locked = traces.synchronized_calls(after.inst, after.edges, after.nodes, after.points_to)
    assert {(r.node_id, tuple(r.pos), r.kind, r.lk) for r in locked.collect()} == {("main", (0, 0), "LOCK", "T.1"), ("main", (0, 2), "UNLOCK", "T.1")}
    # Without an object there is no lock, rather than one that all such calls share.
    nowhere = after.points_to.filter("value <> 3")
    assert traces.synchronized_calls(after.inst, after.edges, after.nodes, nowhere).isEmpty()


def test_a_points_to_delta_moves_locks(spark, program, before):  # noqa: F811
    # run's locks are other objects now, so none is common: what they protected races, y by its second read too.
    delta = spark.createDataFrame([("-", "run", 11, "L", "1"), ("+", "run", 11, "L", "9"), ("-", "run", 12, "L", "3"), ("+", "run", 12, "L", "8")], "op string, node_id string, value int, obj_type string, obj_id string")
    after, found = edits.program_delta(before, program, edits.Edit(points_to=delta), "main")
    assert races_of(found.races_added) == {"Example.x", "Example.y"} and found.deadlocks_removed.count() == 1


def test_a_moved_start_concerns_the_threads_below(spark):
    """1 starts 2, which starts 3; only 2's join goes, and with it 3's order to main's access."""
    accesses = spark.createDataFrame([("a", 1, 50, "WRITE", "v", "a"), ("b", 3, 30, "WRITE", "v", "b")], "idx string, tid int, pos int, kind string, sig string, loc string")
    none = spark.createDataFrame([], "idx string, tid int, pos int, kind string, lk string")
    threads = lambda j: spark.createDataFrame([(1, None, 0, None), (2, 1, 10, j), (3, 2, 20, None)], "tid int, ptid int, s int, j int")
    joined, unjoined = Facts(accesses, none, threads(40)), Facts(accesses, none, threads(None))
    added, removed = detect.race_changes(joined, unjoined)
    assert (races_of(added), races_of(removed)) == ({"v"}, set())
    assert races_of(edits.facts_delta(unjoined, joined).races_removed) == {"v"}


def test_a_method_without_events_left_has_none(spark):
    events = spark.createDataFrame([("a", 1), ("b", 1)], "node_id string, pos int")
    assert [r.node_id for r in traces.replace_trace(events, events.limit(0), methods(spark, "a")).collect()] == ["b"]


def test_log_and_sizes(spark, tmp_path):
    log = spark.createDataFrame([("1 2",), ("3 4",)], "value string")
    scope.write_log(log, str(tmp_path / "log"))
    assert {r.value for r in spark.read.text(str(tmp_path / "log")).collect()} == {"1 2", "3 4"}
    points = spark.createDataFrame([("a", 1, "o"), ("a", 1, "p"), ("b", 1, "o")], "node_id string, value int, obj_id string")
    nodes = spark.createDataFrame([("A", "f"), ("A", "g")], "class string, method string")
    assert tuple(graphs.points_to_stats(points, nodes).first()) == (1, 2, 2, 2, 3)
