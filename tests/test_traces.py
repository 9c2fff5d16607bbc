"""From instructions to events, scopes and the remaining operators on small programs."""

import pytest

from strandline.functions import signatures
from strandline.operators import changes, explain, graphs, traces
from strandline.sources import scope

INST = "node_id string, iindex int, kind string, line int, in_loop boolean, in_catch boolean, def int, uses array<int>, target string, declaring string, field string, is_static boolean, text string"
NODE = "node_id string, class string, method string, loader string, is_static boolean, is_sync boolean, is_init boolean, is_clinit boolean, is_thread boolean, is_callable boolean, graph_node_id int"


def inst(spark, *rows):
    """rows: (node, index, kind, and further columns by name)."""
    names = [c.split(" ")[0] for c in INST.split(", ")]
    return spark.createDataFrame([tuple({"node_id": n, "iindex": i, "kind": k, "line": i, "in_loop": False, "in_catch": False, "is_static": False, **more}.get(c) for c in names) for n, i, k, more in rows], INST)


def nodes(spark, *rows):
    names = [c.split(" ")[0] for c in NODE.split(", ")]
    return spark.createDataFrame([tuple({"loader": "Application", "is_static": False, "is_sync": False, "is_init": False, "is_clinit": False, "is_thread": False, "is_callable": False, "graph_node_id": 0, **r}.get(c) for c in names) for r in rows], NODE)


@pytest.fixture(scope="module")
def points_to(spark):
    return spark.createDataFrame([("m", 1, "p/A", "7"), ("m", 1, "p/A", "8"), ("m", 3, "p/T", "9")], "node_id string, value int, obj_type string, obj_id string")


def test_field_reads_before_a_monitor_do_not_count(spark):
    code = inst(
        spark,
        ("m", 0, "GET", {"def": 4, "uses": [1], "declaring": "Lp/A", "field": "o"}),
        ("m", 1, "GET", {"def": 5, "uses": [4], "declaring": "Lp/A", "field": "lock"}),
        ("m", 2, "ENTER", {"uses": [5]}),
        ("m", 3, "PUT", {"uses": [1], "declaring": "Lp/A", "field": "x"}),
        ("i", 0, "PUT", {"uses": [1], "declaring": "Lp/A", "field": "x"}),
    )
    got = traces.field_accesses(code, nodes(spark, {"node_id": "m", "class": "Lp/A"}, {"node_id": "i", "class": "Lp/A", "is_init": True}))
    assert [(r.node_id, r.iindex) for r in got.collect()] == [("m", 3)]


def test_field_and_array_events_name_every_object(spark, points_to):
    code = inst(spark, ("m", 0, "PUT", {"uses": [1], "declaring": "Lp/A", "field": "x"}), ("m", 1, "ALOAD", {"uses": [3]}), ("m", 2, "GET", {"uses": [], "declaring": "Lp/A", "field": "s", "is_static": True, "def": 99}))
    who = nodes(spark, {"node_id": "m", "class": "Lp/A$B"})
    got = {(r.kind, r.sig, r["loc"]) for r in traces.field_events(code, who, points_to).collect()}
    assert got == {("WRITE", "p/A.x.7", "p/AB:0"), ("WRITE", "p/A.x.8", "p/AB:0"), ("READ", "p/A.s", "p/AB:2")}
    assert {(r.kind, r.sig) for r in traces.array_events(code, who, points_to).collect()} == {("READ", "array.9")}
    assert traces.field_events(code, who, points_to, excluded=["p/A.x"]).count() == 1


def test_monitors_keep_all_objects_and_synchronized_calls_are_wrapped(spark, points_to):
    code = inst(spark, ("m", 0, "ENTER", {"uses": [1]}), ("m", 1, "INVOKE", {"uses": [3], "target": "p/T.f()V"}), ("m", 2, "EXIT", {"uses": [1]}))
    assert {(r.kind, r.lk) for r in traces.monitor_events(code, points_to).collect()} == {(k, f"p/A.{o}") for k in ("LOCK", "UNLOCK") for o in ("7", "8")}
    edges = spark.createDataFrame([("m", 1, "f"), ("m", 1, "g")], "caller string, iindex int, callee string")
    who = nodes(spark, {"node_id": "f", "class": "p/T", "is_sync": True}, {"node_id": "g", "class": "p/G", "is_sync": True, "is_static": True})
    got = {(tuple(r.pos), r.kind, r.lk) for r in traces.synchronized_calls(code, edges, who, points_to).collect()}
    assert got == {((1, 0), "LOCK", "p/T.9"), ((1, 2), "UNLOCK", "p/T.9"), ((1, 0), "LOCK", "p/G"), ((1, 2), "UNLOCK", "p/G")}
    assert {r.target for r in traces.call_events(code, edges).collect()} == {"f", "g"}


def test_thread_interfaces_are_recognised(spark, points_to):
    calls = ["p/T.start()V", "x.execute(Ljava/lang/Runnable;)V", "x.submit(Ljava/lang/Runnable;)Y", "p/T.join()V", "java/util/concurrent/Future.get()X", "x.shutdown()V", "p/A.f()V"]
    code = inst(spark, *[("m", i, "INVOKE", {"target": t, "uses": [3, 3], "in_loop": i == 0}) for i, t in enumerate(calls)])
    assert [r.event for r in traces.classified(code).orderBy("iindex").collect()] == ["START"] * 3 + ["JOIN"] * 3 + ["CALL"]
    entries = spark.createDataFrame([("p/T", "run")], "class string, node_id string")
    got = traces.thread_events(code, entries, points_to).collect()
    assert {r.kind for r in got} == {"START", "JOIN"} and all(r.target == "run" for r in got) and sum(r.in_loop for r in got) == 1


def test_runnables_and_definitions(spark):
    code = inst(spark, ("m", 0, "INVOKE", {"target": "java/lang/Thread.<init>(Ljava/lang/Runnable;)V", "uses": [2, 6]}))
    assert [(r.thread, r.runnable) for r in traces.runnables(code).collect()] == [(2, 6)]
    uses = spark.createDataFrame([("m", 6, 5), ("m", 5, 4)], "node_id string, to int, from int")
    values = spark.createDataFrame([("m", 6)], "node_id string, value int")
    assert traces.resolve_definition(values, uses).first().origin == 4


def test_catch_blocks_and_what_follows(spark):
    code = inst(spark, ("m", 0, "PUT", {"text": "put x"}), ("m", 1, "PUT", {"in_catch": True, "text": "put y"}), ("m", 2, "INVOKE", {"text": "call f"}), ("m", 3, "PUT", {"text": "put z"}))
    assert traces.without_catch_blocks(code).count() == 3
    blocks = spark.createDataFrame([("m", i, b) for i, b in enumerate([0, 1, 2, 2])], "node_id string, iindex int, block int")
    cfg = spark.createDataFrame([("m", 0, 2), ("m", 1, 2)], "node_id string, block int, succ int")
    assert sorted(r.iindex for r in traces.without_catch_blocks(code, blocks, cfg).collect()) == [0, 3]


def test_loops_and_subclasses(spark):
    cfg = spark.createDataFrame([("m", 0, 1), ("m", 1, 2), ("m", 2, 1), ("m", 2, 3)], "node_id string, block int, succ int")
    assert sorted(r.block for r in traces.in_loops(cfg).collect()) == [1, 2]
    parents = spark.createDataFrame([("A", "java/lang/Thread"), ("B", "A"), ("C", "D")], "class string, parent string")
    assert sorted(r["class"] for r in traces.subclasses(parents, ["java/lang/Thread"]).collect()) == ["A", "B", "java/lang/Thread"]


def test_trace_edits_and_edges(spark):
    events = spark.createDataFrame([("a", 1), ("b", 1)], "node_id string, pos int")
    assert sorted(map(tuple, traces.replace_trace(events, spark.createDataFrame([("a", 9)], events.schema)).collect())) == [("a", 9), ("b", 1)]
    assert traces.delete_traces(events, spark.createDataFrame([("a",)], "node_id string")).count() == 1
    calls = spark.createDataFrame([("a", 1, "b"), ("c", 1, "b")], "node_id string, pos int, target string")
    tids = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1)], "node_id string, tid int")
    edges = traces.call_graph_edges(calls, tids)
    assert edges.count() == 3
    assert {(r.sink_node, r.tid, r.src_node) for r in traces.incoming_edge(edges).collect()} == {("b", 1, "a"), ("b", 2, "a")}
    assert traces.in_thread(events, tids).select("idx").distinct().count() == 2


def test_scopes_entries_and_exclusions(spark, tmp_path):
    (tmp_path / "scope.txt").write_text("Application,Java,jarFile,app.jar\n\nPrimordial,Java,stdlib,none\n")
    (tmp_path / "ex.txt").write_text("java\\/awt\\/.*\n\n")
    assert [r.path for r in scope.read_scope(spark, str(tmp_path / "scope.txt")).collect()] == ["app.jar", "none"]
    bad = scope.read_exclusions(spark, str(tmp_path / "ex.txt"))
    assert bad == ["java/awt/.*"]
    who = nodes(
        spark,
        {"node_id": "1", "class": "Lp/A", "method": scope.MAIN, "is_static": True},
        {"node_id": "2", "class": "Lp/T", "method": "run()V", "is_thread": True, "graph_node_id": 1},
        {"node_id": "3", "class": "Lp/T", "method": "run()V", "is_thread": True, "graph_node_id": 5},
        {"node_id": "4", "class": "Ljava/awt/X", "method": "f()V"},
        {"node_id": "5", "class": "Ljava/util/HashMap", "method": "get()V", "loader": "Primordial"},
        {"node_id": "6", "class": "Ljava/util/Other", "method": "get()V", "loader": "Primordial"},
    )
    assert sorted(r.node_id for r in scope.in_scope(who, bad).collect()) == ["1", "2", "3", "5"]
    assert [r.node_id for r in scope.entry_points(who).collect()] == ["1"]
    assert scope.entry_points(who, with_threads=True).count() == 3
    assert [(r["class"], r.node_id) for r in scope.thread_entries(who).collect()] == [("Lp/T", "3")]


def test_method_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("e", "1")], "m string, body string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1")], "m string, body string")
    assert {tuple(r) for r in scope.changed_methods(old, new, ["m"], "body").collect()} == {("b", "BODY"), ("d", "ADDED"), ("e", "REMOVED")}
    code = spark.createDataFrame([("m", 0, "x"), ("m", 1, "y"), ("n", 0, "x")], "node_id string, iindex int, text string")
    other = spark.createDataFrame([("m", 0, "x"), ("n", 0, "x")], "node_id string, iindex int, text string")
    assert {tuple(r) for r in changes.same_code(code, other).collect()} == {("m", False), ("n", True)}
    assert [r.text for r in changes.deleted_instructions(code, other).collect()] == ["y"]


def test_markers_and_lines(spark):
    m = lambda *x: spark.createDataFrame([(v,) for v in x], "message string")
    assert sorted(r.message for r in scope.merge_markers(m("a", "b"), m("c"), m("a")).collect()) == ["b", "c"]
    found = spark.createDataFrame([("v", "p:1", "p:2")], "sig string, loc1 string, loc2 string")
    gone, new = changes.moved_lines(found, spark.createDataFrame([("p:2", "p:9")], "loc string, new_loc string"))
    assert [tuple(r) for r in gone.collect()] == [("v", "p:1", "p:2")] and [tuple(r) for r in new.collect()] == [("v", "p:1", "p:9")]


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in graphs.reach(e).collect()} == {("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "b"), ("c", "c"), ("x", "y")}
    roots = spark.createDataFrame([("a",)], "node string")
    assert sorted(r.node for r in graphs.orphans(e, roots).collect()) == ["x", "y"]
    assert {tuple(r) for r in explain.root_distance(e).collect()} == {("a", 0), ("b", 1), ("c", 2), ("x", 0), ("y", 1)}
    paths = explain.call_paths(e, spark.createDataFrame([("c",)], "node string"), "a")
    assert [tuple(r) for r in paths.collect()] == [("c", "a > b > c")]
    log = spark.createDataFrame([("1 2 3 4 5 6",), ("3 2 3 4 5 8",), ("",)], "value string")
    got = {r.series: (r.n, r.total, r.most, r.average) for r in graphs.latency_stats(log).collect()}
    assert got[0] == (2, 4, 3, "2") and got[5] == (2, 14, 8, "7")


def test_messages(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        signatures.race_message(F.lit("v"), F.lit("b:2"), F.lit("a:1")).alias("r"),
        signatures.deadlock_message(*[F.lit(x) for x in "abcd"]).alias("d"),
        signatures.race_sig(F.lit("p/A.x.17"), F.lit(False)).alias("s"),
        signatures.limited_context(F.lit("r"), F.array(F.lit("a"), F.lit("b")), 2).alias("c"),
        signatures.two_decimals(F.lit(2.5)).alias("t"),
    ).first()
    assert tuple(row) == ("Race: v (a:1, b:2)", "Deadlock: (a,b;  c,d)", "p/A.x", ["r", "a"], "2.5")
