"""Queries that build traces: the events table read as a program, its instructions turned into events.

The SQL states the program from the same table once more, without the DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.signatures import limited_context
from strandline.operators import explain, graphs, locks, races, threads, traces
from strandline.plans.queries import CALLS, FACTS, facts, sections
from strandline.plans.registry import query
from strandline.sources import facts as source
from strandline.sources import scope

CODE = """
    WITH RECURSIVE ev AS (SELECT event_id, user_id, event_type AS et, CAST(substr(props, 7, length(props) - 7) AS INTEGER) AS k FROM events),
    inst0 AS (SELECT 'm' || user_id AS node_id, event_id AS iindex, event_id % 1000 AS line, k % 5 = 2 AS in_loop, event_id % 11 = 0 AS in_catch, k % 7 AS def, k % 5 AS u0, k % 4 AS u1, k, et,
        CASE et WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 'ALOAD' ELSE 'GET' END WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'ASTORE' ELSE 'PUT' END WHEN 'signup' THEN 'ENTER' WHEN 'purchase' THEN 'EXIT' ELSE 'INVOKE' END AS kind,
        CASE WHEN et = 'error' THEN CASE k % 8 WHEN 0 THEN 'Ljava/lang/Thread.start()V' WHEN 1 THEN 'Ljava/lang/Thread.join()V' WHEN 2 THEN 'Ljava/util/concurrent/Executor.execute(Ljava/lang/Runnable;)V'
            WHEN 3 THEN 'Ljava/lang/Thread.<init>(Ljava/lang/Runnable;)V' WHEN 4 THEN 'Ljava/util/concurrent/Future.get()Ljava/lang/Object;' ELSE 'Lapp/C.f' || k || '()V' END END AS target,
        'app/D' || k % 6 || '.f' || k % 10 AS prefix, k % 4 = 1 AS static_field FROM ev),
    inst AS (SELECT *, CASE et WHEN 'error' THEN 'invoke ' || target WHEN 'view' THEN 'getfield ' || k WHEN 'click' THEN 'store ' || k ELSE 'monitor ' || k END AS text,
        CASE WHEN kind IN ('GET', 'ALOAD') THEN 'READ' WHEN kind IN ('PUT', 'ASTORE') THEN 'WRITE' WHEN kind = 'ENTER' THEN 'LOCK' WHEN kind = 'EXIT' THEN 'UNLOCK'
            WHEN k % 8 IN (0, 2) THEN 'START' WHEN k % 8 IN (1, 4) THEN 'JOIN' ELSE 'CALL' END AS event FROM inst0),
    users AS (SELECT DISTINCT user_id AS u FROM ev),
    node AS (SELECT u, 'm' || u AS node_id, 'Lapp/C$' || u % 40 AS class, CASE u % 5 WHEN 0 THEN 'run()V' WHEN 1 THEN 'main([Ljava/lang/String;)V' WHEN 2 THEN 'call()Ljava/lang/Object;' ELSE 'f' || u || '()V' END AS method,
        u % 4 <> 3 AS application, u % 6 = 1 AS is_sync, u % 9 = 4 AS is_static, u % 13 = 5 AS is_init, u % 17 = 6 AS is_clinit, u % 10 <> 5 AS is_thread, u % 3 <> 0 AS is_callable FROM users),
    edge AS (SELECT inst.node_id AS caller, iindex, 'm' || k AS callee FROM inst JOIN node ON node.u = k WHERE kind = 'INVOKE'),
    pt AS (SELECT 'm' || u AS node_id, v AS value, CASE WHEN n % 5 = 0 THEN 'Ljava/lang/Thread' ELSE 'Lapp/C$' || n END AS obj_type, 'o' || n AS obj_id
        FROM (SELECT u, v, o, (u * 3 + v + 5 * o) % 24 AS n FROM users, (SELECT unnest(range(7)) AS v), (SELECT unnest([0, 1]) AS o)) WHERE (o = 0 AND (u + v) % 4 <> 0) OR (o = 1 AND (u + v) % 5 = 0)),
    near AS (SELECT *, coalesce(kind = 'GET' AND lead(kind) OVER w IN ('ENTER', 'EXIT') AND lead(u0) OVER w = def, false) AS feeds FROM inst WINDOW w AS (PARTITION BY node_id ORDER BY iindex)),
    given AS (SELECT *, coalesce(kind = 'GET' AND lead(feeds) OVER w AND lead(u0) OVER w = def, false) AS gives FROM near WINDOW w AS (PARTITION BY node_id ORDER BY iindex)),
    fieldev AS (SELECT DISTINCT a.node_id, iindex, event AS kind, prefix || coalesce('.' || obj_id, '') AS sig, prefix, replace(replace(class, 'Lapp', 'app'), '$', '') || ':' || line AS loc
        FROM given a JOIN node ON a.node_id = node.node_id LEFT JOIN pt ON pt.node_id = a.node_id AND pt.value = CASE WHEN static_field THEN def ELSE u0 END
        WHERE kind IN ('GET', 'PUT') AND NOT feeds AND NOT gives AND NOT is_init AND NOT is_clinit),
    arrayev AS (SELECT DISTINCT a.node_id, iindex, event AS kind, 'array.' || obj_id AS sig FROM inst a JOIN pt ON pt.node_id = a.node_id AND pt.value = u0 WHERE kind IN ('ALOAD', 'ASTORE')),
    monitorev AS (SELECT DISTINCT a.node_id, iindex, event AS kind, obj_type || '.' || obj_id AS lk FROM inst a JOIN pt ON pt.node_id = a.node_id AND pt.value = u0 WHERE kind IN ('ENTER', 'EXIT')),
    callev AS (SELECT DISTINCT caller AS node_id, edge.iindex, callee AS target FROM edge JOIN inst ON node_id = caller AND inst.iindex = edge.iindex AND event = 'CALL'),
    body AS (SELECT class, arg_max(node_id, u) AS entry FROM node WHERE (method = 'run()V' AND is_thread) OR (method LIKE 'call()%' AND is_callable) GROUP BY class),
    own AS (SELECT DISTINCT obj_type, obj_id, entry FROM pt JOIN body ON class = obj_type),
    passed AS (SELECT DISTINCT t.obj_type, t.obj_id, entry FROM inst a JOIN pt t ON t.node_id = a.node_id AND t.value = u0 JOIN pt r ON r.node_id = a.node_id AND r.value = u1 JOIN body ON body.class = r.obj_type WHERE a.target LIKE '%<init>%'),
    run AS (SELECT * FROM passed WHERE (obj_type, obj_id) NOT IN (SELECT (obj_type, obj_id) FROM own) UNION ALL SELECT * FROM own),
    threadev AS (SELECT DISTINCT a.node_id, iindex, event AS kind, entry AS target, in_loop FROM inst a JOIN pt ON pt.node_id = a.node_id AND pt.value = CASE WHEN k % 8 = 2 THEN u1 ELSE u0 END JOIN run ON run.obj_type = pt.obj_type AND run.obj_id = pt.obj_id WHERE event IN ('START', 'JOIN'))
"""


def index() -> Column:
    """An event's instruction, as a plain column."""
    return F.col("pos")[0].alias("iindex")


def code(spark, sf_dir) -> source.CodeTables:
    return source.event_code(spark, sf_dir)


@query("SELECT node_id, iindex, event FROM inst", CODE)
def trace_kinds(spark, sf_dir):
    return traces.classified(code(spark, sf_dir).inst).select("node_id", "iindex", "event")


@query("""
    , block AS (SELECT node_id, iindex, k % 13 AS block FROM inst), caught AS (SELECT DISTINCT node_id, k % 13 AS block FROM inst WHERE in_catch),
    succ AS (SELECT DISTINCT node_id, (block + 1) % 13 AS block FROM caught WHERE block < 4)
    SELECT node_id, iindex FROM inst WHERE NOT in_catch AND (NOT regexp_matches(text, 'start|join|put|get|monitor') AND (node_id, k % 13) IN (SELECT (node_id, block) FROM succ)) IS NOT TRUE
""", CODE)
def outside_catch(spark, sf_dir):
    inst = code(spark, sf_dir).inst
    blocks = inst.select("node_id", "iindex", (F.col("k") % 13).alias("block"))
    cfg = blocks.filter("block < 4").select("node_id", "block", ((F.col("block") + 1) % 13).alias("succ")).distinct()
    return traces.without_catch_blocks(inst, blocks, cfg).select("node_id", "iindex")


@query("SELECT node_id, iindex, kind, sig, prefix, loc FROM fieldev WHERE prefix NOT IN ('app/D1.f7', 'app/D2.f4')", CODE)
def field_events(spark, sf_dir):
    c = code(spark, sf_dir)
    return traces.field_events(c.inst, c.nodes, c.points_to, ["app/D1.f7", "app/D2.f4"]).select("node_id", index(), "kind", "sig", "prefix", "loc")


@query("SELECT node_id, iindex, kind, sig FROM arrayev", CODE)
def array_events(spark, sf_dir):
    c = code(spark, sf_dir)
    return traces.array_events(c.inst, c.nodes, c.points_to).select("node_id", index(), "kind", "sig")


@query("SELECT node_id, iindex, kind, lk FROM monitorev", CODE)
def monitor_events(spark, sf_dir):
    c = code(spark, sf_dir)
    return traces.monitor_events(c.inst, c.points_to).select("node_id", index(), "kind", "lk")


@query("""
    , called AS (SELECT caller AS node_id, edge.iindex, class, is_static, u0 FROM edge JOIN node ON node.node_id = callee AND is_sync JOIN inst ON inst.node_id = caller AND inst.iindex = edge.iindex),
    taken AS (SELECT DISTINCT c.node_id, iindex, CASE WHEN is_static THEN class ELSE obj_type || '.' || obj_id END AS lk FROM called c LEFT JOIN pt ON pt.node_id = c.node_id AND pt.value = u0)
    SELECT node_id, iindex, place, CASE place WHEN 0 THEN 'LOCK' ELSE 'UNLOCK' END AS kind, lk FROM taken, (SELECT CAST(unnest([0, 2]) AS BIGINT) AS place) WHERE lk IS NOT NULL
""", CODE)
def synchronized_calls(spark, sf_dir):
    c = code(spark, sf_dir)
    return traces.synchronized_calls(c.inst, c.edges, c.nodes, c.points_to).select("node_id", index(), F.col("pos")[1].alias("place"), "kind", "lk")


@query("SELECT node_id, iindex, target FROM callev", CODE)
def call_events(spark, sf_dir):
    c = code(spark, sf_dir)
    return traces.call_events(c.inst, c.edges).select("node_id", index(), "target")


@query("SELECT node_id, iindex, kind, target, CAST(in_loop AS INTEGER) AS in_loop FROM threadev", CODE)
def thread_events(spark, sf_dir):
    """Starts and joins, of threads by their own class and of plain ones by the runnable they were made with."""
    c = code(spark, sf_dir)
    return traces.thread_events(c.inst, scope.thread_entries(c.nodes), c.points_to).select("node_id", index(), "kind", "target", F.col("in_loop").cast("int").alias("in_loop"))


@query("""
    , copies AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY node_id, iindex, copy) AS n FROM threadev, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS copy) WHERE kind = 'START' AND (copy = 1 OR in_loop))
    SELECT target || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS tid, node_id AS parent_tid, target, iindex, copy FROM copies
""", CODE)
def started_threads(spark, sf_dir):
    c = code(spark, sf_dir)
    starts = traces.thread_events(c.inst, scope.thread_entries(c.nodes), c.points_to).filter("kind = 'START'")
    return threads.start_threads(starts.withColumn("parent_tid", F.col("node_id"))).select("tid", "parent_tid", "target", F.col("s")[0].alias("iindex"), "copy")


@query("""
    , def_use AS (SELECT DISTINCT node_id, def AS dst, u1 AS src FROM inst WHERE kind = 'PUT' AND def > u1),
    back AS (SELECT DISTINCT node_id, u1 AS value, u1 AS origin FROM inst WHERE target LIKE '%<init>%' UNION SELECT b.node_id, value, src FROM back b JOIN def_use d ON d.node_id = b.node_id AND d.dst = b.origin)
    SELECT node_id, value, origin FROM back WHERE (node_id, origin) NOT IN (SELECT (node_id, dst) FROM def_use)
""", CODE)
def resolved_runnables(spark, sf_dir):
    inst = code(spark, sf_dir).inst
    second = F.col("uses")[1]
    given = traces.runnables(inst).select("node_id", F.col("runnable").alias("value"))
    return traces.resolve_definition(given, inst.filter((F.col("kind") == "PUT") & (F.col("def") > second)).select("node_id", F.col("def").alias("to"), second.alias("from")))


@query("SELECT node_id FROM node WHERE (application OR class = 'Lapp/C$39') AND NOT regexp_matches(substr(class, 2), '^app/C.1[0-4]$|7$')", CODE)
def class_scope(spark, sf_dir):
    return scope.in_scope(code(spark, sf_dir).nodes, ["^app/C.1[0-4]$", "7$"], ("app/C$39",)).select("node_id")


@query("SELECT node_id, method FROM node WHERE (method LIKE 'main(%' AND is_static) OR (method = 'run()V' AND is_thread)", CODE)
def entry_points(spark, sf_dir):
    return scope.entry_points(code(spark, sf_dir).nodes, with_threads=True).select("node_id", "method")


@query("SELECT class, entry AS node_id FROM body", CODE)
def thread_entries(spark, sf_dir):
    return scope.thread_entries(code(spark, sf_dir).nodes)


@query("SELECT class, string_agg(DISTINCT method, ' ' ORDER BY method) AS methods FROM node GROUP BY class", CODE)
def methods_by_class(spark, sf_dir):
    return traces.methods_by_class(code(spark, sf_dir).nodes).withColumn("methods", F.array_join("methods", " "))


@query("SELECT (SELECT count(DISTINCT class) FROM node) AS n_classes, (SELECT count(DISTINCT (class, method)) FROM node) AS n_methods, count(DISTINCT (node_id, value)) AS n_pointers, count(DISTINCT obj_id) AS n_objects, count(*) AS n_edges FROM pt", CODE)
def points_to_stats(spark, sf_dir):
    c = code(spark, sf_dir)
    return graphs.points_to_stats(c.points_to, c.nodes)


@query("SELECT c.node_id, c.iindex, c.target, inst.line FROM callev c JOIN inst ON inst.node_id = c.node_id AND inst.iindex = c.iindex", CODE)
def call_lines(spark, sf_dir):
    c = code(spark, sf_dir)
    return traces.located(traces.call_events(c.inst, c.edges), c.inst).select("node_id", index(), "target", "line")


@query("SELECT obj_type || '|' || obj_id AS receiver, array_to_string(list_slice([obj_id, 'c' || value, 'c' || node_id], 1, 2), '|') AS context FROM (SELECT DISTINCT * FROM pt)", CODE)
def receiver_contexts(spark, sf_dir):
    p = code(spark, sf_dir).points_to.distinct()
    caller = F.array(F.concat(F.lit("c"), "value"), F.concat(F.lit("c"), "node_id"))
    return p.select(F.concat_ws("|", "obj_type", "obj_id").alias("receiver"), F.array_join(limited_context(F.col("obj_id"), caller, 2), "|").alias("context"))


TIDS = ", runs AS (SELECT 'm' || u AS node_id, u % 8 AS tid FROM users UNION SELECT 'm' || u, (u + 3) % 8 FROM users WHERE u % 3 = 0)"


def runs(c: source.CodeTables):
    u = F.col("user_id")
    return c.nodes.select("node_id", (u % 8).alias("tid")).unionByName(c.nodes.filter("user_id % 3 = 0").select("node_id", ((u + 3) % 8).alias("tid")))


@query(TIDS + "SELECT sig, tid, count(DISTINCT CASE WHEN kind = 'READ' THEN node_id END) AS read_methods, count(DISTINCT CASE WHEN kind = 'WRITE' THEN node_id END) AS write_methods FROM fieldev JOIN runs USING (node_id) GROUP BY sig, tid", CODE)
def method_counts(spark, sf_dir):
    c = code(spark, sf_dir)
    return races.method_counts(traces.field_events(c.inst, c.nodes, c.points_to).join(runs(c), "node_id"))


@query(TIDS + "SELECT DISTINCT node_id AS src_node, iindex, target AS sink_node, tid FROM callev JOIN runs USING (node_id)", CODE)
def call_graph_edges(spark, sf_dir):
    c = code(spark, sf_dir)
    return traces.call_graph_edges(traces.call_events(c.inst, c.edges), runs(c)).select("src_node", F.col("src_pos")[0].alias("iindex"), "sink_node", "tid")


@query(TIDS + "SELECT target AS sink_node, tid, min((node_id, iindex))[1] AS src_node, min((node_id, iindex))[2] AS iindex FROM callev JOIN runs USING (node_id) GROUP BY target, tid", CODE)
def incoming_edges(spark, sf_dir):
    c = code(spark, sf_dir)
    first = traces.incoming_edge(traces.call_graph_edges(traces.call_events(c.inst, c.edges), runs(c)))
    return first.select("sink_node", "tid", "src_node", F.col("src_pos")[0].alias("iindex"))


@query(TIDS + "SELECT node_id || '@' || iindex || '.1@' || tid AS idx, kind, sig FROM arrayev JOIN runs USING (node_id)", CODE)
def events_in_threads(spark, sf_dir):
    """A method's events once for each thread that runs it."""
    c = code(spark, sf_dir)
    return traces.in_thread(traces.array_events(c.inst, c.nodes, c.points_to), runs(c)).select("idx", "kind", "sig")


@query("""
    , e AS (SELECT user_id, event_id, k % 20 AS block FROM ev WHERE et = 'error'),
    flow AS (SELECT DISTINCT user_id, a, b FROM (SELECT user_id, block AS a, lead(block) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM e) WHERE b IS NOT NULL),
    r AS (SELECT user_id, a, b FROM flow UNION SELECT r.user_id, r.a, f.b FROM r JOIN flow f ON f.user_id = r.user_id AND f.a = r.b)
    SELECT 'm' || user_id AS node_id, a AS block FROM r WHERE a = b
""", CODE)
def loop_blocks(spark, sf_dir):
    from pyspark.sql import Window as W

    e = code(spark, sf_dir).inst.filter("kind = 'INVOKE'").withColumn("block", F.col("k") % 20)
    succ = F.lead("block").over(W.partitionBy("node_id").orderBy("iindex"))
    return traces.in_loops(e.select("node_id", "block", succ.alias("succ")).filter("succ is not null").distinct())


@query("SELECT DISTINCT 'C' || d AS class FROM up WHERE anc IN (1, 2)", FACTS)
def subclasses(spark, sf_dir):
    """Threads and their parents as classes and what they extend."""
    t = facts(spark, sf_dir).threads.filter("ptid is not null")
    name = lambda c: F.concat(F.lit("C"), c)
    return traces.subclasses(t.select(name("tid").alias("class"), name("ptid").alias("parent")), ["C1", "C2"])


@query(", way AS (SELECT tid, CAST(tid AS VARCHAR) AS path FROM life WHERE tid = 0 UNION ALL SELECT life.tid, path || ' > ' || life.tid FROM way JOIN life ON life.ptid = way.tid) SELECT CAST(tid AS VARCHAR) AS target, path FROM way", FACTS)
def call_paths(spark, sf_dir):
    t = facts(spark, sf_dir).threads.select(F.col("tid").cast("string").alias("b"), F.col("ptid").cast("string").alias("a"))
    return explain.call_paths(t.filter("a is not null"), t.select(F.col("b").alias("node")), "0")


@query(""", first AS (SELECT b, min(a) AS a FROM e GROUP BY b), n AS (SELECT a AS node FROM e UNION SELECT b FROM e),
    way AS (SELECT node, [node] AS seen FROM n UNION ALL SELECT node, list_append(seen, first.a) FROM way JOIN first ON first.b = seen[-1] WHERE NOT list_contains(seen, first.a))
    SELECT node, CAST(max(len(seen)) - 1 AS INTEGER) AS distance FROM way GROUP BY node""", CALLS)
def root_distance(spark, sf_dir):
    return explain.root_distance(source.call_edges(spark, sf_dir))


def _caller_locks_sql() -> str:
    """Five hops, as SQL can't recurse through a count."""
    sql = """
    , site AS (SELECT tid AS caller, idx AS call, 1 + idx % 1499 AS node FROM ev WHERE et = 'error'), sites AS (SELECT node, count(*) AS n FROM site GROUP BY node),
    own AS (SELECT DISTINCT node, caller, call, lk FROM site JOIN cs ON cs.tid = caller AND cs.lo < call AND call < cs.hi),
    k1 AS (SELECT node, lk FROM (SELECT node, lk, count(*) AS k FROM own GROUP BY node, lk) JOIN sites USING (node) WHERE k = n)"""
    for i in range(2, 6):
        sql += f""",
    o{i} AS (SELECT * FROM own UNION SELECT s.node, s.caller, s.call, p.lk FROM site s JOIN k{i - 1} p ON p.node = s.caller),
    k{i} AS (SELECT node, lk FROM (SELECT node, lk, count(*) AS k FROM o{i} GROUP BY node, lk) JOIN sites USING (node) WHERE k = n)"""
    return sql + " SELECT node, lk FROM k5"


@query(_caller_locks_sql(), FACTS)
def caller_locks(spark, sf_dir):
    events, _ = source.event_log(spark, sf_dir)
    callers = events.filter("et = 'error'").select(F.col("tid").alias("caller"), F.col("idx").alias("call"), (1 + F.col("idx") % 1499).alias("node"))
    points = callers.select(F.col("caller").alias("tid"), F.col("call").alias("pos"))
    held = locks.inside(points, locks.merged_sections(locks.critical_sections(source.event_locks(events)))).select(F.col("tid").alias("caller"), F.col("pos").alias("call"), "lk").distinct()
    return locks.caller_locks(held, callers)


@query("SELECT tid, lk, min(lo) AS lo, hi FROM cs GROUP BY tid, lk, hi", FACTS)
def merged_sections(spark, sf_dir):
    return locks.merged_sections(sections(spark, sf_dir))
