"""Queries over the driver's tables, each with its SQL for DuckDB.

Facts come from the events table by a fixed view; the SQL states the same from
the same table, independently of the DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import changes, deadlocks, explain, graphs, locks, races, threads
from strandline.plans import detect, registry
from strandline.plans.registry import QUERIES, SQL, Query  # noqa: F401
from strandline.sources import facts as source
from strandline.sources import scope

FACTS = """
    WITH RECURSIVE ev0 AS (SELECT event_id AS idx, user_id AS tid, event_type AS et, CAST(substr(props, 7, length(props) - 7) AS INTEGER) AS k FROM events),
    span AS (SELECT tid, min(idx) AS lo, max(idx) AS hi, CAST(floor((min(idx) + max(idx)) / 2) AS BIGINT) AS mid FROM ev0 GROUP BY tid),
    life AS (SELECT tid, CASE WHEN tid > 0 THEN CAST(floor((tid - 1) / 4) AS BIGINT) END AS ptid,
        CASE WHEN tid % 3 = 1 THEN mid ELSE lo END AS s, CASE WHEN tid % 3 = 0 AND tid > 0 THEN mid END AS j,
        CASE WHEN tid % 3 = 0 AND tid > 0 THEN mid ELSE hi END AS e FROM span),
    ev AS (SELECT ev0.* FROM ev0 JOIN life USING (tid) WHERE idx >= s AND idx <= e),
    mem AS (SELECT idx, tid, CASE WHEN et = 'view' THEN 'READ' ELSE 'WRITE' END AS kind, 'obj.' || k % 50 || '.' || idx % 30 AS sig FROM ev WHERE et IN ('view', 'click')),
    acq AS (SELECT idx, tid, k % 8 AS lk FROM ev WHERE et = 'signup'),
    rel AS (SELECT idx, tid, k % 8 AS lk FROM ev WHERE et = 'purchase'),
    cs AS (SELECT acq.tid, acq.lk, acq.idx AS lo, min(rel.idx) AS hi FROM acq JOIN rel ON acq.tid = rel.tid AND acq.lk = rel.lk AND rel.idx > acq.idx GROUP BY acq.tid, acq.lk, acq.idx),
    held AS (SELECT DISTINCT mem.idx, cs.lk FROM mem JOIN cs ON mem.tid = cs.tid AND cs.lo < mem.idx AND mem.idx < cs.hi),
    shared AS (SELECT sig, count(DISTINCT tid) AS n_threads FROM mem GROUP BY sig HAVING count(DISTINCT tid) > 1 AND count(*) FILTER (kind = 'WRITE') > 0),
    cand AS (SELECT w.sig, w.idx AS wi, x.idx AS xi, w.tid AS wt, x.tid AS xt, w.kind AS wk, x.kind AS xk FROM mem w JOIN mem x ON w.sig = x.sig AND w.tid <> x.tid
        WHERE w.kind = 'WRITE' AND (x.kind = 'READ' OR w.idx < x.idx) AND w.sig IN (SELECT sig FROM shared)),
    prot AS (SELECT DISTINCT wi, xi FROM cand JOIN held a ON a.idx = wi JOIN held b ON b.idx = xi AND a.lk = b.lk),
    unp AS (SELECT cand.* FROM cand ANTI JOIN prot USING (wi, xi)),
    up AS (SELECT tid AS d, tid AS anc, CAST(NULL AS BIGINT) AS child FROM life UNION ALL
        SELECT up.d, life.ptid, life.tid FROM up JOIN life ON life.tid = up.anc WHERE life.ptid IS NOT NULL),
    lca AS (SELECT u.d AS tu, v.d AS tv, u.child AS cu, v.child AS cv FROM up u JOIN up v ON u.anc = v.anc AND u.d <> v.d WHERE u.child IS NULL OR v.child IS NULL OR u.child <> v.child),
    par AS (SELECT unp.* FROM unp JOIN lca ON tu = wt AND tv = xt LEFT JOIN life cu ON cu.tid = lca.cu LEFT JOIN life cv ON cv.tid = lca.cv WHERE CASE
        WHEN lca.cu IS NULL THEN cv.s < wi AND (cv.j IS NULL OR wi < cv.j)
        WHEN lca.cv IS NULL THEN cu.s < xi AND (cu.j IS NULL OR xi < cu.j)
        ELSE (cv.j IS NULL OR cu.s < cv.j) AND (cu.j IS NULL OR cv.s < cu.j) END),
    race AS (SELECT sig, least(wi, xi) AS idx1, greatest(wi, xi) AS idx2, CASE WHEN wi < xi THEN wt ELSE xt END AS tid1, CASE WHEN wi < xi THEN xt ELSE wt END AS tid2,
        CASE WHEN wi < xi THEN wk ELSE xk END AS kind1, CASE WHEN wi < xi THEN xk ELSE wk END AS kind2 FROM par),
    nest AS (SELECT DISTINCT c.tid, c.lk AS l1, min(c.lo) OVER (PARTITION BY c.tid, c.lk, c.hi) AS p1, a.lk AS l2, a.lo AS p2 FROM cs c JOIN cs a ON c.tid = a.tid AND c.lo < a.lo AND a.lo < c.hi AND c.lk <> a.lk),
    ord AS (SELECT DISTINCT tid, l1, l2 FROM nest),
    met AS (SELECT a.tid AS tid1, b.tid AS tid2, a.l1, a.l2, a.p1 AS ap1, a.p2 AS ap2, b.p1 AS bp1, b.p2 AS bp2 FROM nest a JOIN nest b ON a.l1 = b.l2 AND a.l2 = b.l1 AND a.tid < b.tid),
    dead AS (SELECT met.* FROM met JOIN lca ON tu = tid1 AND tv = tid2 LEFT JOIN life cu ON cu.tid = lca.cu LEFT JOIN life cv ON cv.tid = lca.cv WHERE CASE
        WHEN lca.cu IS NULL THEN cv.s < ap1 AND (cv.j IS NULL OR ap1 < cv.j) AND cv.s < ap2 AND (cv.j IS NULL OR ap2 < cv.j)
        WHEN lca.cv IS NULL THEN cu.s < bp1 AND (cu.j IS NULL OR bp1 < cu.j) AND cu.s < bp2 AND (cu.j IS NULL OR bp2 < cu.j)
        ELSE (cv.j IS NULL OR cu.s < cv.j) AND (cu.j IS NULL OR cv.s < cu.j) END)
"""
CALLS = "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 101 AS b FROM lineitem WHERE l_suppkey <> l_partkey % 101),\n r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"


def query(sql: str, base: str = FACTS) -> Callable[[Query], Query]:
    return registry.query(sql, base)


def facts(spark: SparkSession, sf_dir: str) -> source.Facts:
    return source.event_facts(spark, sf_dir)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.critical_sections(facts(spark, sf_dir).locks)


@query("SELECT idx, tid, kind, sig FROM mem")
def access_facts(spark, sf_dir):
    return facts(spark, sf_dir).accesses.select("idx", "tid", "kind", "sig")


@query("SELECT tid, ptid, s, j FROM life")
def thread_facts(spark, sf_dir):
    return facts(spark, sf_dir).threads.select("tid", "ptid", "s", "j")


@query("SELECT tid, lk, lo, hi FROM cs")
def critical_sections(spark, sf_dir):
    return sections(spark, sf_dir)


@query("SELECT idx, lk FROM held")
def locksets(spark, sf_dir):
    f = facts(spark, sf_dir)
    return locks.locksets(f.accesses, locks.critical_sections(f.locks))


@query("SELECT sig, tid, count(*) FILTER (kind = 'READ') AS reads, count(*) FILTER (kind = 'WRITE') AS writes FROM mem GROUP BY sig, tid")
def access_counts(spark, sf_dir):
    return races.access_counts(facts(spark, sf_dir).accesses)


@query("SELECT sig, n_threads FROM shared")
def shared_vars(spark, sf_dir):
    return races.shared_vars(facts(spark, sf_dir).accesses)


@query("SELECT idx, tid, kind, sig FROM mem WHERE sig IN (SELECT sig FROM shared)")
def nonlocal_accesses(spark, sf_dir):
    return races.nonlocal_accesses(facts(spark, sf_dir).accesses).select("idx", "tid", "kind", "sig")


@query("SELECT sig, wi, xi FROM cand")
def race_candidates(spark, sf_dir):
    return races.race_candidates(facts(spark, sf_dir).accesses)


@query("SELECT sig, wi, xi FROM unp")
def unprotected_pairs(spark, sf_dir):
    return detect.unprotected_pairs(facts(spark, sf_dir)).select("sig", F.col("a_idx").alias("wi"), F.col("b_idx").alias("xi"))


@query("SELECT sig, idx1, idx2, tid1, tid2, kind1, kind2 FROM race")
def races_found(spark, sf_dir):
    return detect.detect_races(facts(spark, sf_dir)).drop("loc1", "loc2")


@query("SELECT sig, count(*) AS n_races, count(DISTINCT tid1) AS n_first FROM race GROUP BY sig")
def racy_variables(spark, sf_dir):
    return detect.race_numbers(facts(spark, sf_dir))


@query("SELECT sig, CAST(least(CAST(idx1 AS VARCHAR), CAST(idx2 AS VARCHAR)) AS VARCHAR) AS p1, CAST(greatest(CAST(idx1 AS VARCHAR), CAST(idx2 AS VARCHAR)) AS VARCHAR) AS p2, count(*) AS n_pairs FROM race GROUP BY 1, 2, 3")
def distinct_races(spark, sf_dir):
    return detect.distinct_races(facts(spark, sf_dir))


@query("SELECT tid, l1, l2 FROM ord")
def lock_order(spark, sf_dir):
    return locks.lock_order(sections(spark, sf_dir))


@query("SELECT p.tid AS tid1, q.tid AS tid2, p.l1, p.l2 FROM ord p JOIN ord q ON p.l1 = q.l2 AND p.l2 = q.l1 AND p.tid < q.tid")
def deadlock_candidates(spark, sf_dir):
    return deadlocks.candidates(locks.lock_order(sections(spark, sf_dir)))


@query("SELECT DISTINCT tid1, tid2, l1, l2 FROM dead")
def deadlocks_found(spark, sf_dir):
    return detect.detect_deadlocks(facts(spark, sf_dir))


@query("""
    , gate AS (SELECT DISTINCT n.tid, n.p1, n.l1, c.lk AS g FROM nest n JOIN cs c ON c.tid = n.tid AND c.lo < n.p1 AND n.p1 < c.hi AND c.lk <> n.l1)
    SELECT DISTINCT tid1, tid2, l1, l2 FROM dead WHERE NOT EXISTS (SELECT 1 FROM gate a JOIN gate b ON a.g = b.g
        WHERE a.tid = tid1 AND a.p1 = ap1 AND a.l1 = dead.l1 AND b.tid = tid2 AND b.p1 = bp1 AND b.l1 = dead.l2)
""")
def gated_deadlocks(spark, sf_dir):
    return detect.detect_deadlocks(facts(spark, sf_dir), gated=True)


@query("SELECT anc, d AS \"desc\", child FROM up WHERE child IS NOT NULL")
def thread_descendants(spark, sf_dir):
    return threads.descendants(threads.thread_paths(facts(spark, sf_dir).threads))


@query("SELECT d AS tid, CAST(count(*) - 1 AS INTEGER) AS depth FROM up GROUP BY d")
def thread_depth(spark, sf_dir):
    return threads.depths(threads.thread_paths(facts(spark, sf_dir).threads))


@query("SELECT a, b FROM r", CALLS)
def call_reach(spark, sf_dir):
    return graphs.reach(source.call_edges(spark, sf_dir))


def seeds(spark, sf_dir):
    return source.event_log(spark, sf_dir)[1].select((F.col("tid") % 101).alias("node"), "tid")


@query(", t AS (SELECT user_id % 101 AS node, user_id AS tid FROM events UNION SELECT e.b, t.tid FROM t JOIN e ON e.a = t.node) SELECT node, tid FROM t", CALLS)
def tid_propagation(spark, sf_dir):
    return graphs.propagate(source.call_edges(spark, sf_dir), seeds(spark, sf_dir))


@query(", t AS (SELECT user_id % 101 AS node, user_id AS tid FROM events WHERE user_id % 3 <> 0 UNION SELECT e.b, t.tid FROM t JOIN e ON e.a = t.node) SELECT node, tid FROM t", CALLS)
def tid_removal(spark, sf_dir):
    edges, all_seeds = source.call_edges(spark, sf_dir), seeds(spark, sf_dir)
    return graphs.withdraw(edges, all_seeds, all_seeds.filter("tid % 3 = 0"), graphs.propagate(edges, all_seeds))


@query(""", n AS (SELECT a AS node FROM e UNION SELECT b FROM e), root AS (SELECT node FROM n WHERE node % 10 = 0),
    live AS (SELECT node FROM root UNION SELECT b FROM r JOIN root ON r.a = root.node UNION SELECT b FROM r WHERE r.a IN (SELECT a FROM r WHERE a = b))
    SELECT node FROM n ANTI JOIN live USING (node)""", CALLS.replace("l_suppkey AS a", "l_suppkey + 1000 AS a"))
def orphans(spark, sf_dir):
    """Suppliers and parts as methods of two layers, so that some have no caller."""
    edges = source.call_edges(spark, sf_dir).withColumn("a", F.col("a") + 1000)
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    return graphs.orphans(edges, nodes.filter("node % 10 = 0"))


@query("SELECT count(DISTINCT x) AS n_nodes, count(*) // 2 AS n_edges FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e)", CALLS)
def graph_stats(spark, sf_dir):
    return graphs.graph_sizes(source.call_edges(spark, sf_dir))


@query("""
    , hit AS (SELECT idx1 AS idx, tid1 AS tid FROM race UNION SELECT idx2, tid2 FROM race),
    lvl AS (SELECT d, anc, CAST(row_number() OVER (PARTITION BY d ORDER BY depth DESC) AS INTEGER) AS step FROM up JOIN (SELECT d AS anc, count(*) AS depth FROM up GROUP BY d) USING (anc))
    SELECT idx, 0 AS step, tid, idx AS pos FROM hit UNION ALL
    SELECT idx, step, anc, life.s FROM hit JOIN lvl ON lvl.d = hit.tid JOIN life ON life.tid = anc
""")
def explain_race(spark, sf_dir):
    f = facts(spark, sf_dir)
    paths = threads.thread_paths(f.threads)
    return explain.explain(detect.racing_accesses(f, paths=paths).withColumn("pos", F.col("idx")), paths)


@query("""
    , c AS (SELECT sig, idx1 AS write, idx2 AS other, kind2 AS kind FROM race WHERE kind1 = 'WRITE' UNION SELECT sig, idx2, idx1, kind1 FROM race WHERE kind2 = 'WRITE')
    SELECT sig, write, CAST(count(*) AS INTEGER) AS n, string_agg(other || ':' || kind, ',' ORDER BY other, kind) AS concurrent FROM c GROUP BY sig, write
""")
def race_relations(spark, sf_dir):
    return detect.race_relations(facts(spark, sf_dir))


@query("""
    WITH x AS (SELECT i % 6 AS series, CASE i WHEN 0 THEN event_id % 97 WHEN 1 THEN event_id % 89 WHEN 2 THEN event_id % 83 WHEN 3 THEN event_id % 79 WHEN 4 THEN event_id % 73 ELSE event_id % 71 END AS x
        FROM events, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i))
    SELECT series, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, max(x) AS most,
        regexp_replace(regexp_replace(CAST(CAST(round(sum(x) / count(*), 2) AS DECIMAL(30, 2)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS average FROM x GROUP BY series
""".replace("\\\\", "\\"), "")
def latency_stats(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws(" ", *[(F.col("event_id") % m).cast("string") for m in (97, 89, 83, 79, 73, 71)]).alias("value"))
    return graphs.latency_stats(log)


EDITS = """
    , old AS (SELECT user_id AS method, max(value) AS body FROM events WHERE user_id % 7 <> 1 GROUP BY user_id),
    new AS (SELECT user_id AS method, max(value) AS body FROM events WHERE user_id % 7 <> 2 AND (event_type <> 'error' OR user_id % 2 = 0) GROUP BY user_id)
"""


@query(EDITS + """SELECT coalesce(old.method, new.method) AS method, CASE WHEN old.method IS NULL THEN 'ADDED' WHEN new.method IS NULL THEN 'REMOVED' ELSE 'BODY' END AS change
    FROM old FULL JOIN new ON old.method = new.method WHERE old.method IS NULL OR new.method IS NULL OR old.body IS DISTINCT FROM new.body""")
def changed_methods(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("user_id", "method")
    old = ev.filter("method % 7 <> 1").groupBy("method").agg(F.max("value").alias("body"))
    new = ev.filter("method % 7 <> 2 and (event_type <> 'error' or method % 2 = 0)").groupBy("method").agg(F.max("value").alias("body"))
    return scope.changed_methods(old, new, ["method"], "body")


@query("SELECT user_id AS method, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'error' GROUP BY user_id", "")
def newest_change(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'error'").select(F.col("user_id").alias("method"), "event_id", "value")
    return scope.newest(ev, ["method"], ["event_id"])


def edit(spark, sf_dir) -> tuple[source.Facts, DataFrame, DataFrame]:
    """Facts, and an edit of them: accesses that go, and errors that become writes."""
    events, paths = source.event_log(spark, sf_dir)
    before = source.Facts(source.event_accesses(events), source.event_locks(events), paths)
    new = source.event_accesses(events.filter("et = 'error' and idx % 5 = 0").withColumn("et", F.lit("click")))
    return before, before.accesses.filter("idx % 7 = 3"), new


def _after_sql() -> str:
    """FACTS with the edited accesses in place of the plain ones."""
    old = "FROM ev WHERE et IN ('view', 'click'))"
    new = "FROM ev WHERE (et IN ('view', 'click') AND idx % 7 <> 3) OR (et = 'error' AND idx % 5 = 0))"
    assert old in FACTS
    return FACTS.replace(old, new)


def _both(select: str, after: str, first: str, second: str) -> str:
    """Rows of one full run that another one lacks."""
    runs = {"before": f"({FACTS} {select})", "after": f"({after} {select})"}
    return f"SELECT * FROM {runs[first]} EXCEPT SELECT * FROM {runs[second]}"


RACE = "SELECT sig, idx1, idx2, tid1, tid2, kind1, kind2 FROM race"


@query(_both(RACE, _after_sql(), "after", "before"), "")
def delta_races_added(spark, sf_dir):
    return detect.race_delta(*edit(spark, sf_dir))[0].drop("loc1", "loc2")


@query(_both(RACE, _after_sql(), "before", "after"), "")
def delta_races_removed(spark, sf_dir):
    return detect.race_delta(*edit(spark, sf_dir))[1].drop("loc1", "loc2")


def after_lock_edit(spark, sf_dir) -> tuple[source.Facts, source.Facts]:
    """Some lock events go, and errors of some threads become acquisitions of a ninth lock, released by their next purchase."""
    events, paths = source.event_log(spark, sf_dir)
    before = source.Facts(source.event_accesses(events), source.event_locks(events), paths)
    kept = before.locks.filter("not (tid % 11 = 4 and idx % 3 = 0)")
    new = events.filter("tid % 5 = 1 and et in ('error', 'purchase')").select("idx", "tid", F.col("idx").alias("pos"), F.when(F.col("et") == "error", "LOCK").otherwise("UNLOCK").alias("kind"), F.lit(8).alias("lk"))
    return before, before.with_(locks=kept.unionByName(new.select(kept.columns)))


LOCK_EDIT = FACTS.replace("WHERE et = 'signup')", "WHERE et = 'signup' AND NOT (tid % 11 = 4 AND idx % 3 = 0) UNION ALL SELECT idx, tid, 8 FROM ev WHERE et = 'error' AND tid % 5 = 1)").replace("WHERE et = 'purchase')", "WHERE et = 'purchase' AND NOT (tid % 11 = 4 AND idx % 3 = 0) UNION ALL SELECT idx, tid, 8 FROM ev WHERE et = 'purchase' AND tid % 5 = 1)")
DEAD = "SELECT DISTINCT tid1, tid2, l1, l2 FROM dead"


@query(_both(DEAD, LOCK_EDIT, "after", "before"), "")
def delta_deadlocks_added(spark, sf_dir):
    return detect.deadlock_changes(*after_lock_edit(spark, sf_dir))[0]


@query(_both(DEAD, LOCK_EDIT, "before", "after"), "")
def delta_deadlocks_removed(spark, sf_dir):
    return detect.deadlock_changes(*after_lock_edit(spark, sf_dir))[1]


@query(RACE + " WHERE NOT (sig LIKE 'obj.7.%' OR sig LIKE 'obj.21.%')")
def ignore_variable(spark, sf_dir):
    f = facts(spark, sf_dir)
    return detect.detect_races(f.with_(accesses=changes.without_variables(f.accesses, ["obj.7", "obj.21"]))).drop("loc1", "loc2")


@query(RACE + " WHERE sig LIKE 'obj.7.%'")
def consider_variable(spark, sf_dir):
    """What comes back when one of two ignored variables counts again."""
    f = facts(spark, sf_dir)
    ignored = f.with_(accesses=changes.without_variables(f.accesses, ["obj.7", "obj.21"]))
    again = f.with_(accesses=changes.without_variables(f.accesses, ["obj.21"]))
    return detect.race_changes(ignored, again)[0].drop("loc1", "loc2")


@query(RACE + " WHERE tid1 % 5 <> 2 AND tid2 % 5 <> 2")
def ignore_method(spark, sf_dir):
    f = facts(spark, sf_dir)
    methods = f.threads.filter("tid % 5 = 2").select("tid")
    return detect.detect_races(f.with_(accesses=changes.without_methods(f.accesses, methods, "tid"))).drop("loc1", "loc2")


@query("SELECT sig, CAST(string_agg(DISTINCT CASE WHEN kind = 'READ' THEN tid END, ',' ORDER BY CASE WHEN kind = 'READ' THEN tid END) AS VARCHAR) AS readers, CAST(string_agg(DISTINCT CASE WHEN kind = 'WRITE' THEN tid END, ',' ORDER BY CASE WHEN kind = 'WRITE' THEN tid END) AS VARCHAR) AS writers FROM mem GROUP BY sig")
def variable_threads(spark, sf_dir):
    from strandline.operators.traces import variables_to_nodes

    got = variables_to_nodes(facts(spark, sf_dir).accesses.withColumnRenamed("tid", "node_id"))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return got.select("sig", text("readers"), text("writers"))
