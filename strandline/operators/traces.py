"""Traces: from a program's instructions to ordered events.

inst      node_id, iindex, kind, line, in_loop, in_catch, def, uses ARRAY<INT>,
          target, declaring, field, is_static, text
points_to node_id, value, obj_type, obj_id      -- a row for each object
cg_node   node_id, class, method, ..., is_sync, is_static, is_init, is_clinit
cg_edge   caller, iindex, callee

Kinds of instructions: GET, PUT, ALOAD, ASTORE, ENTER, EXIT, INVOKE, other.
Events get pos, an array of numbers that orders them within a method: the
instruction's index, then a place before (0), at (1) or after (2) it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.functions.lineage import cut
from strandline.functions.signatures import array_sig, field_prefix, line_sig, lock_sig, object_sig

#: What keeps an instruction that follows a catch block (fixed values).
KEPT_AFTER_CATCH = ("start", "join", "put", "get", "monitor")


def place(n: int) -> Column:
    return F.array(F.col("iindex"), F.lit(n))


def without_catch_blocks(inst: DataFrame, blocks: DataFrame | None = None, cfg: DataFrame | None = None) -> DataFrame:
    """Instructions outside catch blocks.

    With blocks (node_id, iindex, block) and cfg (node_id, block, succ), of the
    direct successors of catch blocks only instructions whose text speaks of
    threads, fields or monitors stay.
    """
    kept = inst.filter(~F.coalesce("in_catch", F.lit(False)))
    if blocks is None or cfg is None:
        return kept
    caught = inst.filter("in_catch").join(blocks, ["node_id", "iindex"]).select("node_id", "block").distinct()
    after = cfg.join(caught, ["node_id", "block"]).select("node_id", F.col("succ").alias("block")).distinct()
    doubtful = blocks.join(after, ["node_id", "block"]).select("node_id", "iindex", F.lit(True).alias("_after"))
    said = F.col("text").rlike("|".join(KEPT_AFTER_CATCH))
    return kept.join(doubtful, ["node_id", "iindex"], "left").filter(F.col("_after").isNull() | said).drop("_after")


def classified(inst: DataFrame) -> DataFrame:
    """inst with event: READ, WRITE, LOCK, UNLOCK, START, JOIN, CALL or null."""
    target = F.col("target")
    # An array of patterns: what starts, what waits for a thread (fixed values).
    starts = target.contains(".start()V") | target.contains(".execute(Ljava/lang/Runnable;)V") | target.contains(".submit(Ljava/lang/Runnable;)")
    joins = target.contains(".join()V") | (target.contains(".Future.get(") | target.contains("/Future.get(")) | target.contains(".shutdown()V")
    kind = F.col("kind")
    event = (
        F.when(kind.isin("GET", "ALOAD"), "READ").when(kind.isin("PUT", "ASTORE"), "WRITE").when(kind == "ENTER", "LOCK").when(kind == "EXIT", "UNLOCK")
        .when((kind == "INVOKE") & starts, "START").when((kind == "INVOKE") & joins, "JOIN").when(kind == "INVOKE", "CALL")
    )
    return inst.withColumn("event", event)


def runnables(inst: DataFrame) -> DataFrame:
    """node_id, thread, runnable: values given to a Thread's constructor."""
    init = inst.filter("kind = 'INVOKE' and target like '%Thread.<init>(Ljava/lang/Runnable;%'")
    return init.select("node_id", F.col("uses")[0].alias("thread"), F.col("uses")[1].alias("runnable"))


def resolve_definition(values: DataFrame, def_use: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """node_id, value, origin: what a value was copied from in the end, back over all assignments (node_id, to, from)."""
    step = def_use.select("node_id", F.col("to").alias("origin"), F.col("from").alias("_from")).distinct()
    known = cut(values.select("node_id", "value", F.col("value").alias("origin")).distinct())
    fresh = known
    for _ in range(most_rounds):
        back = fresh.join(step, ["node_id", "origin"]).select("node_id", "value", F.col("_from").alias("origin")).distinct()
        fresh = cut(back.join(known, ["node_id", "value", "origin"], "left_anti"))
        if fresh.isEmpty():
            return known.join(step, ["node_id", "origin"], "left_anti").select("node_id", "value", "origin")
        known = cut(known.unionByName(fresh))
    raise RuntimeError("the definitions didn't settle")


def field_accesses(inst: DataFrame, nodes: DataFrame) -> DataFrame:
    """GET and PUT instructions that count.

    Constructors and static initialisers are skipped. A read whose value the next
    instruction locks on doesn't count, nor does the read just before it that
    gave it its object.
    """
    w = W.partitionBy("node_id").orderBy("iindex")
    base = F.get("uses", F.lit(0))
    feeds = (F.col("kind") == "GET") & (F.lead("kind").over(w).isin("ENTER", "EXIT")) & (F.lead(base).over(w) == F.col("def"))
    marked = inst.withColumn("_feeds", F.coalesce(feeds, F.lit(False)))
    next_feeds, next_base = F.lead("_feeds").over(w), F.lead(base).over(w)
    gives = (F.col("kind") == "GET") & F.coalesce(next_feeds & (next_base == F.col("def")), F.lit(False))
    plain = nodes.filter("not coalesce(is_init, false) and not coalesce(is_clinit, false)").select("node_id", "class")
    return marked.withColumn("_gives", gives).join(plain, "node_id").filter("kind in ('GET', 'PUT') and not _feeds and not _gives").drop("_feeds", "_gives")


def field_events(inst: DataFrame, nodes: DataFrame, points_to: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """node_id, pos, kind, sig, prefix, loc, line: a row for each object that the access may touch."""
    at = field_accesses(inst, nodes).withColumn("prefix", field_prefix(F.col("declaring"), F.col("field"))).withColumn("value", F.when(F.col("is_static"), F.col("def")).otherwise(F.get("uses", F.lit(0))))
    if excluded:
        at = at.filter(~F.col("prefix").isin(*excluded))
    seen = at.join(points_to.select("node_id", "value", "obj_id"), ["node_id", "value"], "left")
    return seen.select("node_id", place(1).alias("pos"), F.when(F.col("kind") == "GET", "READ").otherwise("WRITE").alias("kind"), object_sig(F.col("prefix"), F.col("obj_id")).alias("sig"), "prefix", line_sig(F.col("class"), F.col("line")).alias("loc"), "line").distinct()


def array_events(inst: DataFrame, nodes: DataFrame, points_to: DataFrame) -> DataFrame:
    """The same for array elements, whatever their index."""
    at = inst.filter("kind in ('ALOAD', 'ASTORE')").withColumn("value", F.get("uses", F.lit(0))).join(nodes.select("node_id", "class"), "node_id")
    seen = at.join(points_to.select("node_id", "value", "obj_id"), ["node_id", "value"])
    return seen.select("node_id", place(1).alias("pos"), F.when(F.col("kind") == "ALOAD", "READ").otherwise("WRITE").alias("kind"), array_sig(F.col("obj_id")).alias("sig"), F.lit("array").alias("prefix"), line_sig(F.col("class"), F.col("line")).alias("loc"), "line").distinct()


def monitor_events(inst: DataFrame, points_to: DataFrame) -> DataFrame:
    """node_id, pos, kind LOCK | UNLOCK, lk: a row for each object a monitor may be of."""
    at = inst.filter("kind in ('ENTER', 'EXIT')").withColumn("value", F.get("uses", F.lit(0)))
    seen = at.join(points_to, ["node_id", "value"])
    return seen.select("node_id", place(1).alias("pos"), F.when(F.col("kind") == "ENTER", "LOCK").otherwise("UNLOCK").alias("kind"), lock_sig(F.col("obj_type"), F.col("obj_id")).alias("lk")).distinct()


def synchronized_calls(inst: DataFrame, edges: DataFrame, nodes: DataFrame, points_to: DataFrame) -> DataFrame:
    """LOCK before and UNLOCK after each call of a synchronized method; a static one locks its class."""
    called = edges.join(nodes.filter("is_sync").select(F.col("node_id").alias("callee"), "class", "is_static"), "callee").select(F.col("caller").alias("node_id"), "iindex", "class", "is_static")
    at = called.join(inst.select("node_id", "iindex", F.get("uses", F.lit(0)).alias("value")), ["node_id", "iindex"])
    seen = at.join(points_to, ["node_id", "value"], "left")
    lk = F.when(F.col("is_static"), F.col("class")).otherwise(lock_sig(F.col("obj_type"), F.col("obj_id")))
    both = F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit("LOCK").alias("kind")), F.struct(F.lit(2).alias("at"), F.lit("UNLOCK").alias("kind"))))
    return seen.select("node_id", "iindex", lk.alias("lk"), both.alias("b")).filter("lk is not null").select("node_id", F.array("iindex", "b.at").alias("pos"), "b.kind", "lk").distinct()


def call_events(inst: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, pos, target: calls of methods that are in the graph, neither starts nor joins."""
    plain = classified(inst).filter("event = 'CALL'").select("node_id", "iindex")
    return edges.select(F.col("caller").alias("node_id"), "iindex", F.col("callee").alias("target")).join(plain, ["node_id", "iindex"]).select("node_id", place(1).alias("pos"), "target").distinct()


def thread_bodies(inst: DataFrame, entries: DataFrame, points_to: DataFrame, def_use: DataFrame | None = None) -> DataFrame:
    """obj_type, obj_id, _entry of thread objects: the entry of the object's own type; for a plain Thread, or a type without one, that of the runnable its constructor was given."""
    own = points_to.select("obj_type", "obj_id").distinct().join(entries.select(F.col("class").alias("obj_type"), F.col("node_id").alias("_entry")), "obj_type")
    given = runnables(inst)
    if def_use is not None:
        origins = resolve_definition(given.select("node_id", F.col("runnable").alias("value")), def_use).withColumnRenamed("value", "runnable")
        given = given.unionByName(given.join(origins, ["node_id", "runnable"]).select("node_id", "thread", F.col("origin").alias("runnable"))).distinct()
    made = given.join(points_to.select("node_id", F.col("value").alias("thread"), "obj_type", "obj_id"), ["node_id", "thread"])
    body = points_to.select("node_id", F.col("value").alias("runnable"), F.col("obj_type").alias("class")).join(entries.select("class", F.col("node_id").alias("_entry")), "class")
    passed = made.join(body, ["node_id", "runnable"]).select("obj_type", "obj_id", "_entry").distinct()
    plain = F.col("obj_type").rlike("^L?java/lang/Thread;?$")
    key = ["obj_type", "obj_id"]
    through = passed.join(own.filter(~plain).select(*key), key, "left_anti")
    return own.join(through.select(*key), key, "left_anti").unionByName(through)


def thread_events(inst: DataFrame, entries: DataFrame, points_to: DataFrame, def_use: DataFrame | None = None) -> DataFrame:
    """node_id, pos, kind START | JOIN, target, in_loop: the receiver's types, or the runnables they were made with, name the entry."""
    at = classified(inst).filter("event in ('START', 'JOIN')").withColumn("value", F.coalesce(F.when(F.col("target").rlike("execute|submit"), F.get("uses", F.lit(1))), F.get("uses", F.lit(0))))
    seen = at.join(points_to, ["node_id", "value"]).join(thread_bodies(inst, entries, points_to, def_use), ["obj_type", "obj_id"])
    return seen.select("node_id", place(1).alias("pos"), F.col("event").alias("kind"), F.col("_entry").alias("target"), F.coalesce("in_loop", F.lit(False)).alias("in_loop")).distinct()


def in_loops(cfg: DataFrame) -> DataFrame:
    """Distinct (node_id, block) that lie on a cycle of their method's flow graph (node_id, block, succ)."""
    from .graphs import reach

    name = lambda c: F.concat_ws("\x01", "node_id", F.col(c).cast("string"))
    closed = reach(cfg.select(name("block").alias("a"), name("succ").alias("b"))).filter("a = b")
    parts = F.split("a", "\x01")
    return closed.select(parts[0].alias("node_id"), parts[1].cast("int").alias("block"))


def subclasses(supertype: DataFrame, roots: list[str]) -> DataFrame:
    """Distinct (class): the roots and all that extend or implement them, over (class, parent)."""
    from .graphs import reach

    spark = supertype.sparkSession
    up = reach(supertype.select(F.col("class").alias("a"), F.col("parent").alias("b")))
    own = spark.createDataFrame([(r,) for r in roots], "class string")
    return up.filter(F.col("b").isin(*roots)).select(F.col("a").alias("class")).unionByName(own).distinct()


def located(events: DataFrame, inst: DataFrame) -> DataFrame:
    """events (node_id, pos, ...) with the source line of their instruction, null if it isn't known."""
    lines = inst.select(F.col("node_id").alias("_n"), F.col("iindex").alias("_i"), "line")
    return events.join(lines, (F.col("node_id") == F.col("_n")) & (F.col("pos")[0] == F.col("_i")), "left").drop("_n", "_i")


def methods_by_class(nodes: DataFrame) -> DataFrame:
    """class, methods."""
    return nodes.groupBy("class").agg(F.array_sort(F.collect_set("method")).alias("methods"))


def replace_trace(events: DataFrame, new: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """events with those of methods (node_id) replaced by new ones; a method without new ones has none. Without methods, those that `new` covers."""
    return delete_traces(events, (new if methods is None else methods).select("node_id").distinct()).unionByName(new)


def delete_traces(events: DataFrame, nodes: DataFrame) -> DataFrame:
    return events.join(nodes.select("node_id"), "node_id", "left_anti")


def call_graph_edges(calls: DataFrame, tids: DataFrame) -> DataFrame:
    """src_node, src_pos, sink_node, tid: an edge for every thread that runs the caller."""
    return calls.join(tids, "node_id").select(F.col("node_id").alias("src_node"), F.col("pos").alias("src_pos"), F.col("target").alias("sink_node"), "tid").distinct()


def incoming_edge(edges: DataFrame) -> DataFrame:
    """sink_node, tid, src_node, src_pos: of several incoming edges of a thread the least."""
    return edges.groupBy("sink_node", "tid").agg(F.min(F.struct("src_node", "src_pos")).alias("e")).select("sink_node", "tid", "e.src_node", "e.src_pos")


def in_thread(events: DataFrame, tids: DataFrame) -> DataFrame:
    """Events of methods (node_id, pos, ...) for each thread (node_id, tid) that runs them, with an identity."""
    each = events.join(tids, "node_id")
    pos = F.array_join(F.col("pos").cast("array<string>"), ".") if dict(events.dtypes)["pos"].startswith("array") else F.col("pos").cast("string")
    return each.withColumn("idx", F.concat_ws("@", "node_id", pos, F.col("tid").cast("string")))


def variables_to_nodes(events: DataFrame) -> DataFrame:
    """sig, readers, writers: the methods that read and write it."""
    who = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("node_id"))))
    return events.groupBy("sig").agg(who("READ").alias("readers"), who("WRITE").alias("writers"))
