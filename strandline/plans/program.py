"""From a program's instructions to the facts that a detection reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.functions.lineage import cut
from strandline.operators import graphs, locks, traces
from strandline.sources.facts import Facts


@dataclass(frozen=True)
class Program:
    """inst, nodes, edges and points_to as in operators.traces; entries: class → node_id of its thread body; def_use: assignments (node_id, to, from), where points_to leaves out copies."""

    inst: DataFrame
    nodes: DataFrame
    edges: DataFrame
    points_to: DataFrame
    entries: DataFrame
    ignored_variables: tuple[str, ...] = ()
    def_use: DataFrame | None = None


def call_steps(calls: DataFrame, events: DataFrame, monitors: DataFrame) -> DataFrame:
    """calls with what tells two ways apart: node_id, pos, target, ordered, to_ordered, rank, held.

    A method is ordered if it starts or joins a thread, itself or by a call. rank
    is how many such places precede the call in its method; held are the locks
    around the call in its method, in the order they are taken, each with the rank
    of its acquisition.
    """
    places = events.select("node_id", "pos").distinct()
    seeds = places.select(F.col("node_id").alias("node"), F.lit(1).alias("tid"))
    reached = cut(graphs.propagate(calls.select(F.col("target").alias("a"), F.col("node_id").alias("b")), seeds).select("node"))
    leading = calls.join(reached, F.col("target") == F.col("node")).select("node_id", "pos")
    marks = places.unionByName(leading).distinct().groupBy("node_id").agg(F.collect_list("pos").alias("marks"))
    sections = locks.merged_sections(locks.critical_sections(monitors.withColumnRenamed("node_id", "tid")))
    taken = locks.inside(calls.withColumnRenamed("node_id", "tid"), sections).groupBy(F.col("tid").alias("node_id"), "pos", "target").agg(F.sort_array(F.collect_set(F.struct("lo", "lk"))).alias("taken"))
    before = lambda p: F.when(F.col("marks").isNotNull(), F.size(F.filter("marks", lambda m: m < p)))
    held = F.transform("taken", lambda x: F.struct(before(x["lo"]).alias("rank"), x["lk"].alias("lk")))
    known = calls.join(marks, "node_id", "left").join(taken, ["node_id", "pos", "target"], "left").join(reached, F.col("target") == F.col("node"), "left")
    return cut(known.select("node_id", "pos", "target", F.col("marks").isNotNull().alias("ordered"), F.col("node").isNotNull().alias("to_ordered"), before(F.col("pos")).alias("rank"), F.coalesce(held, F.array().cast("array<struct<rank: int, lk: string>>")).alias("held")))


def placements(started: DataFrame, steps: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(tid, node_id, at): the methods each thread runs, with the calls' places that lead there.

    started: tid, node_id; steps as of call_steps. A method is placed once for each
    way that differs in its place among starts and joins, or in the locks held and
    where they were taken; of equal ways the least of the shortest counts. A method
    that starts or joins threads is on a way twice at most: what its second turn
    sees, later ones see too.
    """
    none = F.array().cast("array<int>")
    state = ["tid", "node_id", "among", "locks"]
    known = cut(started.select("tid", "node_id", none.alias("at"), none.alias("among"), F.array().cast("array<struct<among: array<int>, lk: string>>").alias("locks"), F.array("node_id").alias("turns")))
    fresh = known
    steps = steps.withColumnRenamed("node_id", "_from")
    for _ in range(most_rounds):
        met = fresh.join(steps, F.col("node_id") == F.col("_from")).filter(~F.col("to_ordered") | (F.size(F.filter("turns", lambda x: x == F.col("target"))) < 2))
        among = F.when(F.col("to_ordered"), F.concat("among", "pos")).when(F.col("ordered"), F.concat("among", F.array("rank"))).otherwise(F.col("among"))
        new = F.filter("held", lambda x: ~F.exists("locks", lambda y: y["lk"] == x["lk"]))
        own = F.transform(new, lambda x: F.struct(F.when(F.col("ordered"), F.concat("among", F.array(x["rank"]))).otherwise(F.col("among")).alias("among"), x["lk"].alias("lk")))
        turns = F.when(F.col("to_ordered"), F.concat("turns", F.array("target"))).otherwise(F.col("turns"))
        there = met.select("tid", F.col("target").alias("node_id"), F.concat("at", "pos").alias("at"), among.alias("among"), F.concat("locks", own).alias("locks"), turns.alias("turns"))
        least = there.groupBy(*state).agg(F.min(F.struct("at", "turns")).alias("way")).select(*state, "way.*")
        fresh = cut(least.join(known.select(*state), state, "left_anti").select(*known.columns))
        if fresh.isEmpty():
            return known.select("tid", "node_id", "at")
        known = cut(known.unionByName(fresh))
    raise RuntimeError("the call graph didn't settle")


def thread_forest(program: Program, main: str, steps: DataFrame, events: DataFrame, most_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(threads, placements). A start in a loop makes two threads; a thread doesn't start its own ancestors' bodies, so the forest ends."""
    spark = program.inst.sparkSession
    root = spark.createDataFrame([(main, main, None, [main])], "tid string, node_id string, ptid string, bodies array<string>").withColumn("s", F.array().cast("array<int>"))
    level, all_threads, placed = root, root, None
    for _ in range(most_rounds):
        here = placements(level, steps)
        placed = here if placed is None else placed.unionByName(here)
        starts = events.filter("kind = 'START'").join(here, "node_id").join(level.select("tid", "bodies"), "tid").filter(~F.array_contains("bodies", F.col("target")))
        each = starts.select(F.col("tid").alias("ptid"), F.concat("at", "pos").alias("s"), F.col("target").alias("node_id"), F.concat("bodies", F.array("target")).alias("bodies"), F.explode(F.sequence(F.lit(1), F.when(F.col("in_loop"), 2).otherwise(1))).alias("copy"))
        n = F.row_number().over(W.partitionBy("ptid", "node_id").orderBy("s", "copy"))
        level = cut(each.withColumn("n", n).select(F.concat_ws("/", "ptid", F.when(F.col("n") == 1, F.col("node_id")).otherwise(F.concat_ws("#", "node_id", "n"))).alias("tid"), "node_id", "ptid", "bodies", "s"))
        if level.isEmpty():
            break
        all_threads = all_threads.unionByName(level)
    else:
        raise RuntimeError("the threads' forest didn't end")
    # A join of a body waits for the parent's threads of that body that were started before it.
    waits = events.filter("kind = 'JOIN'").join(placed, "node_id").select(F.col("tid").alias("_p"), F.col("target").alias("_n"), F.concat("at", "pos").alias("j"))
    met = all_threads.join(waits, (F.col("ptid") == F.col("_p")) & (F.col("node_id") == F.col("_n")) & (F.col("s") < F.col("j")), "left")
    threads = met.groupBy("tid", "ptid", "s").agg(F.min("j").alias("j"))
    return cut(threads), cut(placed)


def facts_of(program: Program, main: str) -> Facts:
    """Accesses, locks and threads of a program whose first thread runs `main`."""
    inst = traces.without_catch_blocks(program.inst)
    fields = traces.field_events(inst, program.nodes, program.points_to, list(program.ignored_variables) or None)
    touched = fields.unionByName(traces.array_events(inst, program.nodes, program.points_to))
    # Events are written once, as every level of the forest and every detection read them.
    monitors = cut(traces.monitor_events(inst, program.points_to).unionByName(traces.synchronized_calls(inst, program.edges, program.nodes, program.points_to)))
    calls = cut(traces.call_events(inst, program.edges))
    events = cut(traces.thread_events(inst, program.entries, program.points_to, program.def_use))
    forest, placed = thread_forest(program, main, call_steps(calls, events, monitors), events)
    place = F.concat("at", "pos").alias("pos")
    name = lambda *c: F.concat_ws("@", "tid", "node_id", F.array_join(F.concat("at", "pos").cast("array<string>"), "."), *c).alias("idx")
    accesses = touched.join(placed, "node_id").select(name("sig", "kind"), "tid", place, "kind", "sig", "loc")
    locked = monitors.join(placed, "node_id").select(name("lk", "kind"), "tid", place, "kind", "lk")
    return Facts(cut(accesses), cut(locked), forest)
