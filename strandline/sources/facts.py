"""Fact tables: what a detection reads.

accesses  idx, tid, pos, kind READ | WRITE, sig, loc
locks     idx, tid, pos, kind LOCK | UNLOCK, lk
threads   tid, ptid, s, j      -- start and join, as positions of the parent; root: ptid null

pos orders the events of a thread and may be of any ordered type. `idx` is an
event's identity.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.lineage import cut


@dataclass(frozen=True)
class Facts:
    accesses: DataFrame
    locks: DataFrame
    threads: DataFrame

    def with_(self, **tables: DataFrame) -> Facts:
        return replace(self, **tables)


def read_facts(spark: SparkSession, path: str) -> Facts:
    """Facts stored as Parquet under path, one folder a table."""
    return Facts(*(spark.read.parquet(f"{path}/{t}.parquet") for t in ("accesses", "locks", "threads")))


def event_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(events within their thread's lifetime, threads) of the driver's events table.

    Users are threads in a forest of four children each; lifetimes come from the
    span of a user's events. Only four columns are read. Both tables are written
    once, as all facts derive from them.
    """
    key = F.expr("cast(substr(props, 7, length(props) - 7) as int)")
    ev0 = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("idx"), F.col("user_id").alias("tid"), F.col("event_type").alias("et"), key.alias("k"))
    span = ev0.groupBy("tid").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    mid = F.expr("(lo + hi) div 2")
    joined = (F.col("tid") % 3 == 0) & (F.col("tid") > 0)
    threads = cut(span.select(
        "tid",
        F.when(F.col("tid") > 0, F.expr("(tid - 1) div 4")).alias("ptid"),
        F.when(F.col("tid") % 3 == 1, mid).otherwise(F.col("lo")).alias("s"),
        F.when(joined, mid).alias("j"),
        F.when(joined, mid).otherwise(F.col("hi")).alias("e"),
    ))
    life = threads.select("tid", "s", "e")
    return cut(ev0.join(life, "tid").filter("idx >= s and idx <= e").drop("s", "e")), threads.drop("e")


def event_accesses(events: DataFrame) -> DataFrame:
    """Views read and clicks write the variable that key and position name."""
    sig = F.concat(F.lit("obj."), F.col("k") % 50, F.lit("."), F.col("idx") % 30)
    kind = F.when(F.col("et") == "view", "READ").otherwise("WRITE")
    return events.filter(F.col("et").isin("view", "click")).select("idx", "tid", F.col("idx").alias("pos"), kind.alias("kind"), sig.alias("sig"), F.col("idx").cast("string").alias("loc"))


def event_locks(events: DataFrame) -> DataFrame:
    """Signups acquire and purchases release one of eight locks."""
    kind = F.when(F.col("et") == "signup", "LOCK").otherwise("UNLOCK")
    return events.filter(F.col("et").isin("signup", "purchase")).select("idx", "tid", F.col("idx").alias("pos"), kind.alias("kind"), (F.col("k") % 8).alias("lk"))


def event_facts(spark: SparkSession, sf_dir: str) -> Facts:
    events, threads = event_log(spark, sf_dir)
    return Facts(event_accesses(events), event_locks(events), threads)


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call graph (a calls b), cyclic, of the driver's lineitem table."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_suppkey <> l_partkey % 101")
    return rows.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 101).alias("b")).distinct()


def excluded(df: DataFrame, column: Column, patterns: list[str]) -> DataFrame:
    """Rows whose value matches no exclusion pattern; null values stay."""
    if not patterns:
        return df
    return df.filter(F.coalesce(~column.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(True)))


@dataclass(frozen=True)
class CodeTables:
    """inst, nodes, edges, points_to as in operators.traces."""

    inst: DataFrame
    nodes: DataFrame
    edges: DataFrame
    points_to: DataFrame


def event_code(spark: SparkSession, sf_dir: str) -> CodeTables:
    """The events table read as a program: a user is a method, each event an instruction of it.

    Events of a user, in the order of their ids, are the method's instructions;
    event type and key name the kind, the values used, and what is called.
    """
    key = F.expr("cast(substr(props, 7, length(props) - 7) as int)")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", key.alias("k"))
    k, et = F.col("k"), F.col("event_type")
    kind = F.expr("case event_type when 'view' then if(k % 3 = 0, 'ALOAD', 'GET') when 'click' then if(k % 3 = 0, 'ASTORE', 'PUT') when 'signup' then 'ENTER' when 'purchase' then 'EXIT' else 'INVOKE' end")
    target = F.expr("""case when event_type <> 'error' then null else case k % 8
        when 0 then 'Ljava/lang/Thread.start()V' when 1 then 'Ljava/lang/Thread.join()V' when 2 then 'Ljava/util/concurrent/Executor.execute(Ljava/lang/Runnable;)V'
        when 3 then 'Ljava/lang/Thread.<init>(Ljava/lang/Runnable;)V' when 4 then 'Ljava/util/concurrent/Future.get()Ljava/lang/Object;' else concat('Lapp/C.f', k, '()V') end end""")
    text = F.when(et == "error", F.concat(F.lit("invoke "), target)).otherwise(F.concat_ws(" ", F.when(et.isin("signup", "purchase"), "monitor").when(et == "view", "getfield").otherwise("store"), k.cast("string")))
    node = lambda c: F.concat(F.lit("m"), c)
    inst = cut(ev.select(
        node("user_id").alias("node_id"), F.col("event_id").alias("iindex"), kind.alias("kind"), (F.col("event_id") % 1000).alias("line"), (k % 5 == 2).alias("in_loop"), (F.col("event_id") % 11 == 0).alias("in_catch"),
        (k % 7).alias("def"), F.array(k % 5, k % 4).alias("uses"), target.alias("target"), F.concat(F.lit("Lapp/D"), k % 6).alias("declaring"), F.concat(F.lit("f"), k % 10).alias("field"), (k % 4 == 1).alias("is_static"), text.alias("text"), k.alias("k"),
    ))
    u = F.col("user_id")
    users = ev.select("user_id").distinct()
    nodes = cut(users.select(
        "user_id", node("user_id").alias("node_id"), F.concat(F.lit("Lapp/C$"), u % 40).alias("class"),
        F.when(u % 5 == 0, "run()V").when(u % 5 == 1, "main([Ljava/lang/String;)V").when(u % 5 == 2, "call()Ljava/lang/Object;").otherwise(F.concat(F.lit("f"), u, F.lit("()V"))).alias("method"),
        F.when(u % 4 == 3, "Primordial").otherwise("Application").alias("loader"), (u % 6 == 1).alias("is_sync"), (u % 9 == 4).alias("is_static"), (u % 13 == 5).alias("is_init"), (u % 17 == 6).alias("is_clinit"),
        (u % 10 != 5).alias("is_thread"), (u % 3 != 0).alias("is_callable"), u.alias("graph_node_id"),
    ))
    edges = ev.filter("event_type = 'error'").select(node("user_id").alias("caller"), F.col("event_id").alias("iindex"), node(k).alias("callee")).join(nodes.select(F.col("node_id").alias("callee")), "callee").select("caller", "iindex", "callee")
    values = users.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("o", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("n", (u * 3 + F.col("v") + 5 * F.col("o")) % 24)
    kept = values.filter((F.col("o") == 0) & ((u + F.col("v")) % 4 != 0) | (F.col("o") == 1) & ((u + F.col("v")) % 5 == 0))
    points_to = kept.select(node("user_id").alias("node_id"), F.col("v").alias("value"), F.when(F.col("n") % 5 == 0, "Ljava/lang/Thread").otherwise(F.concat(F.lit("Lapp/C$"), F.col("n"))).alias("obj_type"), F.concat(F.lit("o"), F.col("n")).alias("obj_id"))
    return CodeTables(inst, nodes, cut(edges), cut(points_to))
