"""Program scopes, exclusion files, entry points, and the result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: JDK classes whose accesses count beside the application's (fixed values).
JDK_CLASSES = ("java/util/ArrayList", "java/util/LinkedList", "java/util/HashSet", "java/util/HashMap", "java/util/Arrays", "java/util/String")
MAIN = "main([Ljava/lang/String;)V"


def read_scope(spark: SparkSession, path: str) -> DataFrame:
    """loader, language, kind, path: a scope file's comma-separated lines; blank lines are skipped."""
    return spark.read.csv(path, schema="loader string, language string, kind string, path string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).filter("loader is not null")


def read_exclusions(spark: SparkSession, path: str) -> list[str]:
    """Regular expressions, one a line, all of them: they become one filter of the plan."""
    lines = spark.read.text(path).filter("trim(value) <> ''").select(F.trim("value").alias("v")).collect()
    return [r.v.replace("\\/", "/") for r in lines]


def in_scope(nodes: DataFrame, exclusions: list[str], jdk: tuple[str, ...] = JDK_CLASSES) -> DataFrame:
    """Methods of the application loader or of the listed JDK classes, less the excluded ones."""
    from .facts import excluded

    kept = nodes.filter((F.col("loader") == "Application") | F.regexp_replace("class", "^L", "").isin(*jdk))
    return excluded(kept, F.regexp_replace("class", "^L", ""), exclusions)


def entry_points(nodes: DataFrame, with_threads: bool = False) -> DataFrame:
    """Public static main methods; on request the run methods of threads and runnables too."""
    found = (F.col("method") == MAIN) & F.col("is_static")
    if with_threads:
        found |= (F.col("method") == "run()V") & F.col("is_thread")
    return nodes.filter(found)


def thread_entries(nodes: DataFrame) -> DataFrame:
    """class → node_id of `run` (threads, runnables) or `call` (callables); of several the last node."""
    runs = nodes.filter(((F.col("method") == "run()V") & F.col("is_thread")) | (F.col("method").startswith("call()") & F.col("is_callable")))
    return runs.groupBy("class").agg(F.max_by("node_id", "graph_node_id").alias("node_id"))


def changed_methods(old: DataFrame, new: DataFrame, key: list[str], body: str) -> DataFrame:
    """key and change ADDED | REMOVED | BODY of methods whose bodies differ; two nulls are equal."""
    o, n = old.select(*key, F.col(body).alias("_o"), F.lit(1).alias("_io")), new.select(*key, F.col(body).alias("_n"), F.lit(1).alias("_in"))
    both = o.join(n, key, "full")
    change = F.when(F.col("_io").isNull(), "ADDED").when(F.col("_in").isNull(), "REMOVED").when(~F.col("_o").eqNullSafe(F.col("_n")), "BODY")
    return both.select(*key, change.alias("change")).filter("change is not null")


def newest(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest change of each key."""
    w = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def write_findings(df: DataFrame, path: str) -> None:
    """A result table; markers are its rows, keyed by message."""
    df.write.mode("overwrite").parquet(path)


def merge_markers(shown: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Messages after removals, then additions."""
    return shown.select("message").join(removed.select("message"), "message", "left_anti").unionByName(added.select("message")).distinct()


def write_log(df: DataFrame, path: str) -> None:
    """Lines of a column `value` as text."""
    df.select("value").write.mode("overwrite").text(path)
