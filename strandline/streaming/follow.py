"""Detection that follows a stream of changes.

Each micro-batch of changes (op + | -, and an access) is merged into a stored
state, and only the variables it touches are judged again; what is added and
removed is handed to a sink. State lies in a folder that the cluster shares, one
version a batch, so a failed batch is repeated from the version before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.operators import changes
from strandline.plans import detect
from strandline.sources.facts import Facts


def newest_of_batch(batch: DataFrame) -> DataFrame:
    """One change for each access: the last in `seq`."""
    w = W.partitionBy("idx").orderBy(F.desc("seq"))
    return batch.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def apply_batch(facts: Facts, batch: DataFrame) -> Facts:
    last = newest_of_batch(batch)
    columns = facts.accesses.columns
    return facts.with_(accesses=changes.edited(facts.accesses, last.select("idx"), last.filter("op = '+'").select(columns)))


class Follower:
    """foreachBatch function: keeps accesses under root, calls sink(added, removed, batch_id)."""

    def __init__(self, facts: Facts, root: str, sink: Callable[[DataFrame, DataFrame, int], None]):
        self.facts, self.root, self.sink = facts, root, sink
        self.version = -1
        facts.accesses.write.mode("overwrite").parquet(self._path(-1))

    def _path(self, version: int) -> str:
        return f"{self.root}/accesses/version={version}"

    def _at(self, spark, version: int) -> Facts:
        return self.facts.with_(accesses=spark.read.schema(self.facts.accesses.schema).parquet(self._path(version)))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self._at(spark, batch_id - 1)
        apply_batch(before, batch).accesses.write.mode("overwrite").parquet(self._path(batch_id))
        self.sink(*detect.race_changes(before, self._at(spark, batch_id)), batch_id)
        self.version = batch_id


def follow(stream: DataFrame, facts: Facts, root: str, sink: Callable[[DataFrame, DataFrame, int], None]):
    """Starts a query over what is available: stream has op, seq and the columns of accesses."""
    return stream.writeStream.foreachBatch(Follower(facts, root, sink)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
