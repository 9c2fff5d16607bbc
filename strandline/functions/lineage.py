"""Cutting the lineage of iterated plans with tables in the folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, which only a local session shares with its executors."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Spark removes an execution's shuffle files at its end, and doesn't wait for the driver to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """For steps whose results are written: they need their shuffle files no more, and a driver with little to do would keep them for long."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, which outlives executors.

    A table rather than a checkpoint: a checkpointed frame keeps the size that its
    plan was estimated at, a product over its joins, so estimates of iterated
    joins grow to numbers that take the planner minutes to multiply.
    """
    path = f"{shared_folder(df.sparkSession)}/strandline-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
