"""What the corpus operators share: the shared folder, written tables, skew-safe joins."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.lineage import shared_folder, shuffles_removed

#: A side is broadcast whole only with so many rows of a few numbers or digests, about 6 MB.
MAX_BROADCAST_ROWS = 50_000
#: Rows of a batch that are Python objects at a time.
BATCH_ROWS = 500
#: Bytes of the batches that go to a worker at a time; a longer row goes alone. Arrow's allocator keeps chunks of 16 MB for buffers
#: near that size, for each of a JVM's threads, so batches are far smaller.
BATCH_BYTES, ARROW_BYTES, SPARKS_OWN = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: glibc's number of the parameter.
M_MMAP_THRESHOLD = -3
#: Bits of the prefilter that `possible_members` broadcasts: 8 MB at any input size.
FILTER_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and the session is local."""
    return shared_folder(spark)


#: The folders of the settled() calls that are being built, the innermost last.
_scratch: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{_scratch[-1] if _scratch else shared_dir(spark)}/strandline-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None, few: bool = False, plain: bool = False) -> DataFrame:
    """The same rows from Parquet in the shared folder: they outlive executors, and lineage ends here.

    few: there are little data for each task, so they are gathered into files of a useful size.
    plain: the data are hashes, which no compression makes smaller.
    """
    spark = df.sparkSession
    path = path or fresh_dir(spark, name)
    (df.hint("rebalance") if few else df).write.mode("overwrite").parquet(path, compression="none" if plain else None)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build returns, as a written table; all that it wrote on the way is deleted."""
    result, folder = fresh_dir(spark, name), fresh_dir(spark, f"{name}-work")
    _scratch.append(folder)
    try:
        with shuffles_removed(spark):
            out = written(build(), name, result)
    finally:
        _scratch.pop()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with small batches, whose worker gives back what memory a task has freed.

    The session's Arrow batches are bounded to BATCH_BYTES, whatever their rows,
    which holds for a JVM's buffers as well as for its worker's; a bound that the
    session was given stays.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_BYTES) == SPARKS_OWN:
        conf.set(ARROW_BYTES, f"{BATCH_BYTES}b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            libc = ctypes.CDLL("libc.so.6")
            # Large arrays lie in maps of their own, which go back as soon as they are freed.
            libc.mallopt(M_MMAP_THRESHOLD, 1 << 20)
            pa.set_memory_pool(pa.system_memory_pool())
        except (OSError, AttributeError):  # another C library; freed memory then stays with the worker
            libc = None

        def pieces() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    yield batch.slice(at, BATCH_ROWS)

        yield from run(pieces())
        if libc:
            libc.malloc_trim(0)

    return df.mapInArrow(bounded, schema)


class Shared:
    """A broadcast value that workers unpickle without having this package."""

    def __init__(self, spark: SparkSession, value: object):
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if "held" not in self.__dict__:
            self.held = pickle.loads(self.bytes.value)
        return self.held

    def __getstate__(self) -> dict:
        return {"bytes": self.bytes}


def mark_members(df: DataFrame, key: Column, members: DataFrame, member_key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """df with _maybe: whether its key may be among members, by a broadcast bitmap of fixed size."""
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(bits)) + 1
    marks = (
        members.select(slot(member_key).alias("_slot"))
        .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    )
    byte = "conv(hex(substring(_bits, cast(bitmap_bit_position(_slot) div 8 as int) + 1, 1)), 16, 10)"
    maybe = F.coalesce(F.expr(f"bit_get(cast({byte} as int), cast(bitmap_bit_position(_slot) % 8 as int)) = 1"), F.lit(False))
    slots = df.withColumn("_slot", slot(key)).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    return slots.join(F.broadcast(marks), "_bucket", "left").withColumn("_maybe", maybe).drop("_slot", "_bucket", "_bits")


def collected_bits(slots: DataFrame, bits: int) -> np.ndarray:
    """A bitmap, bit i % 8 of byte i // 8, of the values of a column `slot` below `bits`, a power of two: bits / 8 bytes on the driver, whatever the rows."""
    at = slots.select((F.col("slot") + 1).alias("_slot"))
    rows = at.groupBy(F.bitmap_bucket_number("_slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("part")).collect()
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.part), np.uint8)
        out[4096 * (r.bucket - 1) : 4096 * (r.bucket - 1) + len(part)] = part
    return out[: bits // 8]


def possible_members(df: DataFrame, key: Column, members: DataFrame, member_key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of df whose key may be among members: a bitmap of fixed size, so false hits occur, misses don't.

    Rows are thereby dropped before a shuffle; an exact join must follow.
    """
    return mark_members(df, key, members, member_key, bits).filter("_maybe").drop("_maybe")


def without(df: DataFrame, dropped: DataFrame, keys: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """The rows of df whose keys (columns of both, never null in dropped) aren't in dropped.

    Only rows that the bitmap can't tell apart from dropped ones are shuffled.
    """
    key = F.struct(*[F.col(k) for k in keys])
    marked = mark_members(df, key, dropped, key, bits)
    sure, maybe = marked.filter("not _maybe").drop("_maybe"), marked.filter("_maybe").drop("_maybe")
    return sure.unionByName(maybe.join(dropped.select(*keys).distinct(), keys, "left_anti").select(df.columns))


def join_counted(rows: DataFrame, table: DataFrame, keys: str | list[str], count: str, total: int) -> DataFrame:
    """rows joined with a table that has one row a key, and in `count` how many of rows have the key.

    Keys with at least total / MAX_BROADCAST_ROWS rows are so few that they are
    broadcast; the others are shuffled, and none of those is large.
    """
    least = max(1000, -(-total // MAX_BROADCAST_ROWS))
    hot, cold = table.filter(F.col(count) >= least), table.filter(F.col(count) < least)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(cold, keys))
