"""Exact dedup: a streaming aggregation whose keyed state lies on disk and never expires.

Documents are landed first: identifier, digest, content, and a locator, which
is the number of the landing and of the row in it, so it finds one landed row
for good. The digests go through a Structured Streaming aggregation without a
watermark, so its RocksDB state keeps one entry a digest for good: the digest,
the smallest identifier with its locator, and a count. Hits, rows whose digest
has another row, have their full bytes compared with the content that the
holder's locator finds; rows that share only a digest are told apart by bytes.

Everything here is DataFrame code on the JVM.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, join_counted, possible_members, settled, without, written

_STATE = "spark.sql.streaming.stateStore"
#: State on disk, an executor's native memory for all its state partitions bounded, no disk preallocated for small ones.
STATE_CONF = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": "48",
    f"{_STATE}.rocksdb.writeBufferSizeMB": "4",
    f"{_STATE}.rocksdb.allowFAllocate": "false",
    f"{_STATE}.maintenanceInterval": "10s",
}
#: So many copies are compared with one replica of the text that stays.
COPIES_A_REPLICA = 256


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class StreamingDedup:
    """Keyed state that outlives calls: add() takes further documents, groups() gives the state.

    root: a folder that driver and executors share. The landed digests, the
    state's checkpoint and its changes lie below it, so a lost executor or a new
    session goes on from the last committed batch.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, rows_files_a_batch: int | None = None):
        self.spark, self.root, self.files = spark, root or fresh_dir(spark, "dedup"), rows_files_a_batch

    def add(self, rows: DataFrame) -> None:
        """rows: doc_id, digest, norm (the content). Lands them under new locators and runs the stream over what is new."""
        try:
            earlier = self.landed().agg(F.max("locator.landing")).first()[0]
        except AnalysisException:  # nothing is landed yet
            earlier = None
        locator = F.struct(F.lit(0 if earlier is None else earlier + 1).alias("landing"), F.monotonically_increasing_id().alias("row"))
        landed = rows.select("doc_id", "digest", locator.alias("locator"), "norm")
        landed.write.mode("append").parquet(f"{self.root}/landed", compression="zstd")
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in STATE_CONF}
        for k, v in STATE_CONF.items():
            conf.set(k, v)
        try:
            stream = self.spark.readStream.schema(landed.drop("norm").schema)
            if self.files:
                stream = stream.option("maxFilesPerTrigger", self.files)
            state = (
                stream.parquet(f"{self.root}/landed")
                .groupBy("digest")
                .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("holder"), F.count(F.lit(1)).alias("group_size"))
            )
            changes = f"{self.root}/changes"
            (
                state.writeStream.outputMode("update")
                .foreachBatch(lambda df, n: df.hint("rebalance").write.mode("overwrite").parquet(f"{changes}/batch={n}"))
                .option("checkpointLocation", f"{self.root}/state")
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def landed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/landed")

    def groups(self) -> DataFrame:
        """A row for each digest: digest, holder, group_size. Later batches supersede earlier ones."""
        schema = "digest binary, holder struct<no_id: boolean, doc_id: " + dict(self.landed().dtypes)["doc_id"] + ", locator: struct<landing: int, row: bigint>>, group_size bigint"
        changes = self.spark.read.schema(schema).parquet(f"{self.root}/changes/batch=*")
        return changes.groupBy("digest").agg(F.min("holder").alias("holder"), F.max("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest doc_id stays; null ids
    come last. Of rows repeated under one id just one is kept, the first landed.
    Null and empty texts are equal to each other. Further columns are ignored.
    digest: replaces the SHA-256 digest (binary); its collisions are resolved by
    the texts' bytes.
    """
    return settled(docs.sparkSession, "dedup", lambda: _exact_dedup(docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")), digest))


def _exact_dedup(texts: DataFrame, digest: Column | None) -> DataFrame:
    spark = texts.sparkSession
    sha = F.unhex(F.sha2(F.col("norm"), 256))
    store = StreamingDedup(spark)
    store.add(texts.select("doc_id", (sha if digest is None else digest).alias("digest"), "norm"))
    content = store.landed()
    landed = content.drop("norm")
    total = landed.count()
    if not total:
        return spark.createDataFrame([], f"doc_id {dict(texts.dtypes)['doc_id']}, keep_id {dict(texts.dtypes)['doc_id']}, group_size bigint, kept boolean, text_sha256 string")
    groups = written(store.groups(), "groups")
    joined = join_counted(landed, groups, "digest", "group_size", total)

    # Hits: locators find their texts, and each meets a replica of the one that stays.
    hits = written(joined.filter("group_size > 1").select("locator", "digest", "holder", "group_size"), "hits")
    found = possible_members(content.select("locator", "norm"), F.col("locator"), hits, F.col("locator")).join(hits, "locator")
    found = written(found, "found")
    replicas = F.ceil(F.col("group_size") / COPIES_A_REPLICA).cast("int")
    holders = found.filter("locator = holder.locator").select("digest", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0), replicas - 1)).alias("replica"))
    copies = found.filter("locator <> holder.locator").withColumn("replica", F.pmod(F.xxhash64("locator"), replicas).cast("int"))
    differing = copies.join(holders, ["digest", "replica"]).filter(F.col("norm") != F.col("kept_norm")).select("digest").distinct()
    if written(differing, "split").isEmpty():
        shown = F.lower(F.hex("digest")) if digest is None else F.lit(None).cast("string")
        return joined.select("doc_id", F.col("holder.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("holder.locator")).alias("kept"), shown.alias("text_sha256"))
    # A digest with several texts: rows are grouped by their bytes instead.
    again = StreamingDedup(spark)
    again.add(content.select("doc_id", F.unhex(F.concat(F.hex(sha), F.hex(F.col("norm").cast("binary")))).alias("digest"), "norm"))
    exact = join_counted(again.landed().drop("norm"), written(again.groups(), "groups"), "digest", "group_size", total)
    return exact.select("doc_id", F.col("holder.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("holder.locator")).alias("kept"), F.lower(F.substring(F.hex("digest"), 1, 64)).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that exact_dedup keeps, with all their columns, whatever those are called."""
    ruled = exact_dedup(docs, id_col, text_col)
    # A null id is a key of its own.
    keys = ["no_id", "id", "sha"]
    key = lambda c, sha: (F.col(c).isNull().alias("no_id"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id"), sha.alias("sha"))
    keyed = docs.select(F.struct("*").alias("row"), *key(id_col, F.sha2(normalised(F.col(text_col)), 256)))
    rules = ruled.select(*key("doc_id", F.col("text_sha256")), "kept")
    kept, lost = rules.filter("kept").select(*keys), rules.filter("not kept").select(*keys)
    out = without(keyed, lost.join(kept, keys, "left_anti"), keys)
    if not lost.join(kept, keys, "left_semi").isEmpty():
        out = out.dropDuplicates(keys)  # rows repeated under one id
    return out.select("row.*")
