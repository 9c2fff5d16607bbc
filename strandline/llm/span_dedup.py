"""Substring dedup by sliding sentence spans.

Sentences end at . ! ? or a newline. A sentence of more than LONG words is cut
after words whose hash says so: such cuts depend on the words alone, so a
passage that was set into the middle of a sentence is cut alike everywhere. At
every sentence begins a span: the shortest run of at least SENTENCES sentences
and WORDS words. Spans are hashed and joined over all documents; of equal spans
the first, by document id and position, stays, and the words that any other one
covers are removed.

Equal spans are told by 96 bits of hash: 64 that they are joined by and 32 of
another one. A mapper sends one occurrence of a hash for each of its flushes and rules out
the others at once, so a passage that stands in a third of all documents is no
large group anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, mark_members, written
from .shingles import Words
from .tokenise import groups as slices
from .tokenise import mix

SENTENCES, WORDS = 3, 20
#: Characters of text for each reducing task, which holds a bucket of their spans at a time.
TASK_CHARS = 1 << 26
#: Sentences of more words are cut after words whose hash is 0 modulo CUT.
LONG, CUT = 12, 4
#: Spans of a mapper's flush, and buckets of a reducing task.
FLUSH, BUCKETS = 1 << 20, 8

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: The same for the second hash.
BASE2 = 0xC2B2AE3D27D4EB4F
INVERSE2 = pow(BASE2, -1, 1 << 64)


def sentence_ends(words: Words) -> np.ndarray:
    """For each word whether a sentence, or a piece of a long one, ends after it; texts end sentences."""
    n = len(words.begins)
    end = np.isin(words.data[words.ends - 1], np.frombuffer(b".!?", np.uint8))
    lines = np.cumsum(words.data == 10)
    end[:-1] |= lines[words.begins[1:]] > lines[words.ends[:-1] - 1]
    last = np.cumsum(words.counts) - 1
    end[last[words.counts > 0]] = True
    at = np.flatnonzero(end)
    size = np.diff(np.append(-1, at))
    return end | (np.repeat(size > LONG, size) & (words.hashes % np.uint64(CUT) == 0)) if n else end


def rolling(hashes: np.ndarray, base: int, inverse: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of hashes times powers of the base up to each word, and the powers that bring a run's sum back to its start."""
    with np.errstate(over="ignore"):
        n = len(hashes)
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]))
        return np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[:-1])]), down


def spans(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: hash, second hash, first word and number of words of each span."""
    if not len(words.begins):
        for _ in words.counts:
            yield np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return
    ends = np.flatnonzero(sentence_ends(words)) + 1
    sums, down = rolling(words.hashes, BASE, INVERSE)
    sums2, down2 = rolling(words.hashes, BASE2, INVERSE2)
    upto = np.searchsorted(ends, np.cumsum(words.counts), "right")
    at = done = 0
    for count, k in zip(words.counts.tolist(), upto.tolist()):
        e = ends[done:k]  # of this text
        b = np.concatenate([[at], e[:-1]]) if len(e) else e
        j = np.maximum(np.arange(len(e)) + SENTENCES - 1, np.searchsorted(e, b + WORDS))
        fits = j < len(e)
        b, stop = b[fits], e[j[fits]]
        with np.errstate(over="ignore"):
            h = mix((sums[stop] - sums[b]) * down[b] + (stop - b).astype(np.uint64))
            c = mix((sums2[stop] - sums2[b]) * down2[b]) >> np.uint64(32)
        yield h, c.astype(np.uint32), b - at, stop - b
        at, done = at + count, k


def remove(text: str, first: list[int], length: list[int]) -> tuple[str, int]:
    """The text without the words of these spans and the white space after them, and how many words that were."""
    words = Words([text])
    n = len(words.begins)
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, np.array(first, int), 1)
    np.add.at(gone, np.minimum(np.array(first, int) + np.array(length, int), n), -1)
    gone = np.cumsum(gone[:n]) > 0
    stops = np.append(words.begins[1:], len(words.data) - 1)
    keep = np.ones(len(words.data), bool)
    keep[-1] = False
    edge = np.diff(np.concatenate([[False], gone, [False]]).astype(int))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        keep[words.begins[a] : stops[b - 1]] = False
    return words.data[keep].tobytes().decode("utf-8", "surrogatepass"), int(gone.sum())


def repeated(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """(doc_id, first, length): every span whose words stand earlier too. docs: doc_id bigint, text; no null ids."""
    spark = docs.sparkSession
    if tasks is None:
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))
    buckets = tasks * BUCKETS
    schema = "bucket long, later boolean, h binary, c binary, d binary, p binary, n binary"
    names = ["bucket", "later", "h", "c", "d", "p", "n"]

    def first_of(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The spans (h, c, d, p, n) by hashes, document and place, each once, and which are the first of their hashes."""
        order = np.lexsort(columns[3::-1])
        columns = [x[order] for x in columns]
        apart = [x[1:] != x[:-1] for x in columns[:4]]
        keep = np.append(True, apart[0] | apart[1] | apart[2] | apart[3])
        columns = [x[keep] for x in columns]
        return columns, np.append(True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def pack(columns: list[np.ndarray], later: bool) -> pa.RecordBatch:
            h = columns[0]
            b = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            b = b[order]
            begins = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            ends = np.append(begins[1:], len(b))
            out = [pa.array(b[begins], pa.int64()), pa.array(np.full(len(begins), later))]
            for x in columns:
                x = x[order]
                out.append(pa.array([x[i:j].tobytes() for i, j in zip(begins, ends)], pa.binary()))
            return pa.RecordBatch.from_arrays(out, names)

        def flush() -> Iterator[pa.RecordBatch]:
            columns, first = first_of(*(np.concatenate([x[i] for x in held]) for i in range(5)))
            yield pack([c[first] for c in columns], False)
            if not first.all():
                yield pack([c[~first] for c in columns], True)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for part in slices(texts):
                for i, (h, c, p, n) in zip(ids[part], spans(Words(texts[part]))):
                    if len(h):
                        held.append((h, c, np.full(len(h), i, np.int64), p.astype(np.int32), n.astype(np.int32)))
                        count += len(h)
                if count >= FLUSH:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.uint64, np.uint32, np.int64, np.int32, np.int32)
        now, rows = None, []

        def out(d: np.ndarray, p: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "first", "length"])

        def close() -> Iterator[pa.RecordBatch]:
            columns, first = first_of(*(np.frombuffer(b"".join(r[i] for r in rows), k) for i, k in enumerate(kinds)))
            if not first.all():
                yield out(*(c[~first] for c in columns[2:]))

        # Sorted by bucket, so one bucket is held at a time.
        for batch in batches:
            for b, later, *xs in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if later:
                    yield out(*(np.frombuffer(x, k) for x, k in zip(xs[2:], kinds[2:])))
                    continue
                if b != now:
                    if rows:
                        yield from close()
                    now, rows = b, []
                rows.append(xs)
        if rows:
            yield from close()

    sent = map_batches(docs.select("doc_id", "text"), send, schema)
    return map_batches(sent.repartition(tasks, "bucket").sortWithinPartitions("bucket"), join, "doc_id long, first int, length int")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, text (null counts as empty).

    Of equal spans the one in the smallest doc_id stays, within a document the
    earliest. Rows repeated under one id are one document. Rows without an id
    are neither compared nor changed. Ids of any ordered type; those that are no
    integers are numbered in their order. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not isinstance(kind, T.IntegralType):
        # Ranges in order, numbered within: numbers that rise with the ids, without a task that has all.
        ids = docs.select(F.col("doc_id").alias("id")).filter("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
        ids = written(ids.select("id", F.monotonically_increasing_id().alias("number")), "ids")
        numbered = docs.join(ids, F.col("doc_id") == F.col("id"), "left").select(F.col("number").alias("doc_id"), "text")
        return drop_repeats(numbered).join(ids, F.col("doc_id") == F.col("number"), "left").select(F.col("id").alias("doc_id"), "n_words", "n_removed", "text")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    gone = repeated(docs.filter("doc_id is not null"))
    gone = written(gone.groupBy("doc_id").agg(F.collect_list("first").alias("first"), F.collect_list("length").alias("length")), "gone")
    marked = mark_members(docs, F.col("doc_id"), gone, F.col("doc_id"))
    none = F.array().cast("array<int>")
    sure = marked.filter("not _maybe").select("doc_id", "text", none.alias("first"), none.alias("length"))
    maybe = marked.filter("_maybe").select("doc_id", "text").join(gone, "doc_id", "left").select("doc_id", "text", F.coalesce("first", none).alias("first"), F.coalesce("length", none).alias("length"))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                few = texts[part]
                counts = Words(few).counts
                got = [remove(x, a, b) if a else (x, 0) for x, a, b in zip(few, *(batch.column(i).slice(part.start, len(few)).to_pylist() for i in (2, 3)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(few)), pa.array(counts, pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.string())], out.names)

    return map_batches(sure.unionByName(maybe), run, out)
