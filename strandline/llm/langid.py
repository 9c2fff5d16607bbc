"""Language identification by the nearest of several centroids per language.

A text becomes a TF-IDF vector of its letters' n-grams (1 to 3, hashed), of unit
length. For each language, k-means with cosine distance puts several centroids
into the vectors of a bounded sample of labelled texts. A text gets the language
of its most similar centroid. It is rejected if that centroid is farther away
than anything seen in training at its length: thresholds come from windows of
doubling length cut from the training texts, as short texts are far from all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Shared, map_batches, written
from .tokenise import code_points, mix, worker_cache

DIM = 4096
CENTROIDS = 6
#: Labelled rows that the model is fitted on, at most: of each language, and of all.
SAMPLE_ROWS, SAMPLE_TOTAL = 400, 8000
#: Windows of a length that a threshold needs; with fewer, the next shorter length's holds.
LEAST_WINDOWS = 100
#: A text is rejected if its similarity is under this share of the lowest thousandth at its length.
LENIENCE = 0.6
UNKNOWN = "und"


def lowered(text: str) -> np.ndarray:
    """Lower-case letters as code points, each run of anything else as one 0."""

    def letters() -> np.ndarray:
        lower = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                lower[i] = ord(low) if len(low) == 1 else i
        return lower

    cp = worker_cache("lower", letters)[code_points(text)]
    keep = cp != 0
    keep[1:] |= cp[:-1] != 0
    return cp[keep]


def ngram_counts(cp: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Hashed counts of 1-, 2- and 3-grams that hold a letter."""
    padded = np.concatenate([[0], cp, [0]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        one = mix(padded + np.uint64(1))
        two = one[:-1] * np.uint64(31) + one[1:] * np.uint64(0x9E3779B97F4A7C15)
        three = two[:-1] * np.uint64(131) + one[2:]
        keep = padded > 0
        grams = np.concatenate([one[keep], mix(two)[keep[:-1] | keep[1:]], mix(three)[keep[1:-1]]])
    return np.bincount((grams & np.uint64(dim - 1)).astype(np.int64), minlength=dim).astype(np.float32)


class Model:
    """langs, idf, centroids (unit rows), owner (language of each centroid), floor by log2 of the letters."""

    def __init__(self, counts: list[np.ndarray], labels: list[str], centroids: int = CENTROIDS, seed: int = 5):
        self.langs = sorted(set(labels))
        df = np.sum([c > 0 for c in counts], axis=0)
        self.idf = (np.log((1 + len(counts)) / (1 + df)) + 0.2).astype(np.float32)
        x = np.stack([self.vector(c) for c in counts])
        y = np.array([self.langs.index(v) for v in labels])
        rng = np.random.default_rng(seed)
        rows, owner = [], []
        for k in range(len(self.langs)):
            got = self.cluster(x[y == k], centroids, rng)
            rows += list(got)
            owner += [k] * len(got)
        self.centroids, self.owner = np.stack(rows).astype(np.float32), np.array(owner)
        self.floor = np.zeros(64, np.float32)

    def windows(self, text: str) -> Iterator[tuple[int, float]]:
        """Of a training text: a window of each doubling length, and its similarity to the nearest centroid."""
        cp = lowered(text)
        rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
        length = 1
        while length <= len(cp):
            at = int(rng.integers(0, len(cp) - length + 1))
            piece = cp[at : at + length]
            if n := int((piece > 0).sum()):
                yield n.bit_length() - 1, float((self.centroids @ self.vector(ngram_counts(piece))).max())
            length *= 2

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        n = np.sqrt(v @ v)
        return v / n if n else v

    @staticmethod
    def cluster(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
        centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            own = (x @ centre.T).argmax(axis=1)
            sums = [x[own == i].sum(axis=0) for i in range(len(centre)) if (own == i).any()]
            centre = np.stack([s / max(np.linalg.norm(s), 1e-9) for s in sums])
        return centre

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine similarity (0 to 1), whether it is rejected."""
        if not text:
            return UNKNOWN, 0.0, True
        cp = lowered(text)
        n = int((cp > 0).sum())
        if not n:
            return UNKNOWN, 0.0, True
        near = self.centroids @ self.vector(ngram_counts(cp))
        best = int(near.argmax())
        score = float(min(max(near[best], 0.0), 1.0))
        return self.langs[self.owner[best]], score, score < float(self.floor[n.bit_length() - 1])


def held_out(id_col: Column) -> Column:
    """Rows that a fit must not see."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_total: int = SAMPLE_TOTAL) -> Model | None:
    """Fitted on whole texts of at most sample_rows rows of each language, picked by a hash of the id; None without any.

    Only rows with a letter, a language and an id that isn't held out are used.
    Languages beyond sample_total are left out, the rarest first.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}") & ~held_out(F.col("i")))
    counted = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(sample_total).collect()
    if not counted:
        return None
    each = max(1, min(sample_rows, sample_total // len(counted)))
    # About twice as many by hash, then the first of those.
    shares = docs.sparkSession.createDataFrame([(r.l, min(1 << 30, math.ceil((1 << 30) * (2.0 * each + 20) / r.n))) for r in counted], "l string, below long")
    few = rows.withColumn("h", F.pmod(F.xxhash64(F.lit(3), "i"), F.lit(1 << 30))).join(F.broadcast(shares), "l").filter("h < below")
    sample = written(few.withColumn("k", F.row_number().over(W.partitionBy("l").orderBy("h", "i", "t"))).filter(F.col("k") <= each).select("i", "l", "t"), "langid")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ngram_counts(lowered(x)).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["l", "c"])

    got = sorted(map_batches(sample.select("l", "t"), count, "l string, c binary").collect())
    model = Model([np.frombuffer(r.c, np.float32) for r in got], [r.l for r in got])
    shared = Shared(docs.sparkSession, model)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [p for x in b.column(0).to_pylist() for p in shared.value.windows(x)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.float64())], ["b", "near"])

    low = map_batches(sample.select("t"), near, "b int, near double").groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.percentile("near", F.lit(0.001)).alias("low")).collect()
    low = {r.b: r.low for r in low if r.n >= LEAST_WINDOWS}
    for b in range(64):
        model.floor[b] = LENIENCE * low[b] if b in low else (model.floor[b - 1] if b else 0)
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected; whole texts are read.

    A null text, one without a letter, or any text without a model is `und`,
    score 0 and rejected. Equal texts get equal answers.
    """
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.predict(x) if m else (UNKNOWN, 0.0, True) for x in batch.column(2).to_pylist()]
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], out.names)

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text")), run, out)


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents that identify doesn't reject, with all their columns."""
    shared = Shared(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([bool(m) and not m.predict(x)[2] for x in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)
