"""From raw documents to packed token windows, in five stages over whole tables.

Each stage gets all that its predecessor kept, as a table read back from Parquet,
and returns the columns of documents; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those far from every centroid, or without a letter, go."""
    from strandline.llm.langid import accepted, fit

    return accepted(docs, fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    from strandline.llm.exact_dedup import keep_first

    return keep_first(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, similarity 0.75) the document with the smallest id."""
    from strandline.llm.jaccard_join import keep_one

    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies (0 to 3) as bring the sources to their target weights."""
    from strandline.llm.mixing import apply_mix

    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    import public_tokenizers

    from strandline.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("jaccard_join", jaccard_join), ("mixing", mixing), ("packing", packing)]

#: Centroids, set similarity and differencing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
