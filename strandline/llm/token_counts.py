"""Token counts by field or section, from one encoding of the whole document.

A document is encoded once. Every token covers bytes of its text, and sections
are ranges of characters; both lie in order, so each token finds its sections by
a sorted search. A token that crosses a boundary goes to the section that holds
most of its bytes, the earlier one on a tie, so counts add up to the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches
from .tokenise import groups, tokeniser, worker_cache


def token_bytes(path: str) -> np.ndarray:
    """Bytes of each id's token; byte-level vocabularies spell a byte as one character, added tokens stand as they are."""

    def make() -> np.ndarray:
        lib = tokeniser(path).lib
        words, added = lib.get_vocab(with_added_tokens=False), lib.get_added_tokens_decoder()
        out = np.zeros(max([*words.values(), *added]) + 1, np.int64)
        for w, i in words.items():
            out[i] = len(w)
        for i, token in added.items():
            out[i] = len(token.content.encode())
        return out

    return worker_cache(("bytes", path), make)


def line_starts(text: str) -> np.ndarray:
    """Sections that follow one another: each line with the newline that ends it; at least one."""
    at, out = text.find("\n"), [0]
    while 0 <= at < len(text) - 1:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(out, np.int64)


def allot(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token, by its end in bytes (its start is the end before it): its section or -1, and whether it crosses.

    Sections are [starts, stops) in bytes, in order and apart; bytes may lie in none.
    """
    begins = np.append(0, ends[:-1])
    first = np.searchsorted(stops, begins, "right")  # the first section that ends after the token's begin
    last = np.searchsorted(starts, ends, "left") - 1  # the last that starts before its end
    out = np.where(last >= first, first, -1)
    crossing = last > first
    if len(starts):
        clipped = np.clip(first, 0, len(starts) - 1)
        crossing |= (out >= 0) & ((begins < starts[clipped]) | (ends > stops[clipped]))
    for i in np.flatnonzero(last > first):
        k = np.arange(first[i], last[i] + 1)
        share = np.minimum(stops[k], ends[i]) - np.maximum(starts[k], begins[i])
        out[i] = k[int(share.argmax())]
    return out, crossing


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """A row for each section: doc_id, section, start, end (characters), n_tokens, n_crossing, doc_tokens.

    sections_col: an array of (start, end) ranges, in order and apart; by default
    the lines. n_crossing counts the section's tokens that reach out of it. Null
    and empty texts have one section without tokens; an array that is null or
    empty gives no row. Repeated rows give their rows each.
    """
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("section", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "end", "n_tokens", "n_crossing", "doc_tokens")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = tokeniser(vocabulary), token_bytes(vocabulary)
        for batch in batches:
            ids_col, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            given = batch.column(2).to_pylist() if sections_col else None
            for part in groups(texts):
                ids, counts = coder.encode(texts[part])
                span = sizes[ids]
                rows, begin = [], 0
                for i, n in zip(range(part.start, part.stop), counts.tolist()):
                    ends = np.cumsum(span[begin : begin + n])
                    begin += n
                    text = texts[i]
                    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    if given is None:
                        starts = line_starts(text)
                        stops = np.append(starts[1:], len(text))
                    else:
                        pairs = given[i] or []
                        starts, stops = (np.clip(np.array([p[k] for p in pairs], np.int64), 0, len(text)) for k in ("start", "end"))
                    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte at which each character begins
                    section, crossing = allot(ends, at[starts], at[stops])
                    held = section >= 0
                    rows.append((i, starts, stops, np.bincount(section[held], minlength=len(starts)), np.bincount(section[held & crossing], minlength=len(starts)), n))
                if not rows:
                    continue
                each = [len(r[1]) for r in rows]
                columns = [ids_col.take(pa.array(np.repeat([r[0] for r in rows], each))), pa.array(np.concatenate([np.arange(k) for k in each]), pa.int32())]
                columns += [pa.array(np.concatenate([r[j] for r in rows]), pa.int64()) for j in (1, 2, 3, 4)]
                columns.append(pa.array(np.repeat([r[5] for r in rows], each), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, out.names)

    picked = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    if sections_col:
        picked.append(F.col(sections_col).cast("array<struct<start: bigint, end: bigint>>").alias("sections"))
    return map_batches(docs.select(picked), run, out)
