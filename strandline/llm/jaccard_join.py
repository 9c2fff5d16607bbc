"""N-gram Jaccard self-join by grouped prefixes, and the components of its links.

A document is the set of its word shingles. In one order of all shingles, two
sets that reach the similarity share a shingle among their first ones (their
prefixes), so only documents that meet there are candidates:

1. Texts are read once: sets are written as packed hashes. Equal sets become one
   node, named by its first row; nodes with identical prefixes and size become
   one group, and groups alone are listed under their prefix's shingles.
2. Shingles are ordered by hash. Where more groups meet at a shingle than CROWD,
   it is crowded. Documents with a crowded shingle in their prefix are listed a
   second time, in an order that has last what is crowded or frequent among them.
   Where more than CROWD meet even then, they form a crowd.
3. Group pairs are filtered by size, expanded to their members, and filtered by
   a bitmap of each set's parities, a lower bound on the difference.
4. Verification is exact, on the sets themselves. First each node meets its
   smallest candidate, and each member of a crowd the crowd's representative.
   What these links join needs no more comparing: of the other candidate pairs,
   and of the crowds, only what lies across components is verified, crowds in
   blocks of bounded size. No crowd's pairs are ever listed.

No link between components is lost: every step before verification drops only
pairs that can't reach the similarity. Shingles are compared by 64-bit hashes,
sets told apart by 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, collected_bits, join_counted, map_batches, possible_members, settled, without, written
from .components import components
from .shingles import SIZE, shingle_sets
from .tokenise import groups as slices

#: More groups than this at one shingle are a crowd.
CROWD = 32
#: Bits that mark crowded shingles, 64 for each up to 8 MB. Beyond that marks are shared, and the order is less apt, not wrong.
MARK_BITS = 1 << 26
#: Postings of a mapper's flush, and of a reducing task on average; buckets a reducing task; pairs made at once.
FLUSH, TASK_POSTINGS, BUCKETS, PAIRS = 1 << 18, 1 << 21, 8, 1 << 18
#: Bytes of a shingle's key and of a group in a posting.
KEY, GROUP = 5, 6
#: Sets of a crowd's block, and the bytes of its shingles on average.
BLOCK, BLOCK_BYTES = 256, 1 << 22
#: Sets that one replica of a representative is compared with.
SPOKES = 256
#: Similarity as a fraction: 75 / 100.
NUM, DEN = 3, 4


def prefix_length(n: int) -> int:
    """Of a set of n: the links of a set share more than n - this many of its shingles."""
    return n - -(-NUM * n // DEN) + 1


def keys(shingles: np.ndarray) -> np.ndarray:
    """The upper 40 bits: where documents meet. A chance meeting makes a candidate more, no link."""
    return shingles >> np.uint64(24)


def narrow(values: np.ndarray, width: int) -> np.ndarray:
    """Unsigned numbers as rows of their lowest bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def widen(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


#: Sizes travel as 16-bit logarithms; a step of 1 more than the similarity allows covers their rounding.
SIZE_STEPS = 1024
SIZE_REACH = int(np.ceil(np.log2(DEN / NUM) * SIZE_STEPS)) + 1


def size_code(n: int) -> int:
    return min(65535, int(np.log2(n) * SIZE_STEPS))


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


class Marks:
    """A set of shingle keys as a bitmap of fixed size: it may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = bits

    def has(self, shingles: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.zeros(len(shingles), bool)
        slot = (keys(shingles) & np.uint64(8 * len(self.bits) - 1)).astype(np.int64)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


NONE = Marks()


def marks(shingles: DataFrame, bits: int = MARK_BITS) -> Marks:
    """Of a column `shingle` of keys."""
    bits = min(bits, max(1 << 15, 1 << (64 * shingles.count()).bit_length()))
    return Marks(collected_bits(shingles.select((F.col("shingle").bitwiseAND(bits - 1)).alias("slot")), bits))


def prefix(shingles: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in the order, by hash: those not put last, and those that are."""
    p = prefix_length(len(shingles))
    if last is None:
        return shingles[:p], shingles[:0]
    free = shingles[~last][:p]
    return free, shingles[last][: p - len(free)]


def digest(shingles: np.ndarray, salt: int) -> bytes:
    """128 bits of a set given in order."""
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16, key=salt.to_bytes(2, "little")).digest()


def short(of: bytes) -> int:
    """48 bits of a digest; groups or nodes that share them become candidates too."""
    return int.from_bytes(of[:GROUP], "little")


def parities(shingles: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of a power of two bits, each the parity of its shingles."""
    odd = np.bincount(((shingles >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities in at least four bits a shingle."""
    return parities(shingles, max(64, 1 << (4 * len(shingles) - 1).bit_length())).tobytes()


def fold(bits: bytes, size: int) -> np.ndarray:
    """The bitmap at a smaller size, as 64-bit words: slots are taken modulo the size."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def difference_fits(difference, a, b):
    """Whether sets of sizes a and b with so many elements in one alone reach the similarity."""
    return DEN * (a + b - difference) >= NUM * (a + b + difference)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, given in order, reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    if DEN * len(a) < NUM * len(b):
        return False
    common = int(in_sorted(a, b).sum())
    return DEN * common >= NUM * (len(a) + len(b) - common)


def describe(docs: DataFrame, size: int) -> DataFrame:
    """row, doc_id, n, digest (of the set), key (its 48 bits), gid (48 bits of prefix and size), bitmap, shingles; n 0 and nulls for an empty set."""
    kinds = {"n": (T.LongType(), pa.int64()), "digest": (T.BinaryType(), pa.binary()), "key": (T.LongType(), pa.int64()), "gid": (T.LongType(), pa.int64()), "bitmap": (T.BinaryType(), pa.binary()), "shingles": (T.BinaryType(), pa.binary())}
    out = T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], *[T.StructField(c, t) for c, (t, _) in kinds.items()]])

    def one(s: np.ndarray) -> tuple:
        n = len(s)
        if not n:
            return 0, None, None, None, None, None
        own = digest(s, 1)
        return n, own, short(own), short(digest(np.append(prefix(s)[0], np.uint64(n)), 2)), bitmap(s), s.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            for part in slices(texts):
                rows = [one(s) for s in shingle_sets(texts[part], size)]
                same = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([same.column(0), same.column(1), *[pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds.values())]], out.names)

    return map_batches(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), run, out)


#: Kinds of a mapper's rows: postings, crowded shingles (t), members of crowds (t, g).
LISTED, HOT, LAST = 0, 1, 2


def packed(kind: int, bucket: np.ndarray, columns: list[np.ndarray | None]) -> pa.RecordBatch:
    """A row for each bucket with its part of every column (t, g, s) as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    ends = np.append(begins[1:], len(bucket))
    out = [pa.array(bucket[begins], pa.int64()), pa.array(np.full(len(begins), kind), pa.int32())]
    for x in columns:
        if x is None:
            out.append(pa.nulls(len(begins), pa.binary()))
            continue
        x = x[order]
        out.append(pa.array([x[i:j].tobytes() for i, j in zip(begins.tolist(), ends.tolist())], pa.binary()))
    return pa.RecordBatch.from_arrays(out, ["bucket", "kind", "t", "g", "s"])


def postings(sets: DataFrame, buckets: int, crowd: int, asked: Marks = NONE, last: Marks = NONE) -> DataFrame:
    """bucket, kind, and as packed arrays: shingle t, group g, size s of the prefixes.

    First listing: groups share prefix and size. Second one: nodes stand for
    themselves, and only those take part whose first prefix holds a shingle of
    asked. A shingle that a flush alone has often enough is reported, not listed.
    Sets of less than three link only with equal ones.
    """
    shared = Shared(sets.sparkSession, (asked, last))
    often = max(2, crowd // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, last = shared.value
        again = asked.bits is not None
        held: list[tuple] = []
        ends: list[tuple] = []
        seen: set[int] = set()
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = np.concatenate([h[0] for h in held])
                n = np.array([len(h[0]) for h in held])
                g, s = np.repeat(np.array([h[1] for h in held], np.uint64), n), np.repeat(np.array([h[2] for h in held], np.uint16), n)
                if not again:
                    found, k = np.unique(t, return_counts=True)
                    hot = found[k > often]
                    if len(hot):
                        yield packed(HOT, (hot % np.uint64(buckets)).astype(np.int64), [narrow(hot, KEY), None, None])
                        rest = ~in_sorted(t, hot)
                        t, g, s = t[rest], g[rest], s[rest]
                yield packed(LISTED, (t % np.uint64(buckets)).astype(np.int64), [narrow(t, KEY), narrow(g, GROUP), s])
            if ends:
                t, n = np.concatenate([h[0] for h in ends]), np.array([len(h[0]) for h in ends])
                g = np.repeat(np.array([h[1] for h in ends], np.uint64), n)
                # Members are only passed on, so they are spread by node, not by shingle.
                yield packed(LAST, (g % np.uint64(buckets)).astype(np.int64), [narrow(t, KEY), narrow(g, GROUP), None])

        for batch in batches:
            for key, gid, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = np.frombuffer(data, np.uint64)
                if again:
                    if key in seen or not asked.has(prefix(x)[0]).any():
                        continue
                    gid = key
                    free, crowded = prefix(x, last.has(x))
                else:
                    if gid in seen:
                        continue
                    free, crowded = prefix(x)
                seen.add(gid)
                if len(free):
                    held.append((keys(free), gid, size_code(len(x))))
                if len(crowded):
                    ends.append((keys(crowded), gid))
                count += len(free) + len(crowded)
                if count >= FLUSH:
                    yield from flush()
                    held, ends, count = [], [], 0
                    seen.clear()
        yield from flush()

    return map_batches(sets.filter(F.col("n") >= DEN - 1).select("key", "gid", "shingles"), run, "bucket long, kind int, t binary, g binary, s binary")


def whole_counts(sets: DataFrame, buckets: int, asked: Marks) -> DataFrame:
    """bucket, and packed: shingles t of the whole sets that take part in the second listing; a flush's repeated ones u once, with their counts c."""
    shared = Shared(sets.sparkSession, asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        held: list[np.ndarray] = []
        seen: set[int] = set()
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t, n = np.unique(np.concatenate(held), return_counts=True)
                for kind, some in ((LISTED, n == 1), (HOT, n > 1)):
                    x = t[some]
                    yield packed(kind, (x % np.uint64(buckets)).astype(np.int64), [narrow(x, KEY), n[some].astype("<u4") if kind == HOT else None, None])

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(data, np.uint64)
                if key not in seen and asked.has(prefix(x)[0]).any():
                    seen.add(key)
                    held.append(keys(x))
                    count += len(x)
                    if count >= FLUSH:
                        yield from flush()
                        held, count = [], 0
                        seen.clear()
        yield from flush()

    return map_batches(sets.filter(F.col("n") >= DEN - 1).select("key", "shingles"), run, "bucket long, kind int, t binary, g binary, s binary")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (kind, t, g, s) of one bucket after the other, from batches sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for b, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if b != now:
                if rows:
                    yield now, rows
                now, rows = b, []
            rows.append(tuple(row))
    if rows:
        yield now, rows


def dealt(listed: DataFrame, tasks: int) -> DataFrame:
    return listed.repartition(tasks, "bucket").sortWithinPartitions("bucket")


def frequent(listed: DataFrame, tasks: int, least: int) -> DataFrame:
    """(shingle) of the shingles that are counted more than `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            once = widen(b"".join(r[1] for r in rows if r[0] == LISTED), KEY)
            often = widen(b"".join(r[1] for r in rows if r[0] == HOT), KEY)
            n = np.concatenate([np.ones(len(once), np.int64), np.frombuffer(b"".join(r[2] for r in rows if r[0] == HOT), "<u4").astype(np.int64)])
            t, at = np.unique(np.concatenate([once, often]), return_inverse=True)
            t = t[np.bincount(at, n, len(t)) > least]
            if len(t):
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64), pa.int64())], ["shingle"])

    return map_batches(dealt(listed, tasks), run, "shingle long")


#: What meets at shingles: PAIR (a, b: groups), CROWDED (a: shingle), MEMBER (a: shingle, b: group).
PAIR, CROWDED, MEMBER = 0, 1, 2
#: Shingles and groups as names of crowds: moved apart from each other.
MEETING = 1 << 48


def meetings(listed: DataFrame, tasks: int, crowd: int, second: bool) -> DataFrame:
    """kind, a, b. What the second listing's shingles have more than crowd of is a crowd, like what was put last."""

    def rows_of(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())], ["kind", "a", "b"])

    def pairs(t_begins: np.ndarray, m: np.ndarray, g: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in np.unique(m).tolist():
            i, j = np.triu_indices(k, 1)
            begins = t_begins[m == k]
            step = max(1, PAIRS // len(i))
            for at in range(0, len(begins), step):
                members = begins[at : at + step, None] + np.arange(k)
                a, b = members[:, i].ravel(), members[:, j].ravel()
                fit = np.abs(s[a] - s[b]) <= SIZE_REACH
                a, b = g[a[fit]], g[b[fit]]
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
                yield rows_of(PAIR, a[fresh], b[fresh])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            for kind, t, g, _ in rows:
                if kind == HOT:
                    t = widen(t, KEY)
                    yield rows_of(CROWDED, t, t)
                elif kind == LAST:
                    yield rows_of(MEMBER, widen(t, KEY), widen(g, GROUP))
            rows = [r for r in rows if r[0] == LISTED]
            t, g = widen(b"".join(r[1] for r in rows), KEY), widen(b"".join(r[2] for r in rows), GROUP)
            s = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).astype(np.int32)
            if not len(t):
                continue
            order = np.lexsort((s, g, t))
            t, g, s = t[order], g[order], s[order]
            keep = np.append(True, (t[1:] != t[:-1]) | (g[1:] != g[:-1]) | (s[1:] != s[:-1]))
            t, g, s = t[keep], g[keep], s[keep]
            begins = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            m = np.diff(np.append(begins, len(t)))
            few = (m >= 2) & (m <= crowd)
            yield from pairs(begins[few], m[few], g, s)
            many = np.repeat(m > crowd, m)
            if second:
                yield rows_of(MEMBER, t[many], g[many])
            else:
                yield rows_of(CROWDED, t[begins[m > crowd]], t[begins[m > crowd]])

    return map_batches(dealt(listed, tasks), run, "kind int, a long, b long")


def alike(pairs: DataFrame) -> DataFrame:
    """Of node pairs with sizes and bitmaps (a, na, ma, b, nb, mb): those whose bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(5).to_pylist())):
                size = min(len(x), len(y))
                keep[i] = difference_fits(int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()), int(na[i]), int(nb[i]))
            some = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(3)], ["a", "b"])

    return map_batches(pairs.select("a", "na", "ma", "b", "nb", "mb"), run, "a long, b long")


def with_sets(units: DataFrame, sets: DataFrame) -> DataFrame:
    """units with the shingles of their node; sets that no unit has are left out before the shuffle."""
    needed = possible_members(sets.select("row", "shingles"), F.col("row"), units, F.col("node"))
    return units.join(needed, units["node"] == needed["row"]).drop("row")


def star_links(stars: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """Of pairs (hub, spoke) those that reach the similarity, as (a, b). A hub's set travels once for SPOKES of its spokes."""
    sized = stars.groupBy("hub").agg(F.count(F.lit(1)).alias("k"))
    total = stars.count()
    replica = F.pmod(F.xxhash64("spoke"), F.ceil(F.col("k") / SPOKES)).cast("int")
    dealt_out = join_counted(stars, sized, "hub", "k", total).select("hub", "spoke", replica.alias("replica"))
    hubs = dealt_out.select("hub", "replica").distinct().select("hub", "replica", F.lit(0).alias("side"), F.col("hub").alias("node"))
    units = written(hubs.unionByName(dealt_out.select("hub", "replica", F.lit(1).alias("side"), F.col("spoke").alias("node"))), "stars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = None
        for batch in batches:
            got = []
            for hub, side, node, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                s = np.frombuffer(data, np.uint64)
                if side == 0:
                    center = s
                elif linked(center, s):
                    got.append((hub, node))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())], ["a", "b"])

    laid = with_sets(units, sets).repartition(tasks, "hub", "replica").sortWithinPartitions("hub", "replica", "side")
    return map_batches(laid.select("hub", "side", "node", "shingles"), run, "a long, b long")


def forest(ids: list[int], sets: list[np.ndarray], sides: list[int], labels: list[int]) -> list[tuple[int, int]]:
    """Links that, with what the labels join, span the components of the sets' links; sets in rising size.

    With two sides, only links between them are looked for.
    """
    n = np.array([len(s) for s in sets])
    bits = max(64, 1 << int(2 * n.max() - 1).bit_length())
    maps = np.stack([parities(s, bits).view(np.uint64) for s in sets])
    side, root = np.array(sides), np.unique(labels, return_inverse=True)[1]
    split = len(set(sides)) > 1
    links = []
    for i in range(1, len(sets)):
        first = int(np.searchsorted(n, -(-NUM * n[i] // DEN)))
        apart = root[first:i] != root[i]
        if split:
            apart &= side[first:i] != side[i]
        other = first + np.flatnonzero(apart)
        if not len(other):
            continue
        gap = np.bitwise_count(maps[other] ^ maps[i]).sum(axis=1, dtype=np.int64)
        fits = difference_fits(gap, n[other], n[i])
        other, gap = other[fits], gap[fits]
        for j in other[np.argsort(gap, kind="stable")].tolist():
            if root[j] != root[i] and linked(sets[j], sets[i]):
                links.append((ids[i], ids[j]))
                root[root == root[i]] = root[j]
    return links


#: Of a crowd's blocks; sets of sizes whose classes differ by more than one don't link.
SIZE_CLASS = 1.34


def crowd_links(crowds: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, tasks: int) -> DataFrame | None:
    """Links (a, b) across the labels' components within crowds (hub, node); None if no crowd has two components.

    A crowd's largest component isn't compared with itself. Blocks are of one size
    class, bounded in number and bytes, and compared in pairs of adjacent classes.
    """
    labelled = crowds.join(labels.select(F.col("v").alias("node"), "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    labelled = labelled.join(nodes.select("node", "n"), "node").withColumn("class", F.floor(F.log("n") / float(np.log(SIZE_CLASS))).cast("int"))
    labelled = written(labelled, "crowds")
    parts = labelled.groupBy("hub", "c").agg(F.count(F.lit(1)).alias("k"))
    mixed = parts.groupBy("hub").agg(F.count(F.lit(1)).alias("parts"), F.max_by("c", "k").alias("main"), F.sum("k").alias("m")).filter("parts > 1")
    mixed = written(mixed, "mixed")
    if mixed.isEmpty():
        return None
    at = join_counted(labelled, mixed, "hub", "m", labelled.count()).withColumn("is_main", F.col("c") == F.col("main"))
    shape = ["hub", "is_main", "class"]
    counts = at.groupBy(*shape).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles"))
    counts = counts.withColumn("blocks", F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("int"))
    blocks = counts.select(*shape, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    members = join_counted(at, counts, shape, "k", labelled.count()).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    x = blocks.select("hub", *[F.col(c).alias(f"x_{c}") for c in ("is_main", "class", "block")])
    y = blocks.select("hub", *[F.col(c).alias(f"y_{c}") for c in ("is_main", "class", "block")])
    rank = lambda p: F.struct(f"{p}_is_main", f"{p}_class", f"{p}_block")
    # A block of others with itself and each later block; the main component's blocks with those of others alone.
    met = x.join(y, "hub").filter((~F.col("x_is_main")) & (F.abs(F.col("x_class") - F.col("y_class")) <= 1) & (rank("x") <= rank("y")))
    met = met.withColumn("unit", F.xxhash64("hub", *met.columns[1:]))
    ends = ["is_main", "class", "block"]
    one = met.select("hub", *[F.col(f"x_{c}").alias(c) for c in ends], "unit", F.lit(0).alias("side"))
    two = met.filter(rank("x") != rank("y")).select("hub", *[F.col(f"y_{c}").alias(c) for c in ends], "unit", F.lit(1).alias("side"))
    units = written(one.unionByName(two).join(members.select("hub", *ends, "node", "c"), ["hub", *ends]).select("unit", "hub", "side", "node", "c"), "units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def close() -> pa.RecordBatch:
            rows.sort(key=lambda r: (len(r[3]), r[1]))
            got = forest([r[1] for r in rows], [np.frombuffer(r[3], np.uint64) for r in rows], [r[0] for r in rows], [r[2] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())], ["a", "b"])

        for batch in batches:
            for unit, hub, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (unit, hub) != now:
                    if len(rows) > 1:
                        yield close()
                    now, rows = (unit, hub), []
                rows.append(tuple(row))
        if len(rows) > 1:
            yield close()

    laid = with_sets(units, sets).repartition(tasks, "unit").sortWithinPartitions("unit", "hub")
    return map_batches(laid.select("unit", "hub", "side", "node", "c", "shingles"), run, "a long, b long")


def candidate_pairs(met: list[DataFrame], nodes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of nodes, a < b, whose bitmaps allow the similarity; crowds (token, node)) of the listings."""
    sized = written(nodes.groupBy("gid").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("one")), "groups")
    several = nodes.select("gid", "node").join(sized.filter("k > 1").select("gid"), "gid")
    crowds = several.select((F.col("gid") + 2 * MEETING).alias("token"), "node")
    first = met[0].filter(f"kind = {PAIR}").select("a", "b").distinct()
    for side in ("a", "b"):
        first = first.join(sized.select(F.col("gid").alias(side), F.col("k").alias(f"k_{side}"), F.col("one").alias(f"one_{side}")), side)
    pairs = first.filter("k_a = 1 and k_b = 1").select(F.col("one_a").alias("x"), F.col("one_b").alias("y"))
    # A group of several members is a crowd, joined by the members of the smaller groups that meet it.
    more = first.filter("k_a > 1 or k_b > 1")
    larger = F.col("k_a") >= F.col("k_b")
    more = more.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("to"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("gid"))
    crowds = crowds.unionByName(more.join(nodes.select("gid", "node"), "gid").select((F.col("to") + 2 * MEETING).alias("token"), "node"))
    for second in met[1:]:
        named = second.filter(f"kind = {PAIR}").select("a", "b").distinct()
        for side, name in (("a", "x"), ("b", "y")):
            named = named.join(nodes.select(F.col("key").alias(side), F.col("node").alias(name)), side)
        pairs = pairs.unionByName(named.select("x", "y"))
        members = second.filter(f"kind = {MEMBER}").select((F.col("a") + MEETING).alias("token"), F.col("b").alias("key"))
        crowds = crowds.unionByName(members.join(nodes.select("key", "node"), "key").select("token", "node"))
    pairs = pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("row").alias(side), F.col("n").alias(f"n{side}"), F.col("bitmap").alias(f"m{side}")), side)
    return written(alike(pairs), "pairs", few=True), crowds


def hubs_of(crowds: DataFrame) -> DataFrame:
    """(hub, node) of crowds (token, node): the hub is the token's representative, so tokens with much the same members are one crowd."""
    listed = written(crowds.distinct(), "tokens")
    found = listed.groupBy("token").agg(F.min_by("node", F.xxhash64("node")).alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return written(join_counted(listed, found, "token", "k", listed.count()).select("hub", "node").distinct(), "hubs")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach, null ids last. Equal
    sets link (similarity 1), so rows repeated under one id do too. Documents
    without words, null texts among them, have n_shingles 0 and link with
    nothing: component_id is their own id. An empty table gives no rows; further
    columns are ignored. Very long texts are sets like others.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return settled(docs.sparkSession, "near", lambda: _near_duplicates(docs, size, crowd))


def _near_duplicates(docs: DataFrame, size: int, crowd: int) -> DataFrame:
    spark = docs.sparkSession
    sets = written(describe(docs, size), "sets", plain=True)
    nodes = sets.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("leader"), F.min("n").alias("n"), F.min("gid").alias("gid"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "nodes")
    totals = nodes.agg(F.sum("n").alias("shingles"), F.sum("copies").alias("docs")).first()
    alone = sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if not totals.docs:
        return alone

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-totals.shingles // 4 // TASK_POSTINGS))
    buckets = tasks * BUCKETS
    met = [written(meetings(postings(sets, buckets, crowd), tasks, crowd, False), "meetings", few=True)]
    hot = met[0].filter(f"kind = {CROWDED}").select(F.col("a").alias("shingle"))
    if not hot.isEmpty():
        asked = marks(hot)
        more = frequent(whole_counts(sets, buckets, asked), tasks, crowd)
        last = marks(written(hot.unionByName(more), "last", few=True))
        met.append(written(meetings(postings(sets, buckets, crowd, asked, last), tasks, crowd, True), "meetings", few=True))
    pairs, crowds = candidate_pairs(met, nodes, sets)
    hubs = hubs_of(crowds)

    # First each node with its smallest candidate, and each member of a crowd with its hub.
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.least("a", "b").alias("hub"), F.greatest("a", "b").alias("spoke"))
    stars = near.unionByName(hubs.filter("hub <> node").select("hub", F.col("node").alias("spoke"))).distinct()
    links = written(star_links(written(stars, "near"), sets, tasks), "links", few=True)
    found = components(links)

    # Then what is left between components.
    apart = pairs
    for side in ("a", "b"):
        apart = apart.join(found.select(F.col("v").alias(side), F.col("c").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    rest = written(apart.filter("ca <> cb").select(F.col("a").alias("hub"), F.col("b").alias("spoke")), "apart")
    across = [] if rest.isEmpty() else [star_links(rest, sets, tasks)]
    inside = crowd_links(hubs, found, nodes, sets, tasks)
    across += [] if inside is None else [inside]
    fresh = None
    for x in across:
        fresh = x if fresh is None else fresh.unionByName(x)
    if fresh is not None:
        fresh = written(fresh, "links", few=True)
        if not fresh.isEmpty():
            found = components(links.unionByName(fresh))

    same = nodes.join(found.select(F.col("v").alias("node"), "c"), "node", "left").select("digest", "leader", "copies", F.coalesce("c", "node").alias("c"))
    smallest = same.groupBy("c").agg(F.min("leader").alias("component_id"))
    labelled = written(same.join(smallest, "c").select("digest", "copies", "component_id"), "labels")
    full = join_counted(sets.filter("n > 0").select("doc_id", "n", "digest"), labelled, "digest", "copies", totals.docs)
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the documents under its smallest id, with all their columns; rows without an id stay."""
    ruled = near_duplicates(docs, id_col, text_col)
    dropped = written(ruled.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")), "dropped")
    return without(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id")), dropped, ["id"]).select("row.*")
