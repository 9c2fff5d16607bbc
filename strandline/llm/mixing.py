"""Mixing sources to target weights by entropy balancing.

Documents get rates that stay as near as possible to one copy each, in relative
entropy, while every source's tokens come to its target and no rate exceeds a
cap. The convex dual has one multiplier a source; the rate of a document of size
n in source s is min(cap, exp(lambda_s * n)). Newton iterations solve the dual:
each is one distributed aggregation over the table of distinct (source, size)
pairs with their counts, which holds all that the dual needs, and only the sums
by source reach the driver.

Rates are then rounded into copies. All documents of one source and size share a
rate, so a source's sizes are walked from the largest to the smallest, each
getting the whole number of copies that keeps the running total nearest the
running target; within a size, documents get the copies by a hash of their id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_counted, written

#: The driver holds a few numbers for each of so many sources, with names of so many bytes in all; beyond that they stay in tables.
MAX_SOURCES, MAX_NAMES = 10_000, 4_000_000
#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of one source and size are ranked in buckets of about so many.
BUCKET = 500


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def water_fill(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of the whole by weight, none above cap times its size; the excess goes to the others by weight."""
    targets, open_, rest = [0.0] * len(sizes), [i for i, s in enumerate(sizes)], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = rest * weights[i] / total
            break
        for i in over:
            targets[i] = cap * sizes[i]
        rest -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def solve(classes: DataFrame, targets: dict[int, float], totals: dict[int, int], cap: float, steps: int = 60, near: float = 1e-6) -> dict[int, float]:
    """lambda by source number: Newton steps on all sources at once, kept within a shrinking bracket."""
    spark = classes.sparkSession
    top = math.log(cap)
    state = {}
    for s, t in targets.items():
        if totals[s] > 0:
            if t >= cap * totals[s] * (1 - 1e-12):
                state[s] = [top, top, top]  # every document of size 1 or more reaches the cap
            else:
                state[s] = [0.0, -60.0, top]
    todo = {s for s, (x, lo, hi) in state.items() if lo < hi}
    schema = "s long, x double"
    for _ in range(steps):
        if not todo:
            break
        now = spark.createDataFrame([(s, state[s][0]) for s in sorted(todo)], schema)
        rate = F.least(F.lit(cap), F.exp(F.col("x") * F.col("size")))
        slope = F.when(F.col("x") * F.col("size") < top, rate * F.col("size") * F.col("size")).otherwise(0.0)
        # Decimal sums don't depend on the order of rows, so reruns agree to the last bit.
        exact = lambda c: F.sum(c.cast("decimal(38,6)"))
        sums = classes.join(F.broadcast(now), "s").groupBy("s").agg(exact(rate * F.col("size") * F.col("n")).alias("f"), exact(slope * F.col("n")).alias("g")).collect()
        for r in sums:
            x, lo, hi = state[r.s]
            off = float(r.f) - targets[r.s]
            if abs(off) <= near * max(1.0, targets[r.s]):
                todo.discard(r.s)
                continue
            lo, hi = (x, hi) if off < 0 else (lo, x)
            step = x - off / float(r.g) if r.g > 0 else None
            state[r.s] = [step if step is not None and lo < step < hi else (lo + hi) / 2, lo, hi]
    return {s: v[0] for s, v in state.items()}


def _round_source(cap: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Copies of each size of one source; there are no more sizes than the longest document has words."""

    def walk(key: tuple, sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("size", ascending=False)
        due, taken, out = 0.0, 0, []
        for size, n, rate in zip(sizes["size"], sizes["n"], sizes["rate"]):
            due += rate * size * n
            copies = round((due - taken) / size) if size else int(n)
            copies = max(0, min(copies, int(cap * n + 1e-9)))
            taken += copies * size
            out.append(copies)
        return pd.DataFrame({"s": sizes["s"], "size": sizes["size"], "copies": out})

    return walk


def numbered(sources: DataFrame) -> DataFrame:
    """sources with s: their number by code point, null last. Ranges are sorted one by one; only the ranges' lengths reach the driver."""
    ordered = sources.withColumn("_null", F.col("source").isNull()).repartitionByRange("_null", "source").sortWithinPartitions("_null", "source")
    # The id is the partition's number in the upper bits and the row's place in it in the lower 33.
    placed = written(ordered.drop("_null").withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    before, starts = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r.part, before))
        before += r["count"]
    offsets = F.broadcast(sources.sparkSession.createDataFrame(starts, "_part long, _start long"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn("s", F.col("_start") + place).drop("_id", "_part", "_start")


def filled(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """sources (s, total) with target, as water_fill has it. Every round closes the sources that the level overflows, by sums over classes of weight."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    table = written(sources.withColumn("_w", weight), "weighed")
    level, closed = math.inf, -1
    while True:
        over = (F.col("total") * cap < F.col("_w") * level) if closed >= 0 else F.lit(False)
        sums = table.groupBy("_w").agg(F.sum("total").alias("all"), F.sum(F.when(over, F.col("total")).otherwise(0)).alias("full"), F.count_if(over).alias("n"), F.count_if(~over).alias("open")).orderBy("_w").collect()
        n, rest = sum(r.n for r in sums), sum(r.all for r in sums) - cap * sum(r.full for r in sums)
        share = sum(r.open * r["_w"] for r in sums)
        if n == closed or not share:
            break
        level, closed = rest / share, n
    over = F.col("total") * cap < F.col("_w") * level
    return table.withColumn("target", F.when(over, F.col("total") * cap).otherwise(F.col("_w") * level)).drop("_w")


def solve_many(classes: DataFrame, sources: DataFrame, cap: float, steps: int = 60, near: float = 1e-6) -> DataFrame:
    """s, x: what `solve` finds, with the sources' brackets in a table that each Newton step writes anew."""
    top = math.log(cap)
    full = F.col("target") >= F.col("total") * (cap * (1 - 1e-12))
    start = sources.filter("total > 0").select("s", "target", F.when(full, top).otherwise(0.0).alias("x"), F.when(full, top).otherwise(-60.0).alias("lo"), F.lit(top).alias("hi"))
    found, state = [start.filter("lo >= hi").select("s", "x")], written(start.filter("lo < hi"), "state")
    for _ in range(steps):
        if state.isEmpty():
            break
        rate = F.least(F.lit(cap), F.exp(F.col("x") * F.col("size")))
        slope = F.when(F.col("x") * F.col("size") < top, rate * F.col("size") * F.col("size")).otherwise(0.0)
        exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
        sums = classes.join(state, "s").groupBy("s", "target", "x", "lo", "hi").agg(exact(rate * F.col("size") * F.col("n")).alias("f"), exact(slope * F.col("n")).alias("g"))
        off, met = F.col("f") - F.col("target"), F.abs(F.col("f") - F.col("target")) <= near * F.greatest(F.lit(1.0), "target")
        known = sums.select("s", "target", met.alias("met"), F.col("x").alias("at"), F.when(off < 0, F.col("x")).otherwise(F.col("lo")).alias("lo"), F.when(off < 0, F.col("hi")).otherwise(F.col("x")).alias("hi"), F.when(F.col("g") > 0, F.col("x") - off / F.col("g")).alias("step"))
        inside = (F.col("lo") < F.col("step")) & (F.col("step") < F.col("hi"))
        x = F.when(F.col("met"), F.col("at")).when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        now = written(known.select("s", "target", x.alias("x"), "lo", "hi", "met"), "state")
        found.append(now.filter("met").select("s", "x"))
        state = now.filter("not met").drop("met")
    return written(reduce(DataFrame.unionByName, [*found, state.select("s", "x")]), "multipliers")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, weights: Sequence[float] = WEIGHTS, max_sources: int = MAX_SOURCES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate.

    Sources are ordered by code point, null last and a source of its own;
    weights, repeating, are theirs in that order. A document without words has
    size 0 and takes none (copies 1). Repeated rows count each. An empty table
    gives no rows. Any number of sources: few are held on the driver, more than
    max_sources (or than MAX_NAMES bytes of names) in tables, by the same rules.
    """
    spark = docs.sparkSession
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size")), "sized")
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n_rows")), "sources", few=True)
    n_sources, n_bytes, n_rows = sources.agg(F.count(F.lit(1)), F.sum(F.octet_length("source")), F.sum("n_rows")).first()
    few = n_sources <= max_sources and (n_bytes or 0) <= MAX_NAMES
    if few:
        counts = sorted(sources.collect(), key=lambda r: (r.source is None, r.source or ""))
        totals = {i: int(r.total) for i, r in enumerate(counts)}
        targets = dict(enumerate(water_fill(list(totals.values()), [weights[i % len(weights)] for i in totals], cap)))
        known = spark.createDataFrame([(i, r.source, totals[i], float(targets[i])) for i, r in enumerate(counts)], "s long, source string, source_size long, target double")
        rows = sized.join(F.broadcast(known.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    else:
        known = written(filled(numbered(sources), weights, cap), "targets")
        key = F.struct(F.col("source").isNull().alias("none"), F.sha2(F.coalesce("source", F.lit("")), 256).alias("name")).alias("_key")
        keyed = known.select(key, "s", F.col("total").alias("source_size"), "target", F.col("n_rows").alias("_rows"))
        rows = join_counted(sized.select("*", key), keyed, ["_key"], "_rows", n_rows or 0).drop("_key", "_rows")
    classes = written(rows.groupBy("s", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    if few:
        multipliers = F.broadcast(spark.createDataFrame(sorted(solve(classes, targets, totals, cap).items()), "s long, x double"))
    else:
        multipliers = solve_many(classes, known, cap)
    rated = classes.join(multipliers, "s", "left").withColumn("rate", F.least(F.lit(cap), F.exp(F.coalesce("x", F.lit(0.0)) * F.col("size"))))
    plan = rated.groupBy("s").applyInPandas(_round_source(cap), "s long, size long, copies long")
    plan = written(rated.join(plan, ["s", "size"]).select("s", "size", "n", "rate", "copies"), "plan")

    # Within a size: each document gets the whole part, and the first by hash one more.
    ordered = F.xxhash64(F.lit(17), "doc_id")
    dealt = join_counted(rows, plan, ["s", "size"], "n", n_rows or 0).withColumn("base", F.floor(F.col("copies") / F.col("n")))
    dealt = dealt.withColumn("extra", F.col("copies") - F.col("base") * F.col("n")).withColumn("bucket", F.pmod(ordered, F.ceil(F.col("n") / BUCKET)).cast("int"))
    whole = dealt.filter("extra = 0").withColumn("more", F.lit(False))
    parted = dealt.filter("extra > 0")
    before = parted.groupBy("s", "size", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = before.select("s", "size", "bucket", F.coalesce(F.sum("m").over(W.partitionBy("s", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = parted.withColumn("rank", F.row_number().over(W.partitionBy("s", "size", "bucket").orderBy(ordered, "doc_id"))).join(before, ["s", "size", "bucket"])
    parted = ranked.withColumn("more", F.col("before") + F.col("rank") <= F.col("extra")).drop("before", "rank")
    copies = F.col("base") + F.col("more").cast("int")
    return whole.unionByName(parted).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"), "rate")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    mixed = written(mix(docs, id_col, text_col, source_col, **options).select("doc_id", "size", "copies"), "mixed")
    key = lambda c: F.struct(F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("key")
    counts = mixed.select(key("doc_id"), "size", "copies")
    keyed = docs.select(F.struct("*").alias("row"), key(id_col))
    on = ["key"]
    if not counts.groupBy("key").count().filter("count > 1").isEmpty():
        # Rows repeated under one id are told apart by their size and a number.
        numbered = lambda df, order: df.withColumn("number", F.row_number().over(W.partitionBy("key", "size").orderBy(order)))
        counts = numbered(counts, F.desc("copies"))
        keyed = numbered(keyed.withColumn("size", words(F.col("row")[text_col])), F.col("row")[text_col])
        on = ["key", "size", "number"]
    joined = keyed.join(counts.filter("copies > 0").select(*on, "copies"), on)
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
