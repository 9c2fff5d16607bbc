"""Incremental detection: changed facts in, added and removed findings out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edited(accesses: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """accesses without the removed ones (idx), with the added ones."""
    return accesses.join(removed.select("idx"), "idx", "left_anti").unionByName(added)


def net(accesses: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """What an edit comes to: rows of accesses that go and rows that come, with `new`; equal ones cancel out."""
    gone = accesses.join(removed.select("idx"), "idx", "left_semi").select(accesses.columns)
    return one_sided(gone, added.select(accesses.columns))


def one_sided(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows that one side alone has, with `new`: whether that is `after`. One shuffle for both directions."""
    both = before.withColumn("_after", F.lit(False)).unionByName(after.withColumn("_after", F.lit(True)))
    sides = both.groupBy(*before.columns).agg(F.bool_or("_after").alias("new"), F.bool_and("_after").alias("_only"))
    return sides.filter("new = _only").drop("_only")


def interest(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of rows that one side alone has: what must be looked at again."""
    return one_sided(before, after).select(key).distinct()


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of these keys: a semi join, so the rest is neither paired nor shuffled on."""
    return rows.join(keys, key, "left_semi")


def difference(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) findings; rows are sets."""
    sides = one_sided(before, after)
    return sides.filter("new").drop("new"), sides.filter("not new").drop("new")


def without_variables(accesses: DataFrame, prefixes: list[str]) -> DataFrame:
    """Accesses to ignored variables go: those whose signature is a prefix or lies below one."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | (F.col("sig") == p) | F.col("sig").startswith(f"{p}.")
    return accesses.filter(~hit)


def without_methods(rows: DataFrame, methods: DataFrame, key: str) -> DataFrame:
    """Rows of ignored methods go."""
    return rows.join(methods.select(key), key, "left_anti")


def moved_lines(findings: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, added) findings whose places got new lines (loc, new_loc)."""
    one = lines.select(F.col("loc").alias("loc1"), F.col("new_loc").alias("_n1"))
    two = lines.select(F.col("loc").alias("loc2"), F.col("new_loc").alias("_n2"))
    both = findings.join(one, "loc1", "left").join(two, "loc2", "left").filter("_n1 is not null or _n2 is not null")
    new = both.withColumn("loc1", F.coalesce("_n1", "loc1")).withColumn("loc2", F.coalesce("_n2", "loc2"))
    return both.select(findings.columns), new.select(findings.columns)


def same_code(old: DataFrame, new: DataFrame) -> DataFrame:
    """node_id, same: whether a method has the same instructions at the same places."""
    o, n = old.select("node_id", "iindex", F.col("text").alias("_o")), new.select("node_id", "iindex", F.col("text").alias("_n"))
    return o.join(n, ["node_id", "iindex"], "full").groupBy("node_id").agg(F.bool_and(F.col("_o").eqNullSafe(F.col("_n"))).alias("same"))


def deleted_instructions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old instructions whose text the new method doesn't have."""
    return old.join(new.select("node_id", "text"), ["node_id", "text"], "left_anti")


def lost_calls(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lost, kept) calls (caller, target)."""
    keys = new.select("caller", "target").distinct()
    return old.join(keys, ["caller", "target"], "left_anti"), old.join(keys, ["caller", "target"], "left_semi")


def apply_points_to(points_to: DataFrame, delta: DataFrame) -> DataFrame:
    """points_to after a delta (op + | -, the same columns)."""
    keys = points_to.columns
    gone, new = delta.filter("op = '-'").select(keys), delta.filter("op = '+'").select(keys)
    return points_to.join(gone, keys, "left_anti").unionByName(new).distinct()
