"""Points-to sets by inclusion constraints (Andersen), as joins to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import cut


def points_to(new: DataFrame, assign: DataFrame, load: DataFrame, store: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(var, obj) from new (var, obj), assign (to, from), load (to, base, field) and store (base, field, from).

    Fields are told apart by object. Semi-naive for assignments; loads and stores
    are derived again in each round from what is known.
    """
    known = cut(new.select("var", "obj").distinct())
    fresh = known
    flows = assign.select(F.col("from").alias("_f"), F.col("to").alias("_t"))
    for _ in range(most_rounds):
        base = known.select(F.col("var").alias("base"), F.col("obj").alias("holder"))
        heap = store.join(base, "base").join(known.select(F.col("var").alias("from"), "obj"), "from").select("holder", "field", "obj")
        loaded = load.join(base, "base").join(heap, ["holder", "field"]).select(F.col("to").alias("var"), "obj")
        copied = fresh.join(flows, F.col("var") == F.col("_f")).select(F.col("_t").alias("var"), "obj")
        fresh = cut(copied.unionByName(loaded).distinct().join(known, ["var", "obj"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh))
    raise RuntimeError("the points-to sets didn't settle")
