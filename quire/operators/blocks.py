"""Ordered operations within groups that may be far larger than a task.

A group is cut into blocks of its order key.  Windows run within (group,
block); what must pass from block to block is one row a block, so it fits a
window over the block summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _w(group: list[str], *order) -> W:
    return W.partitionBy(*group).orderBy(*order)


def previous(df: DataFrame, group: list[str], order: list[str], block: Column, value: Column, name: str = "prev") -> DataFrame:
    """``df`` plus ``value`` of the row before it in its group, null for the first.

    ``block`` must not fall as the order rises.
    """
    df = df.withColumn("_b", block).withColumn("_v", F.struct(value.alias("v")))
    inside = F.lag("_v").over(_w([*group, "_b"], *order))
    last = df.groupBy(*group, "_b").agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    last = last.withColumn("_carry", F.lag("_last").over(_w(group, "_b"))).drop("_last")
    out = df.withColumn("_in", inside)
    cond = [out[g].eqNullSafe(last[g]) for g in group] + [out["_b"].eqNullSafe(last["_b"])]
    both = out.join(last, cond, "left").drop(*[last[g] for g in group], last["_b"])
    return both.withColumn(name, F.coalesce("_in", "_carry")["v"]).drop("_b", "_v", "_in", "_carry")


def running(df: DataFrame, group: list[str], order: list[str], block: Column, value: Column, name: str, how: str = "sum") -> DataFrame:
    """``df`` plus the running sum (or max) of ``value`` up to and with each row of its group."""
    agg = F.sum if how == "sum" else F.max
    df = df.withColumn("_b", block).withColumn("_v", value)
    inside = agg("_v").over(_w([*group, "_b"], *order).rowsBetween(W.unboundedPreceding, 0))
    whole = df.groupBy(*group, "_b").agg(agg("_v").alias("_t"))
    whole = whole.withColumn("_carry", agg("_t").over(_w(group, "_b").rowsBetween(W.unboundedPreceding, -1))).drop("_t")
    out = df.withColumn("_in", inside)
    cond = [out[g].eqNullSafe(whole[g]) for g in group] + [out["_b"].eqNullSafe(whole["_b"])]
    both = out.join(whole, cond, "left").drop(*[whole[g] for g in group], whole["_b"])
    total = F.col("_in") + F.coalesce("_carry", F.lit(0)) if how == "sum" else F.greatest("_in", "_carry")
    return both.withColumn(name, total).drop("_b", "_v", "_in", "_carry")


def numbered(df: DataFrame, group: list[str], order: list[str], block: Column, name: str = "n") -> DataFrame:
    """``df`` plus 1, 2, ... in the order of each group; the order must be unique."""
    return running(df, group, order, block, F.lit(1).cast("bigint"), name)
