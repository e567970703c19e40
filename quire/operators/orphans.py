"""References to records that do not exist, are deleted or arrive later.

Parent keys are sorted and compressed into contiguous runs; the distinct
targets are as-of matched to the preceding run start, and a target beyond the
run's end is undefined.  Runs are cut at fixed block borders of the key, so no
group grows with the data, and targets are aggregated before they are shuffled,
so a target that a third of all rows refer to is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.operators.skew import heavy_keys, salted_filter, unique_lookup
from quire.session import Scratch

BLOCK = 4096  # keys of a block; a run never crosses a block border
KEY = ["file_id", "obj_num", "obj_gen"]
GROUP = ["file_id", "obj_gen", "block"]


def _block(num: Column) -> Column:
    return F.floor(num / BLOCK).cast("bigint")


def runs(parents: DataFrame, first: str = "loaded_at") -> DataFrame:
    """Contiguous runs of the parent keys (file_id, obj_num, obj_gen).

    A row has the run's start and end and, for each key in it, the first time
    it was there; null times count as never there.  Null keys are dropped.
    """
    keys = parents.groupBy(*KEY).agg(F.min(first).alias("first")).na.drop()
    keys = keys.withColumn("block", _block(F.col("obj_num")))
    order = W.partitionBy(*GROUP).orderBy("obj_num")
    keys = keys.withColumn("island", F.col("obj_num") - F.row_number().over(order))
    return (
        keys.groupBy(*GROUP, "island")
        .agg(F.min("obj_num").alias("run_start"), F.max("obj_num").alias("run_end"), F.array_sort(F.collect_list(F.struct("obj_num", "first"))).alias("seen"))
        .select(*GROUP, "run_start", "run_end", F.col("seen.first").alias("firsts"))
    )


def match(targets: DataFrame, runs_: DataFrame) -> DataFrame:
    """``targets`` (unique file_id, obj_num, obj_gen) plus ``first``: when the target was first there, or null.

    As-of match: within a block, sorted by key, each target takes the last run
    start at or before it and is defined if it isn't beyond that run's end.
    """
    a = targets.withColumn("block", _block(F.col("obj_num"))).withColumn("_run", F.lit(None).cast("struct<run_start:int,run_end:int,firsts:array<timestamp>>"))
    b = runs_.select(*GROUP, F.col("run_start").alias("obj_num"), F.struct(F.col("run_start"), F.col("run_end"), F.col("firsts")).alias("_run"))
    before = W.partitionBy(*GROUP).orderBy("obj_num", F.col("_run").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_is_run", F.col("_run").isNotNull())
    both = both.withColumn("_run", F.last("_run", ignorenulls=True).over(before)).where(~F.col("_is_run"))
    at = F.col("obj_num") - F.col("_run.run_start")
    return both.withColumn("first", F.when(F.col("obj_num") <= F.col("_run.run_end"), F.get(F.col("_run.firsts"), at))).drop("_run", "_is_run", "block")


def references(object_refs: DataFrame, streams: DataFrame) -> DataFrame:
    """The references of both tables with their table, row, target and time."""
    a = object_refs.select(F.lit("object_refs").alias("src_table"), F.col("ref_id").alias("row_id"), "file_id", F.col("ref_num").alias("obj_num"), F.col("ref_gen").alias("obj_gen"), "seen_at")
    b = streams.select(F.lit("streams").alias("src_table"), F.col("stream_id").alias("row_id"), "file_id", F.col("length_num").alias("obj_num"), F.col("length_gen").alias("obj_gen"), "seen_at")
    return a.unionByName(b)


def orphans(object_refs: DataFrame, streams: DataFrame, objects: DataFrame, xref_entries: DataFrame, run_params: DataFrame) -> DataFrame:
    """(src_table, row_id, seen_at, reason) of every orphan reference, each row once.

    Reasons: ``undefined`` (no such object), ``freed`` (the head entry of the
    cross-reference table is free), ``late`` (the object came after the
    reference).  A null target is no reference.  Runs that read undefined
    references as null report none.  A reference or an object without a time
    can't prove that the object was there first, so it counts as undefined or
    late.  Repeated rows of any table change nothing.
    """
    refs = references(object_refs, streams).where("file_id is not null and obj_num is not null and obj_gen is not null")
    targets = refs.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("seen_at").alias("earliest"), F.count_if(F.col("seen_at").isNull()).alias("untimed"))
    lenient = run_params.where("undefined_ref_as_null").select("file_id").na.drop().distinct()
    targets = salted_filter(targets, lenient, "file_id", F.col("obj_num"), "left_anti")
    free = xref_entries.where("seq = 0 and kind = 'free'").select(*KEY).na.drop().distinct().withColumn("freed", F.lit(True))
    found = match(targets, runs(objects.select(*KEY, "loaded_at"))).join(free, KEY, "left")
    suspect = F.coalesce(F.col("freed") | F.col("first").isNull() | (F.col("first") > F.col("earliest")) | (F.col("untimed") > 0), F.lit(False))
    # Written once: the match would otherwise run again for each use below.  Heavy is what many references name, sound or not.
    found = Scratch(refs.sparkSession, "orphans").cut(found.select(*KEY, "n", "first", "freed", suspect.alias("suspect")), by="suspect")
    rows = unique_lookup(refs, found.where("suspect").select(*KEY, "first", "freed"), KEY, heavy_keys(found, KEY))
    reason = (
        F.when(F.col("freed"), "freed").when(F.col("first").isNull(), "undefined")
        .when(F.col("seen_at").isNull() | (F.col("first") > F.col("seen_at")), "late")
    )
    rows = rows.withColumn("reason", reason).where("reason is not null")
    return rows.select("src_table", "row_id", "seen_at", "reason").distinct()


def report(found: DataFrame) -> DataFrame:
    """Orphan rows per table, month of ``seen_at`` and reason."""
    month = F.date_format("seen_at", "yyyy-MM")
    return found.groupBy("src_table", month.alias("month"), "reason").agg(F.count_distinct("row_id").alias("n_rows"))
