"""Cross-reference tables and file layout: heads, shadows, reconciliation, overlaps and holes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.operators import blocks
from quire.operators.skew import salted_filter

KEY = ["file_id", "obj_num", "obj_gen"]
BLOCK_BYTES = 1 << 20


def heads(xref: DataFrame) -> DataFrame:
    """The entry that counts for each key: the one that comes first."""
    rows = xref.na.drop(subset=[*KEY, "seq"])
    first = F.struct("seq", "kind", "off", "idx")
    return rows.groupBy(*KEY).agg(F.min(first).alias("h"), F.count_distinct("seq").alias("n_entries")).select(*KEY, "h.kind", "h.off", "h.idx", "n_entries")


def zero_offsets(xref: DataFrame, run_params: DataFrame) -> DataFrame:
    """Entries with in-use ones at offset 0 freed, in files whose run asks for it; only these are looked up."""
    asks = run_params.where("zero_offset_as_free").select("file_id").na.drop().distinct()
    zero = F.coalesce((F.col("kind") == "inuse") & (F.col("off") == 0), F.lit(False))
    found = xref.where(zero)
    kept = salted_filter(found, asks, "file_id", F.col("obj_num"), "left_anti").unionByName(xref.where(~zero))
    return salted_filter(found, asks, "file_id", F.col("obj_num"), "left_semi").withColumn("kind", F.lit("free")).unionByName(kept)


def totals(xref: DataFrame) -> DataFrame:
    """Entries, free, compressed and shadowed ones per file."""
    return xref.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "free").alias("n_free"), F.count_if(F.col("kind") == "compressed").alias("n_compressed"), F.count_if(F.col("seq") > 0).alias("n_shadowed"))


def lines(xref: DataFrame) -> DataFrame:
    """The report line of each entry, shadowed ones starred."""
    where = (
        F.when(F.col("kind") == "free", F.format_string("[not used, next is %d]", "off"))
        .when(F.col("kind") == "compressed", F.format_string("in (%d, 0) [at %d]", "off", "idx"))
        .otherwise(F.concat(F.format_string("at %d [0x", "off"), F.lower(F.hex("off")), F.lit("]")))
    )
    star = F.when(F.col("seq") > 0, "*").otherwise("")
    return xref.where("kind is not null").select(*KEY, "seq", F.concat(star, F.format_string("(%d, %d) ", "obj_num", "obj_gen"), where).alias("line"))


def reconcile(xref: DataFrame, objects: DataFrame) -> DataFrame:
    """Keys on which the table and the objects differ, and how."""
    a = heads(xref).where("kind = 'inuse'").select(*KEY, "off")
    b = objects.where("low is not null").groupBy(*KEY).agg(F.min("low").alias("low")).na.drop()
    status = F.when(F.col("off").isNull(), "no entry").when(F.col("low").isNull(), "no object").when(F.col("off") != F.col("low"), "other position")
    return a.join(b, KEY, "full_outer").withColumn("status", status).where("status is not null")


def extents(objects: DataFrame) -> DataFrame:
    """One extent per object; redelivered objects count once."""
    return objects.where("low is not null and high is not null and file_id is not null").select(*KEY, "low", "high").distinct()


def overlaps(ext: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Neighbouring extents (by start) that share a byte; extents are closed, so touching ends overlap."""
    before = F.struct("high", "obj_num", "obj_gen")
    rows = blocks.previous(ext, ["file_id"], ["low", "high", "obj_num", "obj_gen"], F.floor(F.col("low") / block_bytes), before)
    return rows.where(F.col("prev.high") >= F.col("low")).select(*KEY, "low", F.col("prev.obj_num").alias("prev_num"), F.col("prev.obj_gen").alias("prev_gen"), F.col("prev.high").alias("prev_high"))


def gaps(ext: DataFrame, files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file_id, start, size) of the bytes no extent covers, the tail of each file included."""
    ends = files.groupBy("file_id").agg(F.max("length").alias("low")).na.drop()
    tail = ends.select("file_id", "low", F.col("low").alias("high"))
    rows = ext.select("file_id", "low", "high").unionByName(tail)
    rows = blocks.running(rows, ["file_id"], ["low", "high"], F.floor(F.col("low") / block_bytes), F.col("high") + 1, "reach", how="max")
    rows = blocks.previous(rows, ["file_id"], ["low", "high"], F.floor(F.col("low") / block_bytes), F.col("reach"), "covered")
    start = F.coalesce("covered", F.lit(0))
    return rows.where(F.col("low") > start).select("file_id", start.cast("bigint").alias("start"), (F.col("low") - start).cast("bigint").alias("size"))
