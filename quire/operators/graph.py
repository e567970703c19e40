"""The reference graph: edges, search, reachability, undefined targets, dense renumbering and relinking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.operators import blocks
from quire.operators.skew import heavy_keys, salted_filter, spread_join, unique_lookup
from quire.session import Scratch

SRC, DST = ["src_num", "src_gen"], ["ref_num", "ref_gen"]
LOCAL_MAX, CHUNK = 200_000, 400_000
_REACHED = "file_id BIGINT, node BIGINT"


def code(num: str, gen: str) -> Column:
    """A key as one number."""
    return F.shiftleft(F.col(num).cast("bigint"), 32) + F.col(gen)


def uncode(c: str) -> tuple[Column, Column]:
    return F.shiftright(c, 32).cast("int"), F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def edges(refs: DataFrame) -> DataFrame:
    """One row per (file, object, distinct target); null targets are no edges."""
    return refs.select("file_id", *SRC, *DST).na.drop().distinct()


def vertices(objects: DataFrame) -> DataFrame:
    return objects.select("file_id", "obj_num", "obj_gen").na.drop().distinct()


def first_paths(refs: DataFrame) -> DataFrame:
    """Of each edge the entry of its first reference."""
    keyed = refs.na.drop(subset=["file_id", *SRC, *DST])
    return keyed.groupBy("file_id", *SRC, *DST).agg(F.min_by("entry", "ref_id").alias("entry"))


def undefined(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges to objects that aren't there; targets are aggregated before the join with the objects.

    Heavy is a target that many references name, whether it is there or not.
    """
    key = ["file_id", *DST]
    refs = refs.select("file_id", *SRC, *DST).na.drop()
    have = vertices(objects).withColumnsRenamed({"obj_num": "ref_num", "obj_gen": "ref_gen"}).withColumn("_there", F.lit(True))
    counts = refs.groupBy(*key).agg(F.count("*").alias("n")).join(have, key, "left")
    counts = Scratch(refs.sparkSession, "undefined").cut(counts.select(*key, "n", F.col("_there").isNull().alias("missing")), by="missing")
    return unique_lookup(refs, counts.where("missing").select(*key), key, heavy_keys(counts, key)).select("file_id", *SRC, *DST).distinct()


def nulled(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """``refs`` with the target of each reference to an object that isn't there set to null; all other rows as they are.

    Null keys are no targets; repeated rows stay.
    """
    key = ["file_id", *DST]
    there = vertices(objects).withColumnsRenamed({"obj_num": "ref_num", "obj_gen": "ref_gen"})
    counts = refs.na.drop(subset=key).groupBy(*key).agg(F.count("*").alias("n")).join(there.withColumn("_there", F.lit(True)), key, "left")
    counts = Scratch(refs.sparkSession, "nulled").cut(counts.select(*key, "n", F.col("_there").isNull().alias("missing")), by="missing")
    heavy = F.broadcast(heavy_keys(counts, key))
    missing = counts.where("missing").select(*key, F.lit(True).alias("_gone"))
    # The rows of heavy targets meet at most as many rows of a broadcast; a null never equals a key.
    hot = F.broadcast(heavy.join(missing, key, "left").select(*key, F.coalesce("_gone", F.lit(False)).alias("_gone")))
    light = refs.join(heavy, key, "left_anti").join(missing, key, "left")
    both = refs.join(hot, key).select(*refs.columns, "_gone").unionByName(light.select(*refs.columns, "_gone"))
    gone = F.coalesce("_gone", F.lit(False))
    return both.select(*[F.when(~gone, F.col(c)).alias(c) if c in DST else c for c in refs.columns])


def inlined(refs: DataFrame, small: DataFrame) -> DataFrame:
    """Edges to the objects of ``small`` (file_id, obj_num, obj_gen, kind, value) with the value that would stand in their place.

    An object delivered with several values gives an edge for each.
    """
    key = ["file_id", *DST]
    e = edges(refs)
    counts = e.groupBy(*key).agg(F.count("*").alias("n"))
    return spread_join(e, small.withColumnsRenamed({"obj_num": "ref_num", "obj_gen": "ref_gen"}), key, heavy_keys(counts, key)).select("file_id", *SRC, *DST, "kind", "value")


def left_union(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``left`` and those of ``right`` whose key ``left`` hasn't; null keys are equal to each other."""
    have = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    cond = [right[k].eqNullSafe(have[f"_k{i}"]) for i, k in enumerate(keys)]
    return left.unionByName(right.select(left.columns).join(have, cond, "left_anti"))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, src, dst) sorted by file; a start is an edge from null."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            whole = pa.Table.from_batches(held).combine_chunks()
            f = whole.column(0).to_numpy()
            cut = int(np.searchsorted(f, f[-1]))
            if cut:
                yield _reach(whole.slice(0, cut))
            held, n = whole.slice(cut).to_batches(), whole.num_rows - cut
    if held:
        yield _reach(pa.Table.from_batches(held))


def _reach(t: pa.Table) -> pa.RecordBatch:
    f, start = t.column(0).to_numpy(), t.column(1).is_null().to_numpy()
    src, dst = t.column(1).fill_null(0).to_numpy(), t.column(2).to_numpy()
    _, g = np.unique(f, return_inverse=True)
    values, codes = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = g * len(values) + codes[: len(f)], g * len(values) + codes[len(f) :]
    keys, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ids[: len(f)], ids[len(f) :]
    seen = np.zeros(len(keys), bool)
    frontier = np.unique(b[start])
    seen[frontier] = True
    order = np.argsort(a[~start], kind="stable")
    tail, head = a[~start][order], b[~start][order]
    lo, hi = np.searchsorted(tail, np.arange(len(keys))), np.searchsorted(tail, np.arange(len(keys)), side="right")
    while len(frontier):
        counts = hi[frontier] - lo[frontier]
        at = np.repeat(lo[frontier] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        nxt = np.unique(head[at])
        frontier = nxt[~seen[nxt]]
        seen[frontier] = True
    out = keys[seen]
    files = np.unique(f)
    return pa.RecordBatch.from_arrays([pa.array(files[out // len(values)], pa.int64()), pa.array(values[out % len(values)], pa.int64())], names=["file_id", "node"])


def closure(links: DataFrame, starts: DataFrame, local_max: int = LOCAL_MAX) -> DataFrame:
    """(file_id, node): what is reachable from ``starts`` (file_id, node) over ``links`` (file_id, src, dst).

    Starts are reached whether or not they have links; nulls are no links.
    Files of at most ``local_max`` links are searched many at a time inside one
    task; larger ones by a frontier over DataFrames, a shuffle per level.
    """
    links = links.select("file_id", "src", "dst").na.drop().distinct()
    starts = starts.select("file_id", "node").na.drop().distinct()
    big = links.groupBy("file_id").count().where(F.col("count") > local_max).select("file_id")
    scratch = Scratch(links.sparkSession, "closure")
    large = None
    if not big.isEmpty():
        wide = scratch.cut(salted_filter(links, big, "file_id", F.col("dst"), "left_semi"))
        frontier = seen = scratch.cut(starts.join(big, "file_id", "left_semi"))
        level = 0
        while not frontier.isEmpty():
            step = frontier.withColumnRenamed("node", "src").join(wide, ["file_id", "src"]).select("file_id", F.col("dst").alias("node")).distinct()
            frontier = scratch.cut(step.join(seen, ["file_id", "node"], "left_anti"))
            level += 1
            seen = seen.unionByName(frontier)
            if level % 16 == 0:  # else a late level would read as many tables as there are levels
                seen = scratch.cut(seen)
        large = seen
        links = salted_filter(links, big, "file_id", F.col("dst"), "left_anti")
        starts = starts.join(big, "file_id", "left_anti")
    rows = links.unionByName(starts.select("file_id", F.lit(None).cast("bigint").alias("src"), F.col("node").alias("dst")))
    out = rows.repartition("file_id").sortWithinPartitions("file_id").mapInArrow(_local, _REACHED)
    return out if large is None else out.unionByName(large)


def renumber(reached: DataFrame, block: int = 4096) -> DataFrame:
    """(file_id, node, new_num): dense numbers 1..n in key order within each file."""
    return blocks.numbered(reached, ["file_id"], ["node"], F.floor(F.shiftright("node", 32) / block), "new_num").select("file_id", "node", F.col("new_num").cast("int").alias("new_num"))


def relink(links: DataFrame, numbers: DataFrame) -> DataFrame:
    """(file_id, src, dst) with both ends renumbered; links from or to what has no number are dropped."""
    scratch = Scratch(links.sparkSession, "relink")
    numbers = scratch.cut(numbers.select("file_id", "node", "new_num"))
    for end in ("dst", "src"):  # either may be an object that holds much of all links
        key = ["file_id", end]
        to = numbers.select("file_id", F.col("node").alias(end), F.col("new_num").alias(f"new_{end}"))
        counts = links.groupBy(*key).agg(F.count("*").alias("n"))
        links = unique_lookup(links, to, key, heavy_keys(counts, key))
        if end == "dst":
            links = scratch.cut(links)
    return links.select("file_id", "new_src", "new_dst")


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two edge sets are equal, duplicates included."""
    return a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()
