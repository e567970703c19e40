"""Parent-child links to full hierarchies by heavy-path decomposition.

Nodes on or below a cycle are set apart first.  Every other node lies on one
chain: the chain goes on into the child with the largest subtree.  A node's
path is the concatenation of at most log2(n) chain segments.  Numbered chain by
chain, a node's descendants are one interval of numbers.

Groups (files) of at most ``local_max`` links are decomposed many at a time
inside one task by a numpy kernel, after a single shuffle.  Larger groups never
meet in one task: their sizes, chains and roots come from pointer doubling over
DataFrames, in O(log depth) rounds, each written to the shared scratch folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.kernels import forest
from quire.operators import blocks
from quire.operators.skew import heavy_keys, salted_filter, spread_join, unique_lookup
from quire.session import Scratch

LOCAL_MAX = 100_000
CHUNK = 200_000
ID = ["grp", "node"]
_FIELDS = ("grp", "node", "up", "root", "depth", "size", "chain", "pos", "up_chain", "up_pos", "pre")
_SCHEMA = ", ".join(f"{c} BIGINT" for c in _FIELDS)
_ARROW = pa.schema([(c, pa.int64()) for c in _FIELDS])


def links(tree_links: DataFrame) -> DataFrame:
    """(grp, node, parent) with one row per node key of a file.

    Keys are read from their text forms (``5``, ``5 [2]``, ``5_2``, ``5 2 R``,
    any blanks and leading zeros) into number * 2^32 + generation.  A null
    parent or the text ``null`` is none; a key that can't be read gives no row.
    Of differing rows for one node the last loaded one holds.
    """

    def key(c: str) -> Column:
        num = F.regexp_extract(c, r"([0-9]+)", 1)
        gen = F.regexp_extract(c, r"[0-9]+[^0-9]+([0-9]+)", 1)
        return F.try_add(F.shiftleft(F.expr("0L") + num.try_cast("bigint"), 32), F.when(gen == "", 0).otherwise(gen.try_cast("bigint")))

    rows = tree_links.select(F.col("file_id").alias("grp"), key("node_key").alias("node"), key("parent_ref").alias("parent"), "loaded_at", "link_id")
    latest = F.struct(F.col("loaded_at"), F.col("link_id"), F.col("parent"))
    best = rows.where("grp is not null and node is not null").groupBy(*ID).agg(F.max(latest).alias("_l"))
    return best.select(*ID, F.col("_l.parent").alias("parent"))


def number(c: str) -> Column:
    return F.shiftright(c, 32).cast("int")


def generation(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


# --- groups that fit in a task -------------------------------------------------


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; whole groups are gathered up to CHUNK rows and decomposed at once."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            whole = pa.Table.from_batches(held).combine_chunks()
            grp = whole.column(0).to_numpy()
            cut = int(np.searchsorted(grp, grp[-1]))  # the last group may go on
            if cut:
                yield _chunk(whole.slice(0, cut))
            held, n = whole.slice(cut).to_batches(), whole.num_rows - cut
    if held:
        yield _chunk(pa.Table.from_batches(held))


def _chunk(t: pa.Table) -> pa.RecordBatch:
    grp, node = t.column(0).to_numpy(), t.column(1).to_numpy()
    has = ~t.column(2).is_null().to_numpy()
    parent = t.column(2).fill_null(0).to_numpy()
    up = forest.parents(grp, node, parent, has)
    d = forest.decompose(up, node)
    ok = ~d["cyclic"]

    def of(rows: np.ndarray, values: np.ndarray, there: np.ndarray) -> pa.Array:
        return pa.array(values[np.where(there, rows, 0)], pa.int64(), mask=~there)

    every = np.arange(len(node))
    above = np.where(ok, up[d["head"]], forest.NONE)  # the parent of the chain's head
    has_above = above != forest.NONE
    up_chain = d["head"][np.where(has_above, above, 0)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(grp), pa.array(node), of(up, node, up != forest.NONE), of(d["root"], node, ok), of(every, d["depth"], ok),
            of(every, d["size"], ok), of(d["head"], node, ok), of(every, d["pos"], ok), of(up_chain, node, has_above), of(above, d["pos"], has_above),
            of(every, d["pre"], ok),
        ],
        schema=_ARROW,
    )


# --- groups of any size --------------------------------------------------------


def _lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    counts = left.groupBy("grp", key).agg(F.count("*").alias("n"))
    return unique_lookup(left, right, ["grp", key], heavy_keys(counts, ["grp", key]))


def _spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``_lookup`` where the rows of ``right`` are of any width or number."""
    counts = left.groupBy("grp", key).agg(F.count("*").alias("n"))
    return spread_join(left, right, ["grp", key], heavy_keys(counts, ["grp", key]))


def climb(df: DataFrame, scratch: Scratch, weights: tuple[str, ...] = ("w",)) -> DataFrame:
    """(grp, id, ptr, weights) to (grp, id, top, weights): the end of each acyclic pointer path and the sum of each weight to it.

    Pointer doubling; a null pointer ends a path.  O(log length) rounds.
    """
    start = [F.when(F.col("ptr").isNull(), F.lit(0)).otherwise(F.col(w)).cast("bigint").alias(w) for w in weights]
    state = scratch.cut(df.select("grp", "id", F.col("ptr"), F.when(F.col("ptr").isNull(), F.col("id")).alias("top"), *start))
    while not state.where("ptr is not null").isEmpty():
        target = state.select("grp", F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("top").alias("_top"), *[F.col(w).alias(f"_{w}") for w in weights])
        sums = [(F.col(w) + F.col(f"_{w}")).alias(w) for w in weights]
        moved = _lookup(state.where("ptr is not null").drop("top"), target, "ptr").select("grp", "id", F.col("_ptr").alias("ptr"), F.col("_top").alias("top"), *sums)
        done = state.where("ptr is null")
        new = scratch.cut(done.unionByName(moved))
        scratch.drop(state)
        state = new
    return state.select("grp", "id", "top", *weights)


def _sizes(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, node, up) to the same plus size; nodes on or below a cycle are left out.

    After round k ``anc`` is the 2^k-th ancestor and ``size`` counts the
    descendants at a distance under 2^k.  When a round ends no further node's
    climb, those still climbing are caught in a cycle.
    """
    state = scratch.cut(nodes.select(*ID, "up", F.col("up").alias("anc"), F.lit(1).cast("bigint").alias("size")))
    active, before = state.where("anc is not null").count(), -1
    while active and active != before:
        climbing = state.where("anc is not null")
        sums = climbing.groupBy("grp", F.col("anc").alias("node")).agg(F.sum("size").alias("_more"))
        moved = _lookup(climbing, state.select("grp", F.col("node").alias("anc"), F.col("anc").alias("_anc")), "anc").drop("anc").withColumnRenamed("_anc", "anc")
        both = state.where("anc is null").unionByName(moved.select(state.columns))
        new = scratch.cut(both.join(sums, ID, "left").select(*ID, "up", "anc", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")))
        scratch.drop(state)
        state, before = new, active
        active = state.where("anc is not null").count()
    return state.where("anc is null").select(*ID, "up", "size")


def _distributed(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    own = nodes.select("grp", F.col("node").alias("parent"), F.col("node").alias("up"))
    with_up = scratch.cut(nodes.where("parent is null").select(*ID, F.lit(None).cast("bigint").alias("up")).unionByName(_up(nodes.where("parent is not null"), own)))
    tree = scratch.cut(_sizes(with_up, scratch))
    # A chain goes on into the child with the largest subtree, of equals the smallest key.
    heavy = tree.where("up is not null").groupBy("grp", "up").agg(F.max(F.struct(F.col("size"), (-F.col("node")).alias("neg"))).alias("_m"))
    heavy = heavy.select("grp", (-F.col("_m.neg")).alias("node"), F.col("up").alias("_above"), F.col("_m.size").alias("_heaviest"))
    flagged = scratch.cut(tree.join(heavy, ID, "left"))
    on = F.col("_above").isNotNull()
    chains = climb(flagged.select("grp", F.col("node").alias("id"), F.when(on, F.col("up")).alias("ptr"), F.lit(1).alias("w")), scratch)
    placed = scratch.cut(flagged.join(chains.select("grp", F.col("id").alias("node"), F.col("top").alias("chain"), F.col("w").alias("pos")), ID))
    # The light children of a node are numbered behind the heavy one, in key order.
    light = blocks.running(placed.where(~on & F.col("up").isNotNull()).select(*ID, "up", "size"), ["grp", "up"], ["node"], F.shiftright("node", 44), F.col("size"), "_run")
    behind = flagged.where(on).select("grp", F.col("_above").alias("up"), "_heaviest")
    offs = scratch.cut(_lookup(light, behind, "up").select("grp", F.col("node").alias("chain"), (F.col("_run") - F.col("size") + F.col("_heaviest") + 1).alias("off")))
    heads = placed.where("node = chain")
    roots = heads.where("up is null").select("grp", "chain", F.lit(None).cast("bigint").alias("up_chain"), F.lit(None).cast("bigint").alias("up_pos"))
    hung = _lookup(heads.where("up is not null").select("grp", "chain", "up"), placed.select("grp", F.col("node").alias("up"), F.col("chain").alias("up_chain"), F.col("pos").alias("up_pos")), "up").drop("up")
    ups = scratch.cut(roots.unionByName(hung.select(roots.columns)).join(offs, ["grp", "chain"], "left"))
    at = F.coalesce("up_pos", F.lit(0))
    tops = climb(ups.select("grp", F.col("chain").alias("id"), F.col("up_chain").alias("ptr"), (at + 1).alias("base"), (at + F.coalesce("off", F.lit(0))).alias("first")), scratch, ("base", "first"))
    ups = scratch.cut(ups.drop("off").join(tops.select("grp", F.col("id").alias("chain"), F.col("top").alias("root"), "base", "first"), ["grp", "chain"]))
    done = _lookup(placed.select(*ID, "up", "size", "chain", "pos"), ups, "chain")
    done = done.withColumn("depth", F.col("base") + F.col("pos")).withColumn("pre", F.col("first") + F.col("pos")).select(*_FIELDS)
    # Nodes that aren't in the tree lie on or below a cycle.
    rest = with_up.join(tree.select(*ID), ID, "left_anti")
    none = [F.lit(None).cast("bigint").alias(c) for c in _FIELDS[3:]]
    return done.unionByName(rest.select(*ID, "up", *none))


def _up(children: DataFrame, own: DataFrame) -> DataFrame:
    """The parent where it has a row of its own, else null."""
    counts = children.groupBy("grp", "parent").agg(F.count("*").alias("n"))
    there = counts.join(own, ["grp", "parent"], "left").select("grp", "parent", "up", "n")
    return unique_lookup(children, there.drop("n"), ["grp", "parent"], heavy_keys(there, ["grp", "parent"])).select(*ID, "up")


def decompose(nodes: DataFrame, local_max: int = LOCAL_MAX) -> DataFrame:
    """Chains of (grp, node, parent), unique in (grp, node).

    Columns: up (the parent, where it has a row of its own), root, depth, size
    (nodes of the subtree, itself included), chain (its head), pos, and up_chain
    and up_pos: the place where the chain hangs on another, pre: the number of
    the node in its tree.  A node's descendants are those of its tree whose
    ``pre`` is one of the ``size`` - 1 next: an interval, however many there
    are.  Nodes on or below a cycle have null root, depth, size, chain and pre.
    Empty input gives no rows.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "forest")
    nodes = nodes.select("grp", "node", "parent")
    big = nodes.groupBy("grp").count().where(F.col("count") > local_max).select("grp")
    if not big.isEmpty():
        small = salted_filter(nodes, big, "grp", F.col("node"), "left_anti")
        large = _distributed(scratch.cut(salted_filter(nodes, big, "grp", F.col("node"), "left_semi")), scratch)
    else:
        small, large = nodes, None
    ordered = small.repartition("grp").sortWithinPartitions("grp", "node")
    out = ordered.mapInArrow(_local, _SCHEMA)
    return out if large is None else out.unionByName(large)


def segments(h: DataFrame) -> DataFrame:
    """(grp, chain, ord, seg_chain, seg_upto): the chain intervals from the root to each chain.

    At most log2(n) rows per chain; a node's ancestors are its own chain up to
    ``pos`` and these intervals.
    """
    spark = h.sparkSession
    scratch = Scratch(spark, "segments")
    chains = scratch.cut(h.where("node = chain").select("grp", "chain", "up_chain", "up_pos"))
    ups = chains.where("up_chain is not null")
    step = ups.select("grp", F.col("chain").alias("seg_chain"), "up_chain", "up_pos")
    at = scratch.cut(ups.select("grp", "chain", F.lit(1).alias("ord"), F.col("up_chain").alias("seg_chain"), F.col("up_pos").alias("seg_upto")))
    out = at
    while not at.isEmpty():
        at = scratch.cut(_lookup(at, step, "seg_chain").select("grp", "chain", (F.col("ord") + 1).alias("ord"), F.col("up_chain").alias("seg_chain"), F.col("up_pos").alias("seg_upto")))
        out = out.unionByName(at)
    return out


def paths(h: DataFrame) -> DataFrame:
    """``h`` plus ``path``: the keys from the root to the node, by concatenated chain segments.

    Null for nodes on or below a cycle.
    """
    scratch = Scratch(h.sparkSession, "paths")
    h = scratch.cut(h)
    tree = h.where("chain is not null")
    members = scratch.cut(tree.groupBy("grp", "chain").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("_m"), F.first("up_chain").alias("up_chain"), F.first("up_pos").alias("up_pos")).select("grp", "chain", F.col("_m.node").alias("nodes"), "up_chain", "up_pos"))
    level = scratch.cut(members.where("up_chain is null").select("grp", "chain", "nodes", F.expr("array()").cast("array<bigint>").alias("prefix")))
    done = level
    waiting = members.where("up_chain is not null")
    while not level.isEmpty():
        above = level.select("grp", F.col("chain").alias("up_chain"), F.col("nodes").alias("_n"), F.col("prefix").alias("_p"))
        level = scratch.cut(_spread(waiting, above, "up_chain").select("grp", "chain", "nodes", F.concat("_p", F.slice("_n", F.lit(1), (F.col("up_pos") + 1).cast("int"))).alias("prefix")))
        done = done.unionByName(level)
    with_path = _spread(tree, done, "chain").withColumn("path", F.concat("prefix", F.slice("nodes", F.lit(1), (F.col("pos") + 1).cast("int"))))
    cyclic = h.where("chain is null").withColumn("path", F.lit(None).cast("array<bigint>"))
    return with_path.select(*_FIELDS, "path").unionByName(cyclic.select(*_FIELDS, "path"))


def descendants(h: DataFrame) -> DataFrame:
    """(grp, node, descendant): a node's descendants one by one, by chain intervals, itself not included.

    The output has a row for each ancestor of each node; where the interval of
    ``pre`` and ``size`` will do, there is no need for it.
    """
    segs = segments(h)
    tree = h.where("chain is not null")
    own = tree.select("grp", F.col("node").alias("descendant"), "chain", F.col("chain").alias("seg_chain"), (F.col("pos") - 1).alias("seg_upto"))
    above = tree.select("grp", F.col("node").alias("descendant"), "chain").join(segs, ["grp", "chain"]).select("grp", "descendant", "seg_chain", "seg_upto")
    at = tree.select("grp", "node", F.col("chain").alias("seg_chain"), "pos")
    segs = own.select("grp", "descendant", "seg_chain", "seg_upto").unionByName(above)
    return _spread(segs, at, "seg_chain").where("pos <= seg_upto").select("grp", "node", "descendant")
