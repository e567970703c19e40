"""Filling fixed-capacity containers: first-fit decreasing with a tournament tree.

Items are dealt at random into groups of about GROUP items; each group is
packed on its own, for every capacity, in one task.  First fit is found in
O(log bins) by a tournament tree that holds the largest free space below each
node.  An item is split only if it exceeds the capacity by itself: into full
pieces and one rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import tokens as T
from quire.session import Scratch, spread

GROUP = 20_000
CAPACITIES = 256
_PACKED = "pack_id INT, bin BIGINT, doc_id BIGINT, piece INT, start BIGINT, tokens INT"
_PACKED_ARROW = pa.schema([("pack_id", pa.int32()), ("bin", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("tokens", pa.int32())])


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size (none above ``capacity``), largest first, ties in the given order."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    free = [capacity] * (2 * leaves)  # node i has the children 2i and 2i + 1; bins are the leaves
    out = [0] * len(sizes)
    for i in order:
        need, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        out[i] = node - leaves
        free[node] -= need
        node //= 2
        while node:
            left, right = free[2 * node], free[2 * node + 1]
            most = left if left > right else right
            if free[node] == most:
                break
            free[node] = most
            node //= 2
    return out


def pieces(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, tokens) of the pieces an item has at a capacity; one unless it exceeds it."""
    if size <= capacity:
        return [(0, size)]
    return [(a, min(capacity, size - a)) for a in range(0, size, capacity)]


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = T.counter(vocabulary).count
        for batch in batches:
            n = [count(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return run


def count_tokens(documents: DataFrame, vocabulary: str = T.VOCABULARY, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens) of every document; a null text is no item, an empty one has 0 tokens."""
    docs = documents.where(F.col(text).isNotNull()).select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return spread(docs, "doc_id").mapInArrow(_count(vocabulary), "doc_id BIGINT, tokens BIGINT")


def _pack(packs: list[tuple[int, int]]):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        t = t.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
        docs, sizes = t.column("doc_id").to_pylist(), t.column("tokens").to_pylist()
        out = []
        for pack, capacity in packs:
            parts = [(d, k, a, n) for d, size in zip(docs, sizes) for k, (a, n) in enumerate(pieces(size, capacity))]
            bins = first_fit_decreasing([p[3] for p in parts], capacity)
            d, k, a, n = zip(*parts) if parts else ((), (), (), ())
            out.append(pa.table([np.full(len(parts), pack, np.int32), np.asarray(bins, np.int64) + (grp << 32), pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int32())], schema=_PACKED_ARROW))
        return pa.concat_tables([_PACKED_ARROW.empty_table(), *out])

    return run


def pack(items: DataFrame, sizes: DataFrame, group: int = GROUP) -> DataFrame:
    """(pack_id, bin, doc_id, piece, start, tokens): every item of (doc_id, tokens) in a container of each capacity.

    ``piece`` numbers the pieces of a split item, ``start`` is the first token
    of a piece.  Repeated rows are items of their own; an empty item takes no
    space; no items give no rows.  ``sizes`` (pack_id, capacity_tokens) must be
    positive; null rows are left out.  However many there are, they are worked
    on in blocks of about CAPACITIES.
    """
    wanted = sizes.where("pack_id is not null and capacity_tokens is not null").select("pack_id", "capacity_tokens").distinct()
    if not wanted.where("capacity_tokens <= 0").isEmpty():
        raise ValueError("capacities must be positive")
    blocks = max(1, -(-wanted.count() // CAPACITIES))
    held = Scratch(items.sparkSession, "packing").cut(items.select("doc_id", "tokens"))
    groups = max(1, -(-held.count() // group))
    # The row number keeps a repeated id from filling one group.
    dealt = held.withColumn("grp", F.pmod(F.xxhash64("doc_id", "tokens", F.monotonically_increasing_id()), F.lit(groups)))
    # A fixed number of partitions: the rows are few bytes but much work, so they must not be coalesced.
    tasks = min(groups, 4 * items.sparkSession.sparkContext.defaultParallelism)
    parts = []
    for b in range(blocks):
        packs = sorted((r.pack_id, r.capacity_tokens) for r in wanted.where(F.pmod(F.xxhash64("pack_id", "capacity_tokens"), F.lit(blocks)) == b).collect())
        parts.append(dealt.repartition(tasks, "grp").groupBy("grp").applyInArrow(_pack(packs), _PACKED))
    return reduce(DataFrame.unionByName, parts)


def audit(packed: DataFrame, sizes: DataFrame, slack: float = 0.05) -> DataFrame:
    """Per capacity: items, containers over it, items split without need, items whose pieces leave gaps, and whether
    the containers are within ``slack`` of the fewest that the tokens need."""
    bins = packed.groupBy("pack_id", "bin").agg(F.sum("tokens").alias("held")).join(F.broadcast(sizes), "pack_id")
    bins = bins.groupBy("pack_id", "capacity_tokens").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull"), F.count("*").alias("_bins"), F.sum("held").alias("_held"))
    items = packed.groupBy("pack_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("size"), F.max(F.col("start") + F.col("tokens")).alias("end")).join(F.broadcast(sizes), "pack_id")
    small = (F.col("pieces") > 1) & (F.col("size") <= F.col("capacity_tokens"))
    items = items.groupBy("pack_id").agg(F.count("*").alias("n_docs"), F.count_if(small).alias("split_small"), F.count_if(F.col("end") != F.col("size")).alias("gaps"))
    near = F.col("_bins") <= (1 + slack) * F.ceil(F.col("_held") / F.col("capacity_tokens")) + 1
    return bins.join(items, "pack_id").select("pack_id", "capacity_tokens", "n_docs", "overfull", "split_small", "gaps", near.alias("near"))


def fill(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Containers, tokens and the share of space used, per capacity."""
    used = packed.groupBy("pack_id", "bin").agg(F.sum("tokens").alias("tokens")).groupBy("pack_id").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"))
    return used.join(sizes, "pack_id").select("pack_id", "capacity_tokens", "bins", "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("filled"))
