"""Deeply nested object literals into flat related tables.

Each literal is stream-parsed into path-value-ordinal triples by one Arrow
kernel.  The triples of one container stand together there, so the kernel also
groups them: a row per container, keyed by its repeated ancestor (array indexes
become ``[]``), with its entries.  The rows of one group pivot into a table of
their own without a shuffle, every row tied to its parent and object.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.kernels import literal as L

TRIPLES = (
    "object_id BIGINT, ord INT, parent_ord INT, path STRING, group_path STRING, parent_group STRING, "
    "elem_idx INT, elem_name STRING, kind STRING, value STRING"
)
_ARROW = pa.schema([
    ("object_id", pa.int64()), ("ord", pa.int32()), ("parent_ord", pa.int32()), ("path", pa.string()),
    ("group_path", pa.string()), ("parent_group", pa.string()), ("elem_idx", pa.int32()),
    ("elem_name", pa.string()), ("kind", pa.string()), ("value", pa.string()),
])
GROUPED = "object_id BIGINT, parent_group STRING, ord INT, path STRING, entries ARRAY<STRUCT<ord: INT, elem_idx: INT, elem_name: STRING, kind: STRING, value: STRING>>"
_ENTRY = pa.struct([("ord", pa.int32()), ("elem_idx", pa.int32()), ("elem_name", pa.string()), ("kind", pa.string()), ("value", pa.string())])
_GROUPED_ARROW = pa.schema([("object_id", pa.int64()), ("parent_group", pa.string()), ("ord", pa.int32()), ("path", pa.string()), ("entries", pa.list_(_ENTRY))])
_ROWS, _CHARS = 20_000, 16 << 20
ARRAY_PART = 10_000  # entries of an array in one row; longer arrays have several


def _flush(rows: Iterator[tuple], weigh, build) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    n = chars = 0
    for row in rows:
        held.append(row)
        size, length = weigh(row)
        n, chars = n + size, chars + length
        if n >= _ROWS or chars > _CHARS:
            yield build(held)
            held, n, chars = [], 0, 0
    if held:
        yield build(held)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    for batch in batches:
        for oid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is not None:
                yield oid, text


def _kernel(want: tuple[str, ...], leaves: bool):
    schema = pa.schema([_ARROW.field(c) for c in want])
    places = [_ARROW.get_field_index(c) for c in want]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple((oid, *node)[i] for i in places) for oid, text in _texts(batches) for node in L.nodes(text, leaves))
        at = [i for i, c in enumerate(want) if c in ("path", "value")]
        yield from _flush(rows, lambda r: (1, sum(len(r[i] or "") for i in at)), lambda held: _batch(held, schema))

    return run


def _containers(oid: int, text: str, leaves: bool, part: int) -> Iterator[tuple]:
    """A row per container with its entries, in the order in which the containers begin; the root hangs on container -1."""
    held: dict[int, tuple] = {-1: (oid, "", -1, "", [])}
    for number, parent, path, group, above, index, key, kind, value in L.nodes(text, leaves):
        entries = held[parent][4]
        if index is not None and len(entries) == part:
            yield held[parent]
            held[parent] = (*held[parent][:4], entries := [])
        entries.append((number, index, key, kind, value))
        if kind is L.DICT or kind is L.ARRAY:
            held[number] = (oid, group, number, path, [])
    yield from (row for row in held.values() if row[4])


def _grouper(leaves: bool, part: int):
    def build(held: list[tuple]) -> pa.RecordBatch:
        entries = zip(*(e for row in held for e in row[4]))
        struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(entries, _ENTRY)], fields=list(_ENTRY))
        offsets = pa.array([0, *accumulate(len(row[4]) for row in held)], pa.int32())
        plain = [pa.array(c, f.type) for c, f in zip(zip(*(row[:4] for row in held)), _GROUPED_ARROW)]
        return pa.RecordBatch.from_arrays([*plain, pa.ListArray.from_arrays(offsets, struct)], schema=_GROUPED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for oid, text in _texts(batches) for row in _containers(oid, text, leaves, part))
        yield from _flush(rows, lambda r: (len(r[4]), len(r[3])), build)

    return run


def _once(objects: DataFrame, key: str, text: str, repeats: bool) -> DataFrame:
    rows = objects.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("object_id"), F.col(text).alias("literal"))
    return rows if repeats else rows.distinct()


def triples(
    objects: DataFrame, key: str = "object_id", text: str = "literal",
    want: tuple[str, ...] = tuple(_ARROW.names), leaves: bool = True,
) -> DataFrame:
    """Path-value-ordinal triples of every literal, one row per node in pre-order.

    A redelivered object (same key and text) is parsed once.  Null literals
    give no rows, an empty or blank text none either; a key seen with two
    different texts gives the nodes of both; a null key is kept as a key.
    ``want`` names the output columns, so that what isn't asked for is never
    built; without ``leaves`` only containers and references come out.
    """
    fields = dict(x.split(" ") for x in TRIPLES.split(", "))
    return _once(objects, key, text, False).mapInArrow(_kernel(want, leaves), ", ".join(f"{c} {fields[c]}" for c in want))


def grouped(objects: DataFrame, key: str = "object_id", text: str = "literal", leaves: bool = True, repeats: bool = False, part: int = ARRAY_PART) -> DataFrame:
    """The triples grouped by container: (object_id, parent_group, ord, path, entries).

    ``parent_group`` is the path of the repeated ancestor, ``ord`` and ``path``
    those of the container itself; the root of each literal is the only entry
    of container -1.  An array of more than ``part`` entries has a row
    for each so many.  Nulls and redelivered objects are as in ``triples``;
    with ``repeats`` each delivery is grouped by itself.
    """
    return _once(objects, key, text, repeats).mapInArrow(_grouper(leaves, part), GROUPED)


def _each(g: DataFrame) -> DataFrame:
    """The triples again: a row per entry with its own path and group."""
    rows = g.select("object_id", "parent_group", F.col("ord").alias("parent_ord"), F.col("path").alias("_above"), F.inline("entries"))
    step = F.when(F.col("elem_idx").isNotNull(), F.concat(F.lit("["), F.col("elem_idx"), F.lit("]"))).when(F.col("parent_ord") == -1, "").otherwise(F.concat(F.lit("/"), F.col("elem_name")))
    over = F.when(F.col("elem_idx").isNotNull(), "[]").otherwise(step)
    return rows.withColumn("path", F.concat("_above", step)).withColumn("group_path", F.concat("parent_group", over)).drop("_above")


def containers(objects: DataFrame, **kw: str) -> DataFrame:
    """(object_id, path, kind) of every dictionary, array and reference below the root, each once, from the grouped rows.

    Every delivery of an object is parsed where it lies; repeats fall away with
    equal paths, so no literal is shuffled.
    """
    each = _each(grouped(objects, leaves=False, repeats=True, **kw))
    return each.where(F.col("parent_ord") >= 0).select("object_id", "path", "kind").distinct()


def scalars(objects: DataFrame, keys: list[str], text: str = "literal") -> DataFrame:
    """(keys, kind, value) of the objects that are a number, string, name, boolean or null; each once."""
    at = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    few = objects.where(~F.col(text).rlike(r"\A[\x00\t\n\x0c\r ]*(?:<<|\[)")).select(*at, F.xxhash64(*keys, text).alias("_id"), F.col(text).alias("_text")).distinct()
    g = _each(grouped(few, "_id", "_text")).where("parent_ord = -1 and kind not in ('dict', 'array', 'ref', 'word')").select(F.col("object_id").alias("_id"), "kind", "value")
    return few.join(g, "_id").select(*[F.col(f"_{i}").alias(k) for i, k in enumerate(keys)], "kind", "value").distinct()


def tables(g: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of ``grouped``: dictionaries, arrays, entries, elements, references.

    Rows are tied by (object_id, ord) to their own node and by (object_id,
    parent_ord) to the container that holds them.
    """
    at = ["object_id", "ord", "parent_ord", "path", "group_path"]
    parts = F.split("value", " ")
    t = _each(g)
    return {
        "dictionaries": t.where("kind = 'dict'").select(*at),
        "arrays": t.where("kind = 'array'").select(*at),
        "entries": t.where("elem_name is not null").select(*at, "elem_name", "kind", "value"),
        "elements": t.where("elem_idx is not null").select(*at, "elem_idx", "kind", "value"),
        "references": t.where("kind = 'ref'").select(*at, parts[0].cast("int").alias("ref_num"), parts[1].cast("int").alias("ref_gen")),
    }


def groups(g: DataFrame) -> DataFrame:
    """(parent_group, elem_name, n_dicts): the keys of each repeated ancestor with the dictionaries that use them, a row per key."""
    keys = g.select("parent_group", F.explode(F.array_distinct(F.transform("entries", lambda e: e["elem_name"]))).alias("elem_name"))
    return keys.where("elem_name is not null").groupBy("parent_group", "elem_name").agg(F.count("*").alias("n_dicts"))


def pivots(g: DataFrame) -> DataFrame:
    """Every repeated ancestor as a table: (parent_group, object_id, ord, cells), a row per dictionary with a map of all its keys.

    The rows of one group are its table; its columns are the keys of
    ``groups``.  Of a key given twice the last wins; a container is shown as
    its ordinal, so it can be joined to its own table.
    """
    shown = lambda e: F.when(e["kind"].isin("dict", "array"), F.concat(F.lit("@"), e["ord"])).otherwise(e["value"])
    rows = g.where((F.col("ord") >= 0) & F.col("entries")[0]["elem_name"].isNotNull())
    # A key's last entry is the one whose name doesn't come again behind it; only repeated keys need the search.
    names = F.transform("entries", lambda e: e["elem_name"])
    last = F.filter("entries", lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["elem_name"]))
    kept = F.when(F.size(F.array_distinct(names)) == F.size(names), F.col("entries")).otherwise(last)
    cells = F.map_from_entries(F.transform(kept, lambda e: F.struct(e["elem_name"], shown(e))))
    return rows.select("parent_group", "object_id", "ord", cells.alias("cells"))


def pivot(g: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """One repeated ancestor as a table: a row per dictionary, a column per key.

    A missing entry is null.  Key names may clash with the link columns, so
    value columns are called ``k_<key>``.
    """
    return pivots(g).where(F.col("parent_group") == group).select("object_id", "ord", *[F.try_element_at("cells", F.lit(k)).alias(f"k_{k}") for k in keys])
