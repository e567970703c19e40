"""Values of dictionaries and arrays by key, with the type they must have, over the grouped rows of literals.

A key that isn't there and one with a null value are the same: no entry.  Of a
key given twice the last entry counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The kinds of a literal that a getter takes, and how it names them.
KINDS = {
    "integer": ("int",), "number": ("int", "real"), "name": ("name",), "string": ("string", "hex"), "boolean": ("bool",),
    "dictionary": ("dict",), "array": ("array",), "reference": ("ref",),
}


def dictionaries(g: DataFrame) -> DataFrame:
    """(object_id, entries) of the dictionaries that are objects themselves, entries without nulls and repeats."""
    rows = g.where("parent_group = '' and ord = 0").where(F.col("entries")[0]["elem_name"].isNotNull())
    names = F.transform("entries", lambda e: e["elem_name"])
    last = F.filter("entries", lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["elem_name"]))
    return rows.select("object_id", F.filter(last, lambda e: e["kind"] != "null").alias("entries"))


def find(key: str) -> Column:
    """The entry of a key of ``dictionaries``, or null."""
    return F.get(F.filter("entries", lambda e: e["elem_name"] == key), F.lit(0))


def lengths(d: DataFrame) -> DataFrame:
    """(object_id, n_entries) of each dictionary."""
    return d.select("object_id", F.size("entries").alias("n_entries"))


def holding(d: DataFrame, key: str) -> DataFrame:
    """(object_id) of the dictionaries that hold a key."""
    return d.where(find(key).isNotNull()).select("object_id")


def typed(d: DataFrame, key: str, kind: str) -> DataFrame:
    """(object_id, value, error) of each dictionary with an entry of the key: its value, or an error where it isn't of the kind."""
    e = find(key)
    fits = e["kind"].isin(*KINDS[kind])
    rows = d.where(e.isNotNull())
    return rows.select("object_id", F.when(fits, e["value"]).alias("value"), F.when(~fits, F.lit(f"Expected {kind} at entry /{key}")).alias("error"))


def arrays_of(g: DataFrame, key: str, kind: str, size: int | None = None) -> DataFrame:
    """(object_id, path, n, values, error) of each array at a key: its values in order, or an error where one isn't of the kind or their number is wrong.

    An array of so many entries that it has several rows is put together again.
    """
    rows = g.where(F.col("parent_group").endswith(f"/{key}") & F.col("entries")[0]["elem_idx"].isNotNull())
    whole = rows.groupBy("object_id", "path", "ord").agg(F.array_sort(F.flatten(F.collect_list("entries"))).alias("entries"))
    fits = F.forall("entries", lambda e: e["kind"].isin(*KINDS[kind]))
    n = F.size("entries")
    error = F.when(~fits, F.lit(f"Expected array of {kind}s")).when(n != F.lit(size), F.lit(f"Expected array of size {size}")) if size else F.when(~fits, F.lit(f"Expected array of {kind}s"))
    return whole.select("object_id", "path", n.alias("n"), F.when(error.isNull(), F.array_join(F.transform("entries", lambda e: e["value"]), " ")).alias("values"), error.alias("error"))


def fold(d: DataFrame) -> DataFrame:
    """(key, kind, n_objects): how often each key has a value of each kind."""
    return d.select("object_id", F.explode("entries").alias("e")).groupBy(F.col("e.elem_name").alias("key"), F.col("e.kind").alias("kind")).agg(F.count("*").alias("n_objects"))
