"""Objects against the classes of the type registry, by the keys of their dictionaries.

A class is known by its ``Type``.  Its mandatory keys are its own and those it
includes; keys it may hold are these and those of every class built on it.
The rules are a table bounded by the registry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.kernels import schema
from quire.operators import shred


def _up(reg: schema.Registry, name: str) -> set[str]:
    return {name}.union(*(_up(reg, i) for i in reg.classes[name].includes))


def rule_rows(text: str | None = None) -> list[tuple[str, str, str, bool]]:
    """(type, class, key, mandatory) for each type that one class declares."""
    reg = schema.registry(text)
    declares: dict[str, list[str]] = {}
    for name, c in reg.classes.items():
        kind = c.entries.get("Type", (None, True))[0]
        if kind and kind.tag == "name_is":
            declares.setdefault(kind.args[0], []).append(name)
    out = set()
    for type_name, names in declares.items():
        if len(names) != 1:
            continue
        base = names[0]
        above = _up(reg, base)
        built = {n for n in reg.classes if base in _up(reg, n)}
        for name in above | set().union(*(_up(reg, n) for n in built)):
            for key, (_, optional) in reg.classes[name].entries.items():
                out.add((type_name, base, key, name in above and not optional))
    # A key that is mandatory in one of them is.
    return sorted({r for r in out if r[3] or (*r[:3], True) not in out})


def rules(spark: SparkSession, text: str | None = None) -> DataFrame:
    return spark.createDataFrame(rule_rows(text), "type STRING, class STRING, key STRING, mandatory BOOLEAN")


def typed(objects: DataFrame) -> DataFrame:
    """(object_id, type, keys) of each dictionary that names its type; keys with a null value don't count."""
    g = shred.grouped(objects).where("parent_group = '' and ord >= 0")
    entries = F.filter("entries", lambda e: e["elem_name"].isNotNull() & (e["kind"] != "null"))
    kind = F.element_at(F.filter(entries, lambda e: (e["elem_name"] == "Type") & (e["kind"] == "name")), -1)["value"]
    # An empty array has no last element; it gives null instead of an error.
    held = F.size(F.filter(entries, lambda e: (e["elem_name"] == "Type") & (e["kind"] == "name"))) > 0
    rows = g.select("object_id", F.when(held, kind).alias("type"), F.array_distinct(F.transform(entries, lambda e: e["elem_name"])).alias("keys"))
    return rows.where("type is not null")


def missing(objects: DataFrame, text: str | None = None) -> DataFrame:
    """(object_id, class, key): the mandatory keys that objects lack, each once."""
    must = F.broadcast(rules(objects.sparkSession, text).where("mandatory").groupBy("type", "class").agg(F.array_sort(F.collect_set("key")).alias("must")))
    rows = typed(objects).join(must, "type")
    return rows.select("object_id", "class", F.explode(F.array_except("must", "keys")).alias("key")).distinct()


def unexpected(objects: DataFrame, text: str | None = None) -> DataFrame:
    """(class, key, n_objects): keys that no class of their type knows, with the number of objects that use them."""
    may = F.broadcast(rules(objects.sparkSession, text).groupBy("type", "class").agg(F.collect_set("key").alias("may")))
    rows = typed(objects).join(may, "type")
    odd = rows.select("object_id", "class", F.explode(F.array_except("keys", "may")).alias("key")).distinct()
    return odd.groupBy("class", "key").agg(F.count("*").alias("n_objects"))
