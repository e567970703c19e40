"""Joins and groupings that stay balanced when one key holds much of a table.

The rule used throughout: a key is *heavy* when it holds at least ``1/limit``
of the rows, so there are never more than ``limit`` heavy keys.  Rows of heavy
keys meet a broadcast of at most ``limit`` rows of fixed width or are dealt
over several join groups; all others are shuffled, and no shuffled key can then hold more than ``1/limit`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HEAVY_LIMIT = 128


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def heavy_keys(counts: DataFrame, keys: list[str], n: str = "n", limit: int = HEAVY_LIMIT) -> DataFrame:
    """The at most ``limit`` keys that hold 1/limit of ``sum(n)`` or more.

    ``counts`` has one row per key with its number of rows; null keys never
    match anything and are no candidates.
    """
    total = counts.agg(F.sum(n)).scalar()
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return counts.where(cond).orderBy(F.desc(n)).limit(limit).where(F.col(n) * limit >= total).select(*keys)


def unique_lookup(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """Inner join of ``left`` to ``right``, which has at most one row per key.

    ``heavy`` bounds what is broadcast: at most one row of ``right`` for each
    of its keys.
    """
    hot = F.broadcast(heavy)
    hot_right = F.broadcast(right.join(hot, keys, "left_semi"))
    light_left = left.join(hot, keys, "left_anti")
    light_right = right.join(hot, keys, "left_anti")
    return left.join(hot_right, keys, "inner").unionByName(light_left.join(light_right, keys, "inner"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame, salts: int = 16) -> DataFrame:
    """Inner join in which nothing is broadcast but the keys of ``heavy``.

    The rows of ``left`` of one heavy key are dealt over ``salts`` join groups
    and the rows of ``right`` of that key are sent to each, so it may hold wide
    rows or several.
    """
    hot = F.broadcast(heavy)
    hot_left = left.join(hot, keys, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    hot_right = right.join(hot, keys, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    light = left.join(hot, keys, "left_anti").join(right.join(hot, keys, "left_anti"), keys)
    return hot_left.join(hot_right, [*keys, "_salt"]).drop("_salt").unionByName(light)


def salted_filter(left: DataFrame, right: DataFrame, key: str, salt: Column, how: str, salts: int = 16) -> DataFrame:
    """Rows of ``left`` whose ``key`` is in ``right`` ("left_semi") or isn't ("left_anti").

    ``right`` holds unique keys and nothing else.  The rows of one key of
    ``left`` are spread over ``salts`` join groups by ``salt``, so a key that
    holds a third of ``left`` is worked on by many tasks.
    """
    right = right.select(key, F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_salt"))
    return left.withColumn("_salt", F.pmod(F.hash(salt), F.lit(salts))).join(right, [key, "_salt"], how).drop("_salt")
