"""Names in their source form: ``#xx`` stands for the character with that code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unescape(c: Column) -> Column:
    """A name with each ``#xx`` replaced by the character with that code; runs in the JVM."""
    parts = F.split(c, "#(?=[0-9A-Fa-f]{2})", -1)
    rest = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.concat(F.chr(F.conv(F.substring(p, 1, 2), 16, 10).cast("bigint")), F.substring(p, 3, 1 << 30)),
    )
    return F.when(F.instr(c, "#") == 0, c).otherwise(F.concat(parts[0], F.array_join(rest, "")))


def unescape_sql(expr: str) -> str:
    """The same as SQL text."""
    return f"""CASE WHEN contains({expr}, '#') THEN coalesce(list_aggregate(list_transform(regexp_extract_all({expr}, '#[0-9A-Fa-f]{{2}}|[^#]+|#'),
    lambda x: CASE WHEN regexp_full_match(x, '#[0-9A-Fa-f]{{2}}') THEN chr(CAST('0x' || substr(x, 2) AS INTEGER)) ELSE x END), 'string_agg', ''), '') ELSE {expr} END"""
