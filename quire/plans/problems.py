"""Queries of the general data-quality problems: p2, p3, p4 and p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.names import unescape_sql
from quire.operators import hierarchy, orphans, rejects, shred
from quire.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(table(spark, d, "xref_lines")).select("line_id").distinct()


def p2_rejected(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(table(spark, d, "xref_lines")).select("line_id", "raw_line", "reason")


def p2_valid(spark: SparkSession, d: str) -> DataFrame:
    return rejects.valid(table(spark, d, "xref_lines")).select("line_id", "file_id", "obj_num", "obj_gen", "kind", "off", "idx", "zero_offset_as_free", "note")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.containers(table(spark, d, "objects")).select("object_id", "path")


def p3_triples(spark: SparkSession, d: str) -> DataFrame:
    return shred.triples(table(spark, d, "objects"), want=("object_id", "ord", "parent_ord", "path", "kind", "value"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return shred.grouped(table(spark, d, "objects"))


def p3_references(spark: SparkSession, d: str) -> DataFrame:
    t = shred.tables(shred.grouped(table(spark, d, "objects"), leaves=False))
    return t["references"].select("object_id", "ord", "parent_ord", "path", "ref_num", "ref_gen")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return shred.groups(_groups(spark, d))


def p3_outline_table(spark: SparkSession, d: str) -> DataFrame:
    """The top-level dictionaries as one wide table over the keys of outline items."""
    keys = ["Title", "Parent", "Prev", "Next", "First", "Last", "Count"]
    return shred.pivot(_groups(spark, d), "", keys).where("k_Title is not null")


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every group as a table: its rows with all keys they hold, sorted, a line each."""
    lines = F.transform(F.array_sort(F.map_keys("cells")), lambda k: F.concat(k, F.lit(" "), F.col("cells")[k]))
    return shred.pivots(_groups(spark, d)).select("parent_group", "object_id", "ord", F.array_join(lines, "\n").alias("cells"))


def p3_dictionaries(spark: SparkSession, d: str) -> DataFrame:
    return shred.tables(_groups(spark, d))["dictionaries"]


def p3_arrays(spark: SparkSession, d: str) -> DataFrame:
    return shred.tables(_groups(spark, d))["arrays"]


def p3_entries(spark: SparkSession, d: str) -> DataFrame:
    return shred.tables(_groups(spark, d))["entries"]


def p3_elements(spark: SparkSession, d: str) -> DataFrame:
    return shred.tables(_groups(spark, d))["elements"]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*(table(spark, d, t) for t in ("object_refs", "streams", "objects", "xref_entries", "run_params")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "row_id").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(_orphans(spark, d))


def _forest(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.decompose(hierarchy.links(table(spark, d, "tree_links")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    h = _forest(spark, d)
    none = F.lit(-1)
    return h.select(
        F.col("grp").alias("file_id"), hierarchy.number("node").alias("obj_num"), hierarchy.generation("node").alias("obj_gen"),
        F.coalesce(hierarchy.number("root"), none).alias("root_num"), F.coalesce(hierarchy.generation("root"), none).alias("root_gen"),
    )


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.paths(_forest(spark, d))
    text = F.array_join(F.transform("path", lambda k: F.concat_ws("_", F.shiftright(k, 32), k.bitwiseAND(F.lit((1 << 32) - 1)))), "/")
    return h.select(
        F.col("grp").alias("file_id"), hierarchy.number("node").alias("obj_num"), hierarchy.generation("node").alias("obj_gen"),
        "depth", (F.col("size") - 1).alias("n_descendants"), text.alias("path"),
    )


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of each node as an interval: those of its tree whose ``number`` lies between first and last, none if last < first."""
    h = _forest(spark, d).where("root is not null")
    return h.select(
        F.col("grp").alias("file_id"), hierarchy.number("node").alias("obj_num"), hierarchy.generation("node").alias("obj_gen"),
        hierarchy.number("root").alias("root_num"), hierarchy.generation("root").alias("root_gen"), F.col("pre").alias("number"),
        (F.col("pre") + 1).alias("first"), (F.col("pre") + F.col("size") - 1).alias("last"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_rejected, p2_valid, p3_found, p3_triples, p3_references, p3_groups, p3_outline_table,
        p3_tables, p3_dictionaries, p3_arrays, p3_entries, p3_elements,
        p4_found, p4_report, p5_found, p5_paths, p5_descendants,
    )
}

_N = '("[0-9]+"|[0-9]+)'
_LINE = (
    f"(?s){_N},{_N},{_N},(\"free\"|\"inuse\"|\"compressed\"|free|inuse|compressed),{_N},(\"[0-9]*\"|[0-9]*),"
    "(\"true\"|\"false\"|true|false),(\"(?:[^\"]|\"\")*\"|[^\",\\r\\n]*)"
)
_LINES = f"""
l AS (SELECT line_id, raw_line, regexp_full_match(raw_line, '{_LINE}') AS shaped,
        regexp_extract(raw_line, '{_LINE}', ['file_id','obj_num','obj_gen','kind','off','idx','zero','note']) AS f FROM xref_lines),
v AS (SELECT line_id, TRY_CAST(trim(f.file_id, '"') AS BIGINT) AS file_id, TRY_CAST(trim(f.obj_num, '"') AS HUGEINT) AS obj_num,
        TRY_CAST(trim(f.obj_gen, '"') AS HUGEINT) AS obj_gen, trim(f.kind, '"') AS kind, TRY_CAST(trim(f.off, '"') AS HUGEINT) AS off,
        trim(f.idx, '"') AS idx, trim(f.zero, '"') AS zero, f.note AS note FROM l WHERE shaped),
ok AS (SELECT * FROM v WHERE obj_num <= 2147483647 AND off <= 2147483647 AND obj_gen <= 65535
        AND CASE WHEN kind = 'compressed' THEN idx <> '' ELSE idx = '' END AND NOT (kind = 'inuse' AND off = 0 AND zero <> 'true'))"""

_REFS = """
r AS (SELECT 'object_refs' AS src_table, ref_id AS row_id, file_id, ref_num AS n, ref_gen AS g, seen_at FROM object_refs
      UNION ALL SELECT 'streams', stream_id, file_id, length_num, length_gen, seen_at FROM streams),
o AS (SELECT file_id, obj_num, obj_gen, min(loaded_at) AS first FROM objects GROUP BY ALL),
x AS (SELECT DISTINCT file_id, obj_num, obj_gen FROM xref_entries WHERE seq = 0 AND kind = 'free'),
q AS (SELECT r.*, CASE WHEN x.file_id IS NOT NULL THEN 'freed' WHEN o.first IS NULL THEN 'undefined'
        WHEN r.seen_at IS NULL OR o.first > r.seen_at THEN 'late' END AS reason
      FROM r LEFT JOIN o ON o.file_id = r.file_id AND o.obj_num = r.n AND o.obj_gen = r.g
      LEFT JOIN x ON x.file_id = r.file_id AND x.obj_num = r.n AND x.obj_gen = r.g
      WHERE r.n IS NOT NULL AND r.g IS NOT NULL
        AND r.file_id NOT IN (SELECT file_id FROM run_params WHERE undefined_ref_as_null AND file_id IS NOT NULL))"""

_TREE = """
k AS (SELECT file_id, link_id, loaded_at, CAST(regexp_extract(node_key, '[0-9]+') AS BIGINT) AS n,
        CAST(coalesce(nullif(regexp_extract(node_key, '[0-9]+[^0-9]+([0-9]+)', 1), ''), '0') AS BIGINT) AS g,
        TRY_CAST(nullif(regexp_extract(parent_ref, '[0-9]+'), '') AS BIGINT) AS pn,
        TRY_CAST(nullif(regexp_extract(parent_ref, '[0-9]+[^0-9]+([0-9]+)', 1), '') AS BIGINT) AS pg FROM tree_links),
t AS (SELECT file_id, n, g, pn, pg FROM (SELECT *, row_number() OVER (PARTITION BY file_id, n, g ORDER BY loaded_at DESC, link_id DESC) AS rn FROM k) WHERE rn = 1),
e AS (SELECT t.file_id, t.n, t.g, p.n AS pn, p.g AS pg FROM t LEFT JOIN t p ON p.file_id = t.file_id AND p.n = t.pn AND p.g = t.pg)"""

# Tokens of a literal, each with its container, the place in it and, by recursion, its path.
_REG = "\\x00\\t\\n\\x0c\\r ()<>\\[\\]{}/%"
_GAP = "(?:[\\x00\\t\\n\\x0c\\r ]|%[^\\r\\n]*[\\r\\n])+"
_INNER = "[^()\\\\]|\\\\."
_TOKENS = (
    f"(?s)%[^\\r\\n]*|/[^{_REG}]*|[0-9]+{_GAP}[0-9]+{_GAP}R\\b|<<|>>|\\[|\\]|<[^<>]*>"
    f"|\\((?:{_INNER}|\\((?:{_INNER}|\\((?:{_INNER})*\\))*\\))*\\)|[^{_REG}]+"
)
NODES = f"""
l AS (SELECT object_id, literal, row_number() OVER () AS lit FROM (SELECT DISTINCT object_id, literal FROM objects WHERE literal IS NOT NULL)),
x AS (SELECT object_id, lit, list_filter(regexp_extract_all(literal, '{_TOKENS}'), lambda t: t NOT LIKE '\\%%' ESCAPE '\\') AS ts FROM l),
k AS (SELECT object_id, lit, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM x),
v AS (SELECT *, sum(CASE WHEN t IN ('<<', '[') THEN 1 WHEN t IN ('>>', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY lit ORDER BY i) - CASE WHEN t IN ('<<', '[') THEN 1 ELSE 0 END AS lev FROM k),
o AS (SELECT lit, i, lev + 1 AS lev, t FROM v WHERE t IN ('<<', '[')),
q AS (SELECT v.*, o.i AS pi, o.t AS pt FROM (SELECT * FROM v WHERE t NOT IN ('>>', ']')) v ASOF LEFT JOIN o ON o.lit = v.lit AND o.lev = v.lev AND v.i > o.i),
c AS (SELECT *, row_number() OVER (PARTITION BY lit, pi ORDER BY i) - 1 AS place FROM q),
e AS (SELECT *, lag(t) OVER (PARTITION BY lit, pi ORDER BY i) AS before FROM c),
n AS (SELECT object_id, lit, i, pi, t, CASE WHEN pt = '<<' THEN {unescape_sql("substr(before, 2)")} END AS elem_name, CASE WHEN pt = '[' THEN CAST(place AS INTEGER) END AS elem_idx,
      CAST(row_number() OVER (PARTITION BY lit ORDER BY i) - 1 AS INTEGER) AS ord FROM e WHERE pt IS DISTINCT FROM '<<' OR place % 2 = 1),
w AS (SELECT n.*, '' AS path, '' AS group_path, '' AS parent_group, CAST(-1 AS INTEGER) AS parent_ord FROM n WHERE pi IS NULL UNION ALL
      SELECT n.*, w.path || coalesce('/' || n.elem_name, '[' || n.elem_idx || ']'), w.group_path || coalesce('/' || n.elem_name, '[]'), w.group_path, w.ord FROM w JOIN n ON n.lit = w.lit AND n.pi = w.i),
nodes AS (SELECT object_id, lit, ord, parent_ord, path, group_path, parent_group, elem_idx, elem_name,
      CASE WHEN t = '<<' THEN 'dict' WHEN t = '[' THEN 'array' WHEN t LIKE '/%' THEN 'name' WHEN t LIKE '(%' THEN 'string' WHEN t LIKE '<%' THEN 'hex' WHEN regexp_full_match(t, '[0-9]+{_GAP}[0-9]+{_GAP}R') THEN 'ref'
        WHEN t = 'null' THEN 'null' WHEN t IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN 'int' WHEN regexp_full_match(t, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN 'real' ELSE 'word' END AS kind,
      CASE WHEN t IN ('<<', '[') THEN NULL WHEN t LIKE '/%' THEN {unescape_sql("substr(t, 2)")} WHEN t LIKE '(%' OR t LIKE '<%' THEN substr(t, 2, length(t) - 2)
        WHEN regexp_full_match(t, '[0-9]+{_GAP}[0-9]+{_GAP}R') THEN CAST(regexp_extract(t, '^[0-9]+') AS INTEGER) || ' ' || CAST(regexp_extract(t, '([0-9]+){_GAP}R$', 1) AS INTEGER) ELSE t END AS value FROM w),
cells AS (SELECT object_id, lit, parent_group, parent_ord AS ord, elem_name, arg_max(CASE WHEN kind IN ('dict', 'array') THEN '@' || ord ELSE value END, ord) AS shown FROM nodes WHERE elem_name IS NOT NULL GROUP BY ALL)"""
_AT = "object_id, ord, parent_ord, path, group_path"
_SHRED = f"WITH RECURSIVE {NODES.strip()}"

SQL = {
    "p3_found": f"{_SHRED} SELECT DISTINCT object_id, path FROM nodes WHERE kind IN ('dict', 'array', 'ref') AND path <> ''",
    "p3_triples": f"{_SHRED} SELECT object_id, ord, parent_ord, path, kind, value FROM nodes",
    "p3_references": f"{_SHRED} SELECT object_id, ord, parent_ord, path, CAST(split_part(value, ' ', 1) AS INTEGER) AS ref_num, CAST(split_part(value, ' ', 2) AS INTEGER) AS ref_gen FROM nodes WHERE kind = 'ref'",
    "p3_dictionaries": f"{_SHRED} SELECT {_AT} FROM nodes WHERE kind = 'dict'",
    "p3_arrays": f"{_SHRED} SELECT {_AT} FROM nodes WHERE kind = 'array'",
    "p3_entries": f"{_SHRED} SELECT {_AT}, elem_name, kind, value FROM nodes WHERE elem_name IS NOT NULL",
    "p3_elements": f"{_SHRED} SELECT {_AT}, elem_idx, kind, value FROM nodes WHERE elem_idx IS NOT NULL",
    "p3_groups": f"{_SHRED} SELECT parent_group, elem_name, count(DISTINCT (lit, parent_ord)) AS n_dicts FROM nodes WHERE elem_name IS NOT NULL GROUP BY ALL",
    "p3_tables": f"{_SHRED} SELECT parent_group, object_id, ord, string_agg(elem_name || ' ' || shown, chr(10) ORDER BY elem_name) AS cells FROM cells GROUP BY parent_group, object_id, lit, ord",
    "p3_outline_table": f"{_SHRED} SELECT object_id, ord, " + ", ".join(f"max(CASE WHEN elem_name = '{k}' THEN shown END) AS k_{k}" for k in ("Title", "Parent", "Prev", "Next", "First", "Last", "Count")) + " FROM cells WHERE parent_group = '' GROUP BY object_id, lit, ord HAVING k_Title IS NOT NULL",
    "p2_found": f"WITH {_LINES.strip()} SELECT DISTINCT line_id FROM xref_lines WHERE line_id NOT IN (SELECT line_id FROM ok)",
    "p2_rejected": """WITH l AS (SELECT line_id, raw_line, regexp_full_match(raw_line, '(?s)("(?:[^"]|"")*"|[^",\\r\\n]*)(,("(?:[^"]|"")*"|[^",\\r\\n]*))*') AS ok,
          list_transform(regexp_extract_all(',' || raw_line, '(?s),("(?:[^"]|"")*"|[^",\\r\\n]*)', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM xref_lines),
        d AS (SELECT *, list_transform(f, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN TRY_CAST(x AS HUGEINT) END) AS n FROM l),
        r AS (SELECT line_id, raw_line, CASE WHEN coalesce(raw_line, '') = '' THEN 'missing' WHEN NOT ok THEN 'quoting' WHEN len(f) <> 8 THEN 'field_count' WHEN NOT regexp_full_match(f[1], '[0-9]+') THEN 'file_id'
          WHEN NOT coalesce(n[2] <= 2147483647, false) THEN 'obj_num' WHEN NOT coalesce(n[3] <= 65535, false) THEN 'obj_gen' WHEN f[4] NOT IN ('free', 'inuse', 'compressed') THEN 'kind'
          WHEN NOT coalesce(n[5] <= 2147483647, false) THEN 'off' WHEN f[4] = 'compressed' AND NOT regexp_full_match(f[6], '[0-9]+') OR f[4] <> 'compressed' AND f[6] <> '' THEN 'idx'
          WHEN f[7] NOT IN ('true', 'false') THEN 'zero_offset_as_free' WHEN f[4] = 'inuse' AND n[5] = 0 AND f[7] <> 'true' THEN 'zero_offset' END AS reason FROM d)
        SELECT line_id, raw_line, reason FROM r WHERE reason IS NOT NULL""",
    "p2_valid": f"""WITH {_LINES.strip()} SELECT line_id, file_id, CAST(obj_num AS INTEGER) AS obj_num, CAST(obj_gen AS INTEGER) AS obj_gen, kind,
        CAST(off AS BIGINT) AS off, TRY_CAST(idx AS BIGINT) AS idx, zero = 'true' AS zero_offset_as_free,
        CASE WHEN note LIKE '"%' THEN replace(substr(note, 2, length(note) - 2), '""', '"') ELSE note END AS note FROM ok""",
    "p4_found": f"WITH {_REFS.strip()} SELECT DISTINCT src_table, row_id FROM q WHERE reason IS NOT NULL",
    "p4_report": f"""WITH {_REFS.strip()} SELECT src_table, strftime(seen_at, '%Y-%m') AS month, reason, count(DISTINCT row_id) AS n_rows
        FROM q WHERE reason IS NOT NULL GROUP BY ALL""",
    "p5_found": f"""WITH RECURSIVE {_TREE.strip()},
        w AS (SELECT file_id, n, g, n AS cn, g AS cg FROM e UNION
              SELECT w.file_id, w.n, w.g, e.pn, e.pg FROM w JOIN e ON e.file_id = w.file_id AND e.n = w.cn AND e.g = w.cg WHERE e.pn IS NOT NULL),
        r AS (SELECT w.file_id, w.n, w.g, w.cn, w.cg FROM w JOIN e ON e.file_id = w.file_id AND e.n = w.cn AND e.g = w.cg WHERE e.pn IS NULL)
        SELECT e.file_id, CAST(e.n AS INTEGER) AS obj_num, CAST(e.g AS INTEGER) AS obj_gen,
          CAST(coalesce(r.cn, -1) AS INTEGER) AS root_num, CAST(coalesce(r.cg, -1) AS INTEGER) AS root_gen
        FROM e LEFT JOIN r ON r.file_id = e.file_id AND r.n = e.n AND r.g = e.g""",
    "p5_paths": f"""WITH RECURSIVE {_TREE.strip()},
        d AS (SELECT file_id, n, g, CAST(0 AS BIGINT) AS depth, n || '_' || g AS path FROM e WHERE pn IS NULL UNION ALL
              SELECT e.file_id, e.n, e.g, d.depth + 1, d.path || '/' || e.n || '_' || e.g FROM d JOIN e ON e.file_id = d.file_id AND e.pn = d.n AND e.pg = d.g),
        s AS (SELECT a.file_id, a.n, a.g, count(*) - 1 AS k FROM d a JOIN d b ON b.file_id = a.file_id AND (b.path = a.path OR starts_with(b.path, a.path || '/')) GROUP BY ALL)
        SELECT e.file_id, CAST(e.n AS INTEGER) AS obj_num, CAST(e.g AS INTEGER) AS obj_gen, d.depth, CAST(s.k AS BIGINT) AS n_descendants, d.path
        FROM e LEFT JOIN d ON d.file_id = e.file_id AND d.n = e.n AND d.g = e.g LEFT JOIN s ON s.file_id = e.file_id AND s.n = e.n AND s.g = e.g""",
    "p5_descendants": f"""WITH RECURSIVE {_TREE.strip()},
        d AS (SELECT file_id, n, g, n AS rn, g AS rg, n || '_' || g AS path FROM e WHERE pn IS NULL UNION ALL
              SELECT e.file_id, e.n, e.g, d.rn, d.rg, d.path || '/' || e.n || '_' || e.g FROM d JOIN e ON e.file_id = d.file_id AND e.pn = d.n AND e.pg = d.g),
        s AS (SELECT a.file_id, a.n, a.g, count(*) AS k FROM d a JOIN d b ON b.file_id = a.file_id AND (b.path = a.path OR starts_with(b.path, a.path || '/')) GROUP BY ALL),
        c AS (SELECT e.*, s.k, row_number() OVER (PARTITION BY file_id, pn, pg ORDER BY s.k DESC, n, g) AS rk FROM e JOIN s USING (file_id, n, g)),
        o AS (SELECT file_id, n, g, k, n AS rn, g AS rg, [[0, n, g]] AS way FROM c WHERE pn IS NULL UNION ALL
              SELECT c.file_id, c.n, c.g, c.k, o.rn, o.rg, list_append(o.way, [CASE c.rk WHEN 1 THEN 0 ELSE 1 END, c.n, c.g]) FROM o JOIN c ON c.file_id = o.file_id AND c.pn = o.n AND c.pg = o.g),
        p AS (SELECT *, row_number() OVER (PARTITION BY file_id, rn, rg ORDER BY way) - 1 AS number FROM o)
        SELECT file_id, CAST(n AS INTEGER) AS obj_num, CAST(g AS INTEGER) AS obj_gen, CAST(rn AS INTEGER) AS root_num, CAST(rg AS INTEGER) AS root_gen, number, number + 1 AS first, number + k - 1 AS last FROM p""",
}
