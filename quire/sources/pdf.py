"""Files to tables: one Arrow kernel per file, every table from the same parse.

``read`` gives (file_id, path, length, content); ``parse`` gives one of
``TABLES``; ``ingest`` writes all of them in a single pass over the files, laid
out by table, so that later queries prune to the table and columns they need.
A damaged file gives rows in ``diagnostics``, never a failed job.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.kernels import document as D
from quire.kernels import pagelang, report, schema
from quire.kernels.model import TRAILER, Name, Options, PdfError, Place, Real, Ref, Stream, key_text

TABLES: dict[str, str] = {
    "xref_entries": "obj_num INT, obj_gen INT, seq INT, kind STRING, off BIGINT, idx INT",
    "trailers": "ord INT, text STRING",
    "objects": "obj_num INT, obj_gen INT, origin STRING, low BIGINT, high BIGINT, is_stream BOOLEAN, special STRING, text STRING",
    "nodes": "key_kind STRING, obj_num INT, obj_gen INT, node_id INT, parent_id INT, depth INT, path STRING, elem STRING, elem_idx INT, elem_name STRING, "
    "kind STRING, val_bool BOOLEAN, val_int INT, val_real STRING, val_bin BINARY, val_name STRING, ref_num INT, ref_gen INT",
    "streams": "obj_num INT, obj_gen INT, filters ARRAY<STRING>, encoded BINARY, decoded BINARY, decode_error STRING",
    "content_ops": "obj_num INT, obj_gen INT, op_ord INT, op STRING, category STRING, operands ARRAY<STRING>",
    "obj_types": "obj_num INT, obj_gen INT, kind STRING",
    "extents": "low BIGINT, high BIGINT, key STRING",
    "diagnostics": "stage STRING, severity STRING, exc STRING, message STRING, key STRING, path STRING, pos BIGINT",
    "stats": "version INT, encrypted BOOLEAN, updatecount INT, objstm BOOLEAN, free BOOLEAN, objcount INT, filters MAP<STRING, INT>, knowntypes INT, "
    "incompletetypes BOOLEAN, nographerror BOOLEAN, nocontentstreamerror BOOLEAN, producer STRING, creator STRING, creation_date STRING, mod_date STRING, "
    "encrypt_v INT, encrypt_r INT, encrypt_u BINARY, encrypt_o BINARY, encrypt_id BINARY, verify_user BOOLEAN, verify_owner BOOLEAN, first_error STRING, report STRING",
}
_ARROW = {"INT": pa.int32(), "BIGINT": pa.int64(), "STRING": pa.string(), "BOOLEAN": pa.bool_(), "BINARY": pa.binary(), "ARRAY<STRING>": pa.list_(pa.string()), "MAP<STRING, INT>": pa.map_(pa.string(), pa.int32())}
_FIELD = re.compile(r"(\w+) ((?:MAP<[^>]*>|ARRAY<[^>]*>|\w+))")


def _arrow(table: str) -> pa.StructType:
    return pa.struct([(n, _ARROW[t]) for n, t in _FIELD.findall(TABLES[table])])


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_id, path, length, content) of files; ``file_id`` is a hash of the path.

    Files of no bytes are left out by Spark's file scan.  A path that is named
    and isn't there is a row without length and content, which every table
    reads as a file that isn't there: a diagnostic, not a failed job.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    named = [path] if isinstance(path, str) else list(path)

    def there(p: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(p)
        found = at.getFileSystem(conf).globStatus(at)
        return found is not None and (len(found) > 0 or any(c in p for c in "*?[{"))

    good = [p for p in named if there(p)]
    lost = spark.createDataFrame([(p,) for p in named if p not in good], "path STRING").select(F.xxhash64("path").alias("file_id"), "path", F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("binary").alias("content"))
    if not good:
        return lost
    df = spark.read.format("binaryFile").load(good).select(F.xxhash64("path").alias("file_id"), "path", "length", "content")
    return df if len(good) == len(named) else df.unionByName(lost)


# --- rows of one file ----------------------------------------------------------


def _key(key: Any) -> tuple[str, int | None, int | None]:
    return ("object", key.num, key.gen) if isinstance(key, Ref) else (str(key), None, None)


def _value(x: Any) -> dict[str, Any]:
    if x is None:
        return {"kind": "null"}
    if isinstance(x, bool):
        return {"kind": "bool", "val_bool": x}
    if isinstance(x, int):
        return {"kind": "int", "val_int": x}
    if isinstance(x, Real):
        return {"kind": "real", "val_real": str(x)}
    if isinstance(x, Name):
        return {"kind": "name", "val_name": str(x)}
    if isinstance(x, Ref):
        return {"kind": "ref", "ref_num": x.num, "ref_gen": x.gen}
    if isinstance(x, bytes):
        return {"kind": "string", "val_bin": x}
    return {"kind": "array" if isinstance(x, list) else "dict"}


def nodes_of(key: Any, x: Any) -> Iterator[dict[str, Any]]:
    """Nodes in pre-order, keys sorted; parents come before children."""
    kind, num, gen = _key(key)
    stack = [(x.dict if isinstance(x, Stream) else x, -1, 0, "", "root", None, None)]
    n = 0
    while stack:
        v, parent, depth, path, elem, idx, name = stack.pop()
        yield {"key_kind": kind, "obj_num": num, "obj_gen": gen, "node_id": n, "parent_id": parent, "depth": depth, "path": path, "elem": elem, "elem_idx": idx, "elem_name": name} | _value(v)
        if isinstance(v, dict):
            stack += [(w, n, depth + 1, f"{path}/{k}", "name", None, k) for k, w in sorted(v.items(), reverse=True)]
        elif isinstance(v, list):
            stack += [(w, n, depth + 1, f"{path}[{i}]", "index", i, None) for i, w in reversed(list(enumerate(v)))]
        n += 1


def _diagnostic(stage: str, e: PdfError) -> dict[str, Any]:
    p = e.place
    return {"stage": stage, "severity": "error", "exc": e.kind.replace(" ", ""), "message": e.message, "key": None if p.key is None else key_text(p.key), "path": p.path or None, "pos": p.offset}


def rows_of(doc: D.Document, table: str, types: schema.Registry | None = None) -> Iterable[dict[str, Any]]:
    """The rows of one table for one file."""
    if table == "xref_entries":
        for ref, entries in sorted(doc.xref.items()):
            for seq, e in enumerate(entries):
                yield {"obj_num": ref.num, "obj_gen": ref.gen, "seq": seq, "kind": e.kind, "off": e.off, "idx": e.idx}
    elif table == "trailers":
        for i, t in enumerate(doc.trailers):
            yield {"ord": i, "text": report.pretty(t)}
    elif table == "objects":
        where = {k: (low, high) for low, high, k in doc.extents if isinstance(k, Ref)}
        for ref, x in sorted(doc.objects.items()):
            low, high = where.get(ref, (None, None))
            yield {"obj_num": ref.num, "obj_gen": ref.gen, "origin": doc.origin.get(ref), "low": low, "high": high, "is_stream": isinstance(x, Stream), "special": doc.special.get(ref), "text": report.pretty(x)}
    elif table == "nodes":
        for key, x in doc.all():
            yield from nodes_of(key, x)
    elif table == "streams":
        for ref, s in sorted(doc.objects.items()):
            if isinstance(s, Stream):
                f = s.dict.get("Filter")
                row = {"obj_num": ref.num, "obj_gen": ref.gen, "filters": [str(x) for x in (f if isinstance(f, list) else [f]) if x is not None], "encoded": s.raw}
                try:
                    row["decoded"] = s.data if s.data is not None else D.decode_stream(s, Place(ref), doc.options)
                except PdfError as e:
                    row["decode_error"] = str(e)
                yield row
    elif table == "content_ops":
        for ref, kind in sorted(schema.check(doc, types)[0].items()):
            s = doc.objects.get(ref)
            if kind.tag == "stream" and kind.args[0] in report.CONTENT and isinstance(s, Stream):
                try:
                    ops = pagelang.parse(s.data if s.data is not None else D.decode_stream(s, Place(ref), doc.options), doc.options)
                except PdfError:
                    continue
                for i, op in enumerate(ops):
                    yield {"obj_num": ref.num, "obj_gen": ref.gen, "op_ord": i, "op": op.name, "category": pagelang.CATEGORY[op.name], "operands": [report.pretty(x) for x in op.operands]}
    elif table == "obj_types":
        for ref, kind in sorted(schema.check(doc, types)[0].items()):
            yield {"obj_num": ref.num, "obj_gen": ref.gen, "kind": kind.text()}
    elif table == "extents":
        for low, high, key in sorted(doc.extents, key=lambda e: e[0]):
            yield {"low": low, "high": high, "key": key_text(key)}
    elif table == "diagnostics":
        s = report.stats(doc, types)
        if s.error:
            yield _diagnostic(s.stage, s.error)
        for w in s.warnings:
            yield {"stage": None, "severity": "warning", "message": w}
    elif table == "stats":
        s = report.stats(doc, types)
        text = {k: v.decode("latin-1") for k, v in s.info.items()}
        yield {
            "version": s.version, "encrypted": s.encrypted, "updatecount": s.updates, "objstm": s.has_objstm, "free": s.has_free, "objcount": s.objects, "filters": list(s.filters.items()),
            "knowntypes": s.known, "incompletetypes": s.incomplete, "nographerror": s.graph_ok, "nocontentstreamerror": s.content_ok, "producer": text.get("Producer"), "creator": text.get("Creator"),
            "creation_date": text.get("CreationDate"), "mod_date": text.get("ModDate"), "encrypt_v": s.encrypt.get("V"), "encrypt_r": s.encrypt.get("R"), "encrypt_u": s.encrypt.get("U"),
            "encrypt_o": s.encrypt.get("O"), "encrypt_id": s.first_id, "verify_user": s.user_ok, "verify_owner": s.owner_ok, "first_error": str(s.error) if s.error else None, "report": s.text(),
        }


def _safe(fid: int, content: bytes | None, options: Options, tables: tuple[str, ...], types: schema.Registry | None) -> Iterator[tuple[str, dict[str, Any]]]:
    only = D.STRUCTURE if set(tables) <= {"xref_entries", "trailers"} else None
    doc = D.load(content or b"", Options(**{k: v for k, v in vars(options).items() if k != "warnings"}), only)
    if content is None:
        doc.errors = [PdfError("No such file")]
    for t in tables:
        yield from ((t, row) for row in rows_of(doc, t, types))


_FLUSH_ROWS, _FLUSH_BYTES = 4096, 8 << 20


def _kernel(tables: tuple[str, ...], options: Options, rules: str | None, tagged: bool):
    structs = {t: _arrow(t) for t in tables}
    if tagged:
        out_schema = pa.schema([("file_id", pa.int64()), ("tbl", pa.string()), *((t, s) for t, s in structs.items())])
    else:
        out_schema = pa.schema([("file_id", pa.int64()), *((f.name, f.type) for f in structs[tables[0]])])

    def build(held: list[tuple[int, str, dict]]) -> pa.RecordBatch:
        ids = pa.array([h[0] for h in held], pa.int64())
        if not tagged:
            cols = [pa.array([h[2].get(f.name) for h in held], f.type) for f in structs[tables[0]]]
            return pa.RecordBatch.from_arrays([ids, *cols], schema=out_schema)
        cols = [pa.array([h[2] if h[1] == t else None for h in held], s) for t, s in structs.items()]
        return pa.RecordBatch.from_arrays([ids, pa.array([h[1] for h in held]), *cols], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = schema.registry(rules)
        held: list[tuple[int, str, dict]] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                fid, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for t, row in _safe(fid, content, options, tables, types):
                    held.append((fid, t, row))
                    size += len(row.get("encoded") or b"") + len(row.get("decoded") or b"") + len(row.get("text") or "")
                    if len(held) >= _FLUSH_ROWS or size > _FLUSH_BYTES:
                        yield build(held)
                        held, size = [], 0
        if held:
            yield build(held)

    return run


def parse(files: DataFrame, table: str, options: Options | None = None, rules: str | None = None) -> DataFrame:
    """One table of the files; only its rows are built.

    A null content is a file that isn't there, an empty one no file of the
    format: both have a ``stats`` row and a diagnostic but no objects.
    """
    ddl = f"file_id BIGINT, {TABLES[table]}"
    return files.select(F.col("file_id").cast("bigint"), "content").mapInArrow(_kernel((table,), options or Options(), rules, False), ddl)


def ingest(files: DataFrame, out: str, options: Options | None = None, rules: str | None = None, tables: tuple[str, ...] = tuple(TABLES)) -> None:
    """All tables in one pass over the files, as Parquet partitioned by table."""
    ddl = "file_id BIGINT, tbl STRING, " + ", ".join(f"{t} STRUCT<{', '.join(f'{n}: {k}' for n, k in _FIELD.findall(TABLES[t]))}>" for t in tables)
    rows = files.select(F.col("file_id").cast("bigint"), "content").mapInArrow(_kernel(tables, options or Options(), rules, True), ddl)
    rows.write.mode("overwrite").partitionBy("tbl").parquet(out)


def stored(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table that ``ingest`` wrote; partition and column pruning reach its files."""
    return spark.read.parquet(out).where(F.col("tbl") == table).select("file_id", f"{table}.*")
