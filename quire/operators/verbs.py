"""The verbs on a DataFrame of files: each answers for the whole collection at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.kernels import codecs, document, report, schema
from quire.kernels.model import Options, PdfError, Ref
from quire.operators import graph
from quire.session import Scratch
from quire.sources import pdf

_NO_WARN = {"warnings"}
_FLUSH_ROWS, _FLUSH_BYTES = 1024, 8 << 20


def _texts(files: DataFrame, make, options: Options | None, kind: str = "STRING", only: Ref | str | None = None) -> DataFrame:
    """(file_id, value, error) with ``make(document)`` of each file."""
    base = {k: v for k, v in vars(options or Options()).items() if k not in _NO_WARN}
    arrow = pa.string() if kind == "STRING" else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, values, errors = zip(*held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, arrow), pa.array(errors, pa.string())], names=["file_id", "value", "error"])

        for batch in batches:
            for i in range(batch.num_rows):
                doc = document.load(batch.column(1)[i].as_py() or b"", Options(**base), only)
                value, error = None, str(doc.errors[0]) if doc.errors else None
                if not error:
                    try:
                        value = make(doc)
                    except (PdfError, codecs.CodecError) as e:
                        error = str(e)
                held.append((batch.column(0)[i].as_py(), value, error))
                size += len(value or "")
                if len(held) >= _FLUSH_ROWS or size > _FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return files.select(F.col("file_id").cast("bigint"), "content").mapInArrow(run, f"file_id BIGINT, value {kind}, error STRING")


def xref(files: DataFrame, options: Options | None = None) -> DataFrame:
    """The cross-reference report of each file; objects aren't read for it."""
    return _texts(files, report.xref_text, options, only=document.STRUCTURE)


def stats(files: DataFrame, options: Options | None = None) -> DataFrame:
    """One row of statistics per file, with the text report and the first error."""
    return pdf.parse(files, "stats", options)


def trailers(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Each trailer of each file, the newest as 0 in ``ord``."""
    return pdf.parse(files, "trailers", options)


def extract(files: DataFrame, options: Options | None = None) -> DataFrame:
    """The dump of trailers and objects of each file."""
    return _texts(files, report.dump_text, options)


def dot(files: DataFrame, options: Options | None = None, typed: bool = False) -> DataFrame:
    return _texts(files, lambda d: report.dot_text(d, schema.checked(d) if typed else None), options)


def visjs(files: DataFrame, options: Options | None = None) -> DataFrame:
    return _texts(files, report.visjs_text, options)


def locations(files: DataFrame, options: Options | None = None) -> DataFrame:
    return _texts(files, report.layout_text, options)


def holes(files: DataFrame, options: Options | None = None) -> DataFrame:
    return _texts(files, lambda d: report.layout_text(d, holes_only=True), options)


def types(files: DataFrame, options: Options | None = None) -> DataFrame:
    """The type report of each file."""
    return _texts(files, lambda d: schema.dump(schema.checked(d), len(d.objects)), options)


def type_registry(spark: SparkSession, rules: str | None = None) -> dict[str, DataFrame]:
    """The registry as tables: classes, includes, entries, aliases."""
    reg = schema.registry(rules)
    return {
        "classes": spark.createDataFrame([(n, not c.lenient) for n, c in sorted(reg.classes.items())], "class STRING, strict BOOLEAN"),
        "includes": spark.createDataFrame([(n, i) for n, c in sorted(reg.classes.items()) for i in c.includes], "class STRING, included STRING"),
        "entries": spark.createDataFrame([(n, k, str(t), o) for n, c in sorted(reg.classes.items()) for k, (t, o) in sorted(c.entries.items())], "class STRING, entry STRING, type STRING, optional BOOLEAN"),
        "aliases": spark.createDataFrame([(n, k.text()) for n, k in sorted(reg.aliases.items())], "alias STRING, type STRING"),
    }


def object_text(files: DataFrame, num: int, gen: int = 0, options: Options | None = None) -> DataFrame:
    """(file_id, value, error): the text of one object of each file; only that object is read."""
    ref = Ref(num, gen)
    return _texts(files, lambda d: report.pretty(d.objects[ref]), options, only=ref)


def object_stream(files: DataFrame, num: int, gen: int = 0, decoded: bool = False, options: Options | None = None) -> DataFrame:
    """(file_id, data, decode_error) of one stream of each file, as stored or decoded."""
    data = F.col("decoded" if decoded else "encoded").alias("data")
    return pdf.parse(files, "streams", options).where((F.col("obj_num") == num) & (F.col("obj_gen") == gen)).select("file_id", data, "decode_error")


def find_ref(nodes: DataFrame, num: int, gen: int = 0) -> DataFrame:
    """Where a key is referred to: object and path, from a ``nodes`` table."""
    return nodes.where((F.col("ref_num") == num) & (F.col("ref_gen") == gen)).select("file_id", "key_kind", "obj_num", "obj_gen", "node_id", "path")


def find_name(nodes: DataFrame, name: str) -> DataFrame:
    """Where a name is a value (/path) or a key (\\path), from a ``nodes`` table."""
    at = ["file_id", "key_kind", "obj_num", "obj_gen", "node_id"]
    values = nodes.where(F.col("val_name") == name).select(*at, "path")
    above = F.expr("substring(path, 1, length(path) - length(elem_name) - 1)")
    keys = nodes.where(F.col("elem_name") == name).select(*at, F.concat(above, F.lit("\\"), F.col("elem_name")).alias("path"))
    return values.unionByName(keys)


def occurrences(found: DataFrame) -> DataFrame:
    """Occurrences and objects with one, per file."""
    return found.groupBy("file_id").agg(F.count("*").alias("n"), F.count_distinct("key_kind", F.coalesce("obj_num", F.lit(-1)), F.coalesce("obj_gen", F.lit(-1))).alias("n_objects"))


def closure(nodes: DataFrame) -> DataFrame:
    """(file_id, obj_num, obj_gen, defined): what is reachable from the trailer of each file, from a ``nodes`` table.

    A target that isn't an object of the file is an error of its own: it comes
    out with ``defined`` false, and the search goes no further there.
    """
    # Written once: the files would otherwise be parsed again for each use below.
    nodes = nodes.where("kind = 'ref' or (key_kind = 'object' and node_id = 0)").select("file_id", "key_kind", "obj_num", "obj_gen", "node_id", "kind", "ref_num", "ref_gen")
    nodes = Scratch(nodes.sparkSession, "nodes").cut(nodes)
    refs = nodes.where("kind = 'ref'").select("file_id", "key_kind", graph.code("obj_num", "obj_gen").alias("src"), graph.code("ref_num", "ref_gen").alias("dst"))
    reached = graph.closure(refs.where("key_kind = 'object'"), refs.where("key_kind = 'trailer'").select("file_id", F.col("dst").alias("node")))
    there = nodes.where("key_kind = 'object' and node_id = 0").select("file_id", graph.code("obj_num", "obj_gen").alias("node"), F.lit(True).alias("defined"))
    num, gen = graph.uncode("node")
    return reached.join(there, ["file_id", "node"], "left").select("file_id", num.alias("obj_num"), gen.alias("obj_gen"), F.coalesce("defined", F.lit(False)).alias("defined"))


def cleanup(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, value, error): each file in its normal form."""
    return _texts(files, report.clean, options, "BINARY")


def stable(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, value, error): the MD5 of each file's normal form, and an error where it isn't its own normal form."""
    kept = {k: v for k, v in vars(options or Options()).items() if k not in _NO_WARN}

    def make(doc: document.Document) -> str:
        once = report.clean(doc)
        again = document.load(once, Options(**kept))
        if again.errors or report.clean(again) != once:
            raise PdfError("The normal form is not its own normal form")
        return hashlib.md5(once).hexdigest()

    return _texts(files, make, options)
