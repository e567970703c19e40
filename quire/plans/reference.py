"""Queries of the engine's own operators, over the object-model tables and over files made from texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions import bytesql as B
from quire.functions.names import unescape, unescape_sql
from quire.kernels import codecs, fixtures, pagelang, schema
from quire.kernels.model import Options, PdfError
from quire.operators import blocks, classes, getters, graph, layout, shred, verbs
from quire.plans.problems import NODES
from quire.session import spread, table
from quire.sources import pdf

REF_NUM, REF_GEN, NAME = 5, 0, "Page"


# --- search and graph ----------------------------------------------------------


def find_ref(spark: SparkSession, d: str) -> DataFrame:
    """Where object 5 is referred to, in every file."""
    rows = table(spark, d, "object_refs").where((F.col("ref_num") == REF_NUM) & (F.col("ref_gen") == REF_GEN))
    return rows.select("file_id", "src_num", "src_gen", F.concat(F.lit("/"), F.coalesce("entry", F.lit(""))).alias("path")).distinct()


def _names(spark: SparkSession, d: str) -> DataFrame:
    """The names with their escapes undone; keys are listed without any."""
    return table(spark, d, "object_names").withColumn("val_name", unescape(F.col("val_name")))


def find_name(spark: SparkSession, d: str) -> DataFrame:
    """Where a name is a value (/entry) or a key (\\entry); names are compared after their escapes are undone."""
    rows = _names(spark, d).select("file_id", "obj_num", "obj_gen", "entry", "val_name")
    values = rows.where(F.col("val_name") == NAME).select("file_id", "obj_num", "obj_gen", F.concat(F.lit("/"), F.coalesce("entry", F.lit(""))).alias("path"))
    keys = rows.where(F.col("entry") == NAME).select("file_id", "obj_num", "obj_gen", F.concat(F.lit("\\"), F.col("entry")).alias("path"))
    return values.unionByName(keys).distinct()


def find_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of a name and objects that hold it, per file."""
    found = _names(spark, d).where(F.col("val_name") == NAME)
    return found.groupBy("file_id").agg(F.count("*").alias("n"), F.count_distinct("obj_num", "obj_gen").alias("n_objects"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(table(spark, d, "object_refs"))


def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph.vertices(table(spark, d, "objects"))


def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Distinct targets and sources of each object."""
    e = graph.edges(table(spark, d, "object_refs"))
    out = e.groupBy("file_id", F.col("src_num").alias("obj_num"), F.col("src_gen").alias("obj_gen")).agg(F.count("*").alias("n_out"))
    into = e.groupBy("file_id", F.col("ref_num").alias("obj_num"), F.col("ref_gen").alias("obj_gen")).agg(F.count("*").alias("n_in"))
    both = out.join(into, ["file_id", "obj_num", "obj_gen"], "full_outer")
    return both.select("file_id", "obj_num", "obj_gen", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def refs_first_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.first_paths(table(spark, d, "object_refs"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "object_refs").na.drop(subset=["file_id", "src_num", "src_gen", "ref_num", "ref_gen"])
    return refs.select("file_id", graph.code("src_num", "src_gen").alias("src"), graph.code("ref_num", "ref_gen").alias("dst"))


def _reached(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    starts = links.select("file_id").distinct().withColumn("node", F.lit(1 << 32))
    return graph.closure(links, starts)


def ref_closure(spark: SparkSession, d: str) -> DataFrame:
    """Every object reachable from object 1 of its file."""
    num, gen = graph.uncode("node")
    return _reached(spark, d).select("file_id", num.alias("obj_num"), gen.alias("obj_gen"))


def sanitize_nums(spark: SparkSession, d: str) -> DataFrame:
    """Reachable objects numbered 1..n in key order."""
    num, gen = graph.uncode("node")
    return graph.renumber(_reached(spark, d)).select("file_id", num.alias("obj_num"), gen.alias("obj_gen"), "new_num")


def relink(spark: SparkSession, d: str) -> DataFrame:
    """Edges between reachable objects under their new numbers."""
    return graph.relink(_links(spark, d).distinct(), graph.renumber(_reached(spark, d)))


def undefined_refs(spark: SparkSession, d: str) -> DataFrame:
    return graph.undefined(table(spark, d, "object_refs"), table(spark, d, "objects"))


def undefined_to_null(spark: SparkSession, d: str) -> DataFrame:
    """Every reference, with the target of those to missing objects null."""
    rows = table(spark, d, "object_refs").select("ref_id", "file_id", "src_num", "src_gen", "entry", "ref_num", "ref_gen").distinct()
    return graph.nulled(rows, table(spark, d, "objects"))


def inline_targets(spark: SparkSession, d: str) -> DataFrame:
    """References to small objects, with the value that would stand in their place."""
    small = shred.scalars(table(spark, d, "objects").where(~F.col("is_stream")), ["file_id", "obj_num", "obj_gen"])
    return graph.inlined(table(spark, d, "object_refs"), small)


# --- cross-reference tables and layout -----------------------------------------


def xref_heads(spark: SparkSession, d: str) -> DataFrame:
    return layout.heads(table(spark, d, "xref_entries"))


def xref_report(spark: SparkSession, d: str) -> DataFrame:
    return layout.lines(table(spark, d, "xref_entries")).distinct()


def xref_totals(spark: SparkSession, d: str) -> DataFrame:
    return layout.totals(table(spark, d, "xref_entries"))


def xref_zero_offsets(spark: SparkSession, d: str) -> DataFrame:
    x = layout.zero_offsets(table(spark, d, "xref_entries"), table(spark, d, "run_params"))
    return x.groupBy("file_id", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


def xref_compare(spark: SparkSession, d: str) -> DataFrame:
    return layout.reconcile(table(spark, d, "xref_entries"), table(spark, d, "objects"))


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    return layout.overlaps(layout.extents(table(spark, d, "objects")))


def holes(spark: SparkSession, d: str) -> DataFrame:
    return layout.gaps(layout.extents(table(spark, d, "objects")), table(spark, d, "files"))


def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Objects and largest number per file."""
    o = table(spark, d, "objects")
    return o.groupBy("file_id").agg(F.count_distinct("obj_num", "obj_gen").alias("n_objects"), F.max("obj_num").alias("max_num"))


# --- streams, types and reports ------------------------------------------------


def filter_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Streams by filter; one without any counts as Raw."""
    names = F.regexp_extract_all(F.coalesce("filter_text", F.lit("")), F.lit(r"/([^\s/()<>\[\]{}%]*)"), 1)
    each = F.explode(F.when(F.size(names) == 0, F.array(F.lit("Raw"))).otherwise(names))
    return table(spark, d, "streams").dropDuplicates(["stream_id"]).select(each.alias("name")).select(unescape(F.col("name")).alias("filter")).groupBy("filter").agg(F.count("*").alias("n"))


def types_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Objects by declared type, commonest first."""
    t = _names(spark, d).where("entry = 'Type' and val_name is not null").select("file_id", "obj_num", "obj_gen", "val_name").distinct()
    return t.groupBy(F.col("val_name").alias("kind")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "kind")


def class_mandatory(spark: SparkSession, d: str) -> DataFrame:
    """Keys that objects lack although the class of their type demands them."""
    return classes.missing(table(spark, d, "objects"))


def class_unexpected(spark: SparkSession, d: str) -> DataFrame:
    """Keys that the class of an object's type doesn't know, with the number of objects."""
    return classes.unexpected(table(spark, d, "objects"))


def _dictionaries(spark: SparkSession, d: str) -> DataFrame:
    return getters.dictionaries(shred.grouped(table(spark, d, "objects")))


def dict_lengths(spark: SparkSession, d: str) -> DataFrame:
    return getters.lengths(_dictionaries(spark, d))


def dict_members(spark: SparkSession, d: str) -> DataFrame:
    """Objects that hold resources."""
    return getters.holding(_dictionaries(spark, d), "Resources")


def dict_fold(spark: SparkSession, d: str) -> DataFrame:
    return getters.fold(_dictionaries(spark, d))


def typed_integers(spark: SparkSession, d: str) -> DataFrame:
    """The lengths that streams state: numbers, and errors where a reference stands."""
    return getters.typed(_dictionaries(spark, d), "Length", "integer")


def typed_names(spark: SparkSession, d: str) -> DataFrame:
    """The filters of streams that have one, and errors where an array of them stands."""
    return getters.typed(_dictionaries(spark, d), "Filter", "name")


def typed_references(spark: SparkSession, d: str) -> DataFrame:
    return getters.typed(_dictionaries(spark, d), "Contents", "reference")


def arrays_of_numbers(spark: SparkSession, d: str) -> DataFrame:
    return getters.arrays_of(shred.grouped(table(spark, d, "objects")), "MediaBox", "number", 4)


def arrays_of_names(spark: SparkSession, d: str) -> DataFrame:
    return getters.arrays_of(shred.grouped(table(spark, d, "objects")), "Filter", "name")


def arrays_of_references(spark: SparkSession, d: str) -> DataFrame:
    return getters.arrays_of(shred.grouped(table(spark, d, "objects")), "Kids", "reference")


def int_range(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the ranges of positions and generations, by kind of entry."""
    x = table(spark, d, "xref_entries")
    return x.groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(
        F.count_if(~F.col("obj_gen").between(0, 65535)).alias("bad_gen"), F.count_if(~F.col("off").between(0, 2147483647)).alias("bad_off"),
        F.count_if((F.col("kind") == "inuse") & (F.col("off") == 0)).alias("zero_off"), F.count_if(F.col("idx").isNotNull()).alias("with_idx"),
    )


def key_forms(spark: SparkSession, d: str) -> DataFrame:
    """Keys in text form and in id form."""
    o = graph.vertices(table(spark, d, "objects"))
    return o.select("file_id", "obj_num", "obj_gen", B.key_text(F.col("obj_num"), F.col("obj_gen")).alias("key_text"), B.key_id(F.col("obj_num"), F.col("obj_gen")).alias("key_id"))


def name_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each producer as a name would be written."""
    p = table(spark, d, "files").where("producer is not null").select("producer").distinct()
    return p.select("producer", B.escape_name(F.col("producer")).alias("name"))


def file_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts per file over all tables: the relational form of the statistics report."""
    t = lambda n: table(spark, d, n)
    files = t("files").groupBy("file_id").agg(F.max("length").alias("length"), F.max("pdf_version").alias("version"))
    objects = t("objects").groupBy("file_id").agg(F.count_distinct("object_id").alias("n_objects"))
    streams = t("streams").groupBy("file_id").agg(F.count_distinct("stream_id").alias("n_streams"))
    x = t("xref_entries").groupBy("file_id").agg(F.bool_or(F.col("kind") == "compressed").alias("objstm"), F.bool_or((F.col("kind") == "free") & (F.col("obj_num") != 0)).alias("free"))
    out = files.join(objects, "file_id", "left").join(streams, "file_id", "left").join(x, "file_id", "left")
    return out.select("file_id", "version", "length", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_objects", "n_streams")], *[F.coalesce(c, F.lit(False)).alias(c) for c in ("objstm", "free")])


# --- bytes ---------------------------------------------------------------------


def _bytes(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("b")), "doc_id")


def asciihex_encode(spark: SparkSession, d: str) -> DataFrame:
    return _bytes(spark, d).select("doc_id", B.asciihex_encode(F.col("b")).alias("hex"))


def asciihex_round_trip(spark: SparkSession, d: str) -> DataFrame:
    b = _bytes(spark, d)
    return b.select("doc_id", F.md5(B.asciihex_decode(B.asciihex_encode(F.col("b")))).alias("md5"))


def adler32(spark: SparkSession, d: str) -> DataFrame:
    return _bytes(spark, d).select("doc_id", B.adler32("b").alias("adler32"))


def md5(spark: SparkSession, d: str) -> DataFrame:
    return _bytes(spark, d).select("doc_id", F.md5("b").alias("md5"))


def codec_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts that come back whole from every codec."""
    rows = _bytes(spark, d).select("b").mapInArrow(_round_trips, "codec STRING, n BIGINT, n_ok BIGINT")
    return rows.groupBy("codec").agg(F.sum("n").alias("n"), F.sum("n_ok").alias("n_ok"))


def _round_trips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        ok = [sum(codecs.decode(codecs.encode(b, name), name) == b for b in texts) for name in codecs.CODED]
        yield pa.RecordBatch.from_arrays([pa.array(codecs.CODED), pa.array([len(texts)] * len(ok), pa.int64()), pa.array(ok, pa.int64())], names=["codec", "n", "n_ok"])


# --- page language over ordered events -----------------------------------------

# Events stand for operators, so that order-dependent checks run over ordered rows of any number.
_AS_OP = {"purchase": "q", "signup": "Q", "click": "BT", "view": "ET", "error": "Tj"}
_DAY = 86_400


def _ops(spark: SparkSession, d: str) -> DataFrame:
    ops = F.create_map(*[F.lit(x) for kv in _AS_OP.items() for x in kv])
    return table(spark, d, "events").where("user_id is not null and ts is not null").select("user_id", "ts", "event_id", ops[F.col("event_type")].alias("op"))


def _day() -> F.Column:
    return F.floor(F.unix_timestamp("ts") / _DAY)


def qq_balance(spark: SparkSession, d: str) -> DataFrame:
    """Lowest and last depth of q and Q per user; a negative one is an error, a positive last one a warning."""
    delta = F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0).cast("bigint")
    rows = blocks.running(_ops(spark, d), ["user_id"], ["ts", "event_id"], _day(), delta, "depth")
    return rows.groupBy("user_id").agg(F.min("depth").alias("lowest"), F.max_by("depth", F.struct("ts", "event_id")).alias("last"))


def page_language(spark: SparkSession, d: str) -> DataFrame:
    """Every operator with its category, its operands and the state it leads to from each state."""
    rows = [(op, cat, pagelang.SHAPE[op], *(pagelang.step(s, op) for s in _STATES[:4])) for op, cat in pagelang.CATEGORY.items()]
    return spark.createDataFrame(rows, "op STRING, category STRING, operands STRING, page STRING, text STRING, path STRING, clipping STRING")


def page_runs(spark: SparkSession, d: str) -> DataFrame:
    """Content streams of random operators, a text's words picking them: operators read, and the first error."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return spread(docs, "doc_id").mapInArrow(_run_pages, "doc_id BIGINT, n_ops INT, error STRING")


# Operators with operands that fit them; a text picks one by the length of each line.
_SAMPLE = ("q", "Q", "BT", "ET", "1 w", "1 0 0 1 0 0 cm", "0 0 m", "1 1 l", "0 0 1 1 re", "S", "W", "n", "/F 9 Tf", "1 1 Td", "(a) Tj", "[(a) -5 (b)] TJ", "/P BMC", "EMC", "/X Do", "1 g", "BX", "EX")


def _run_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, errors = [], []
        for text in batch.column(1).to_pylist():
            ops = pagelang.parse("\n".join(_SAMPLE[len(line) % len(_SAMPLE)] for line in text.split("\n")).encode())
            counts.append(len(ops))
            try:
                pagelang.check(ops)
                errors.append(None)
            except PdfError as e:
                errors.append(e.message)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(errors, pa.string())], names=["doc_id", "n_ops", "error"])


_STATES = ("page", "text", "path", "clipping", "bad")


def _after(state: str, op: str) -> str:
    return "bad" if state == "bad" else pagelang.step(state, op) or "bad"


def content_dfa(spark: SparkSession, d: str) -> DataFrame:
    """The state each user's operators end in.

    What a block of operators does is a map from state to state; the maps of
    the blocks are computed apart and applied in order.
    """
    n = len(_STATES)
    move = {op: [_STATES.index(_after(s, op)) for s in _STATES] for op in _AS_OP.values()}
    step = F.create_map(*[x for op, to in move.items() for x in (F.lit(op), F.array(*[F.lit(i) for i in to]))])
    known = _ops(spark, d).where(F.col("op").isNotNull()).withColumn("_b", _day()).withColumn("_m", step[F.col("op")])
    whole = known.groupBy("user_id", "_b").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "_m"))).alias("ms"))
    same = F.array(*[F.lit(i) for i in range(n)])
    compose = lambda acc, m: F.transform(acc, lambda s: F.get(m, s))
    maps = whole.select("user_id", "_b", F.aggregate("ms", same, lambda acc, x: compose(acc, x["_m"])).alias("m"))
    per_user = maps.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("_b", "m"))).alias("ms"))  # a row a day
    end = F.aggregate("ms", F.lit(0), lambda s, x: F.get(x["m"], s))
    return per_user.select("user_id", F.get(F.array(*[F.lit(s) for s in _STATES]), end).alias("state"))


# --- files made from the documents ---------------------------------------------


def _make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            files = [fixtures.hello_file(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(f) for f in files], pa.int64()), pa.array(files, pa.binary())], names=["file_id", "length", "content"])


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """A one-page file per document."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return spread(docs, "doc_id").mapInArrow(_make, "file_id BIGINT, length BIGINT, content BINARY")


def pdf_stats(spark: SparkSession, d: str) -> DataFrame:
    cols = ["file_id", "version", "encrypted", "updatecount", "objstm", "free", "objcount", "knowntypes", "incompletetypes", "nographerror", "nocontentstreamerror"]
    return verbs.stats(text_files(spark, d)).select(*cols, F.map_keys("filters")[0].alias("filter"), F.map_values("filters")[0].alias("n_filter"))


def pdf_stats_strict(spark: SparkSession, d: str) -> DataFrame:
    """The report of each file under the strict grammar; streams that hold a keyword of the file format fail it."""
    s = verbs.stats(text_files(spark, d), Options(strict=True))
    return s.select("file_id", "version", "updatecount", "objcount", (F.col("first_error").isNull()).alias("clean"))


def pdf_find_ref(spark: SparkSession, d: str) -> DataFrame:
    nodes = pdf.parse(text_files(spark, d), "nodes")
    return verbs.find_ref(nodes, 5).select("file_id", "obj_num", "obj_gen", "path")


def pdf_find_name(spark: SparkSession, d: str) -> DataFrame:
    nodes = pdf.parse(text_files(spark, d), "nodes")
    return verbs.find_name(nodes, "Font").select("file_id", "obj_num", "path")


def pdf_xref(spark: SparkSession, d: str) -> DataFrame:
    return pdf.parse(text_files(spark, d), "xref_entries").select("file_id", "obj_num", "obj_gen", "seq", "kind", "off")


def pdf_types(spark: SparkSession, d: str) -> DataFrame:
    return pdf.parse(text_files(spark, d), "obj_types").groupBy("kind").agg(F.count("*").alias("cnt"))


def pdf_content_ops(spark: SparkSession, d: str) -> DataFrame:
    return pdf.parse(text_files(spark, d), "content_ops").groupBy("op_ord", "op", "category").agg(F.count("*").alias("n"))


def pdf_trailers(spark: SparkSession, d: str) -> DataFrame:
    return verbs.trailers(text_files(spark, d))


def pdf_streams(spark: SparkSession, d: str) -> DataFrame:
    """Encoded and decoded length of each content stream."""
    s = pdf.parse(text_files(spark, d), "streams")
    return s.select("file_id", "obj_num", F.octet_length("encoded").cast("bigint").alias("n_encoded"), F.octet_length("decoded").cast("bigint").alias("n_decoded"), F.size("filters").alias("n_filters"))


def pdf_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Files whose normal form is its own normal form."""
    return verbs.stable(text_files(spark, d)).select("file_id", F.col("error").isNull().alias("stable"))


def pdf_type_registry(spark: SparkSession, d: str) -> DataFrame:
    """Entries of every class as the rules give them; the type in the notation of reports is left out."""
    return verbs.type_registry(spark)["entries"].select("class", "entry", "optional")


def pdf_type_includes(spark: SparkSession, d: str) -> DataFrame:
    return verbs.type_registry(spark)["includes"]


def pdf_type_aliases(spark: SparkSession, d: str) -> DataFrame:
    return verbs.type_registry(spark)["aliases"].select("alias")


QUERIES = {
    f.__name__: f
    for f in (
        find_ref, find_name, find_occurrences, graph_edges, graph_vertices, graph_neighbors, refs_first_path, ref_closure, sanitize_nums,
        relink, undefined_refs, undefined_to_null, inline_targets, xref_heads, xref_report, xref_totals, xref_zero_offsets, xref_compare,
        overlaps, holes, document_sizes, filter_histogram, types_histogram, class_mandatory, class_unexpected, dict_lengths, dict_members,
        dict_fold, typed_integers, typed_names, typed_references, arrays_of_numbers, arrays_of_names, arrays_of_references, int_range, key_forms,
        name_forms, file_report, asciihex_encode, asciihex_round_trip, adler32, md5, codec_round_trip, qq_balance, content_dfa, page_language, page_runs, pdf_stats,
        pdf_stats_strict, pdf_find_ref, pdf_find_name, pdf_xref, pdf_types, pdf_content_ops, pdf_trailers, pdf_streams,
        pdf_cleanup, pdf_type_registry, pdf_type_includes, pdf_type_aliases,
    )
}

_VAL = unescape_sql("val_name")
_E = "SELECT DISTINCT file_id, src_num, src_gen, ref_num, ref_gen FROM object_refs WHERE file_id IS NOT NULL AND src_num IS NOT NULL AND src_gen IS NOT NULL AND ref_num IS NOT NULL AND ref_gen IS NOT NULL"
_V = "SELECT DISTINCT file_id, obj_num, obj_gen FROM objects WHERE file_id IS NOT NULL AND obj_num IS NOT NULL AND obj_gen IS NOT NULL"
_REACH = f"""e AS ({_E}),
r AS (SELECT DISTINCT file_id, 1 AS n, 0 AS g FROM e UNION SELECT r.file_id, e.ref_num, e.ref_gen FROM r JOIN e ON e.file_id = r.file_id AND e.src_num = r.n AND e.src_gen = r.g),
k AS (SELECT file_id, n, g, CAST(row_number() OVER (PARTITION BY file_id ORDER BY n, g) AS INTEGER) AS new_num FROM r)"""
_HEAD = "h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, obj_num, obj_gen ORDER BY seq, kind NULLS FIRST, off NULLS FIRST, idx NULLS FIRST) AS rn, count(DISTINCT seq) OVER (PARTITION BY file_id, obj_num, obj_gen) AS n_entries FROM xref_entries WHERE file_id IS NOT NULL AND obj_num IS NOT NULL AND obj_gen IS NOT NULL AND seq IS NOT NULL) WHERE rn = 1)"
_X = "x AS (SELECT DISTINCT file_id, obj_num, obj_gen, low, high FROM objects WHERE low IS NOT NULL AND high IS NOT NULL AND file_id IS NOT NULL)"
_RULES = f"""rule AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{c}', '{k}', {m})" for t, c, k, m in classes.rule_rows())}) r(type, class, key, mandatory)),
y AS (SELECT object_id, lit, arg_max(value, ord) AS type FROM nodes WHERE parent_group = '' AND elem_name = 'Type' AND kind = 'name' GROUP BY ALL),
u AS (SELECT DISTINCT object_id, lit, elem_name AS key FROM nodes WHERE parent_group = '' AND parent_ord = 0 AND elem_name IS NOT NULL AND kind <> 'null')"""
_ENTRIES = f"""WITH RECURSIVE {NODES.strip()}, le AS (SELECT object_id, lit, elem_name AS key, arg_max(kind, ord) AS kind, arg_max(coalesce(value, ''), ord) AS value FROM nodes WHERE parent_ord = 0 AND elem_name IS NOT NULL GROUP BY ALL),
en AS (SELECT * FROM le WHERE kind <> 'null')"""
_ARRAYS = f"""WITH RECURSIVE {NODES.strip()}, ar AS (SELECT a.object_id, a.path, a.group_path, a.lit, a.ord, count(*) AS n, string_agg(b.value, ' ' ORDER BY b.ord) AS vs, list(DISTINCT b.kind) AS kinds
FROM nodes a JOIN nodes b ON b.lit = a.lit AND b.parent_ord = a.ord WHERE a.kind = 'array' GROUP BY ALL)"""


def _array_sql(key: str, kind: str, size: int | None = None) -> str:
    bad = f"len(list_filter(kinds, lambda k: k NOT IN ({', '.join(repr(k) for k in getters.KINDS[kind])}))) > 0"
    error = f"CASE WHEN {bad} THEN 'Expected array of {kind}s'" + (f" WHEN n <> {size} THEN 'Expected array of size {size}'" if size else "") + " END"
    return f"{_ARRAYS} SELECT object_id, path, n, CASE WHEN {error} IS NULL THEN vs END AS values, {error} AS error FROM ar WHERE group_path LIKE '%/{key}'"


def _typed_sql(key: str, kind: str) -> str:
    fits = f"kind IN ({', '.join(repr(k) for k in getters.KINDS[kind])})"
    return f"{_ENTRIES} SELECT object_id, CASE WHEN {fits} THEN value END AS value, CASE WHEN NOT {fits} THEN 'Expected {kind} at entry /{key}' END AS error FROM en WHERE key = '{key}'"


_OPS = """o AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'q' WHEN 'signup' THEN 'Q' WHEN 'click' THEN 'BT' WHEN 'view' THEN 'ET' WHEN 'error' THEN 'Tj' END AS op
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""
# Length of the bytes that show a text: quotes of the string syntax cost one more byte each.
_SHOWN = "octet_length(encode(text)) + length(text) - length(regexp_replace(text, '[\\n\\r\\t\\x08\\x0c()\\\\]', '', 'g')) + 30"
_BODY = f"b AS (SELECT doc_id, {_SHOWN} AS n FROM documents WHERE text IS NOT NULL)"
# The rules as text, read by SQL on its own.
_SCHEMA = f"""l AS (SELECT i, rtrim(line) AS line FROM (SELECT unnest(string_split('{schema.DEFAULT.read_text().replace("'", "''")}', chr(10))) AS line, generate_subscripts(string_split('{schema.DEFAULT.read_text().replace("'", "''")}', chr(10)), 1) AS i)),
h AS (SELECT *, CASE WHEN line LIKE 'class %' THEN regexp_extract(line, '^class (\\w+)', 1) WHEN line LIKE 'alias %' OR line LIKE 'tree %' THEN '' END AS head FROM l),
k AS (SELECT i, line, last_value(head IGNORE NULLS) OVER (ORDER BY i) AS class FROM h WHERE line <> '' AND line NOT LIKE '#%'),
t AS (SELECT regexp_extract(line, '^tree (\\w+)', 1) AS name, CASE WHEN line LIKE '% names %' THEN 'nametree' ELSE 'numtree' END AS how, CASE WHEN line LIKE '% names %' THEN 'Names' ELSE 'Nums' END AS leaf FROM l WHERE line LIKE 'tree %')"""
_BYTES = "WITH b AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"

SQL = {
    "find_ref": f"SELECT DISTINCT file_id, src_num, src_gen, '/' || coalesce(entry, '') AS path FROM object_refs WHERE ref_num = {REF_NUM} AND ref_gen = {REF_GEN}",
    "find_name": f"SELECT DISTINCT file_id, obj_num, obj_gen, '/' || coalesce(entry, '') AS path FROM object_names WHERE {_VAL} = '{NAME}' UNION SELECT DISTINCT file_id, obj_num, obj_gen, '\\' || entry FROM object_names WHERE entry = '{NAME}'",
    "find_occurrences": f"SELECT file_id, count(*) AS n, count(DISTINCT (obj_num, obj_gen)) AS n_objects FROM object_names WHERE {_VAL} = '{NAME}' GROUP BY 1",
    "graph_edges": _E,
    "graph_vertices": _V,
    "graph_neighbors": f"""WITH e AS ({_E}), a AS (SELECT file_id, src_num AS obj_num, src_gen AS obj_gen, count(*) AS n_out FROM e GROUP BY ALL), b AS (SELECT file_id, ref_num AS obj_num, ref_gen AS obj_gen, count(*) AS n_in FROM e GROUP BY ALL)
        SELECT file_id, obj_num, obj_gen, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM a FULL JOIN b USING (file_id, obj_num, obj_gen)""",
    "refs_first_path": "SELECT file_id, src_num, src_gen, ref_num, ref_gen, arg_min_null(entry, ref_id) AS entry FROM object_refs WHERE file_id IS NOT NULL AND src_num IS NOT NULL AND src_gen IS NOT NULL AND ref_num IS NOT NULL AND ref_gen IS NOT NULL GROUP BY ALL",
    "ref_closure": f"WITH RECURSIVE {_REACH} SELECT file_id, n AS obj_num, g AS obj_gen FROM r",
    "sanitize_nums": f"WITH RECURSIVE {_REACH} SELECT file_id, n AS obj_num, g AS obj_gen, new_num FROM k",
    "relink": f"""WITH RECURSIVE {_REACH} SELECT e.file_id, a.new_num AS new_src, b.new_num AS new_dst FROM e
        JOIN k a ON a.file_id = e.file_id AND a.n = e.src_num AND a.g = e.src_gen JOIN k b ON b.file_id = e.file_id AND b.n = e.ref_num AND b.g = e.ref_gen""",
    "undefined_refs": f"WITH e AS ({_E}) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.file_id = e.file_id AND o.obj_num = e.ref_num AND o.obj_gen = e.ref_gen)",
    "undefined_to_null": """WITH e AS (SELECT DISTINCT ref_id, file_id, src_num, src_gen, entry, ref_num, ref_gen FROM object_refs), q AS (SELECT *, EXISTS (SELECT 1 FROM objects o WHERE o.file_id = e.file_id AND o.obj_num = e.ref_num AND o.obj_gen = e.ref_gen) AS ok FROM e)
        SELECT ref_id, file_id, src_num, src_gen, entry, CASE WHEN ok THEN ref_num END AS ref_num, CASE WHEN ok THEN ref_gen END AS ref_gen FROM q""",
    "inline_targets": f"""WITH e AS ({_E}), b AS (SELECT DISTINCT file_id, obj_num, obj_gen, trim(regexp_replace(literal, '%[^\\r\\n]*', '', 'g'), chr(0) || chr(9) || chr(10) || chr(12) || chr(13) || ' ') AS t FROM objects WHERE NOT is_stream AND literal IS NOT NULL),
        s AS (SELECT DISTINCT file_id, obj_num, obj_gen, CASE WHEN t LIKE '/%' THEN 'name' WHEN t LIKE '(%' THEN 'string' WHEN t LIKE '<%' THEN 'hex' WHEN t = 'null' THEN 'null' WHEN t IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN 'int'
            WHEN regexp_full_match(t, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN 'real' END AS kind, CASE WHEN t LIKE '/%' THEN {unescape_sql("substr(t, 2)")} WHEN t LIKE '(%' OR t LIKE '<%' THEN substr(t, 2, length(t) - 2) ELSE t END AS value FROM b WHERE t NOT LIKE '<<%' AND t NOT LIKE '[%')
        SELECT e.*, s.kind, s.value FROM e JOIN s ON s.file_id = e.file_id AND s.obj_num = e.ref_num AND s.obj_gen = e.ref_gen WHERE s.kind IS NOT NULL""",
    "xref_heads": f"WITH {_HEAD} SELECT file_id, obj_num, obj_gen, kind, off, idx, n_entries FROM h",
    "xref_report": """SELECT DISTINCT file_id, obj_num, obj_gen, seq, CASE WHEN seq > 0 THEN '*' ELSE '' END || '(' || obj_num || ', ' || obj_gen || ') ' || CASE kind WHEN 'free' THEN '[not used, next is ' || off || ']'
        WHEN 'compressed' THEN 'in (' || off || ', 0) [at ' || idx || ']' ELSE 'at ' || off || ' [0x' || lower(to_hex(off)) || ']' END AS line FROM xref_entries WHERE kind IS NOT NULL""",
    "xref_totals": "SELECT file_id, count(*) AS n, count(*) FILTER (kind = 'free') AS n_free, count(*) FILTER (kind = 'compressed') AS n_compressed, count(*) FILTER (seq > 0) AS n_shadowed FROM xref_entries GROUP BY 1",
    "xref_zero_offsets": """SELECT file_id, coalesce(CASE WHEN kind = 'inuse' AND off = 0 AND file_id IN (SELECT file_id FROM run_params WHERE zero_offset_as_free) THEN 'free' ELSE kind END, 'none') AS kind, count(*) AS n FROM xref_entries GROUP BY ALL""",
    "xref_compare": f"""WITH {_HEAD}, a AS (SELECT file_id, obj_num, obj_gen, off FROM h WHERE kind = 'inuse'), b AS (SELECT file_id, obj_num, obj_gen, min(low) AS low FROM objects WHERE low IS NOT NULL GROUP BY ALL),
        j AS (SELECT file_id, obj_num, obj_gen, off, low, CASE WHEN off IS NULL THEN 'no entry' WHEN low IS NULL THEN 'no object' WHEN off <> low THEN 'other position' END AS status FROM a FULL JOIN b USING (file_id, obj_num, obj_gen))
        SELECT * FROM j WHERE status IS NOT NULL""",
    "overlaps": f"""WITH {_X}, y AS (SELECT *, lag(high) OVER w AS prev_high, lag(obj_num) OVER w AS prev_num, lag(obj_gen) OVER w AS prev_gen FROM x WINDOW w AS (PARTITION BY file_id ORDER BY low, high, obj_num, obj_gen))
        SELECT file_id, obj_num, obj_gen, low, prev_num, prev_gen, prev_high FROM y WHERE prev_high >= low""",
    "holes": f"""WITH {_X}, z AS (SELECT file_id, low, high FROM x UNION ALL SELECT file_id, max(length), max(length) FROM files WHERE length IS NOT NULL AND file_id IS NOT NULL GROUP BY 1),
        y AS (SELECT file_id, low, coalesce(max(high + 1) OVER (PARTITION BY file_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM z)
        SELECT file_id, CAST(start AS BIGINT) AS start, CAST(low - start AS BIGINT) AS size FROM y WHERE low > start""",
    "document_sizes": "SELECT file_id, count(DISTINCT (obj_num, obj_gen)) AS n_objects, max(obj_num) AS max_num FROM objects GROUP BY 1",
    "filter_histogram": f"""WITH s AS (SELECT DISTINCT stream_id, filter_text FROM streams), n AS (SELECT regexp_extract_all(coalesce(filter_text, ''), '/([^\\s/()<>\\[\\]{{}}%]*)', 1) AS f FROM s),
        u AS (SELECT unnest(CASE WHEN len(f) = 0 THEN ['Raw'] ELSE f END) AS filter FROM n) SELECT {unescape_sql('filter')} AS filter, count(*) AS n FROM u GROUP BY ALL""",
    "types_histogram": f"SELECT {_VAL} AS kind, count(DISTINCT (file_id, obj_num, obj_gen)) AS cnt FROM object_names WHERE entry = 'Type' AND val_name IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, kind",
    "class_mandatory": f"WITH RECURSIVE {NODES.strip()}, {_RULES} SELECT DISTINCT y.object_id, rule.class, rule.key FROM y JOIN rule USING (type) ANTI JOIN u ON u.lit = y.lit AND u.key = rule.key WHERE rule.mandatory",
    "class_unexpected": f"""WITH RECURSIVE {NODES.strip()}, {_RULES}, kinds AS (SELECT DISTINCT type, class FROM rule), odd AS (SELECT DISTINCT y.object_id, kinds.class, u.key FROM y JOIN kinds USING (type) JOIN u ON u.lit = y.lit ANTI JOIN rule ON rule.type = y.type AND rule.key = u.key)
        SELECT class, key, count(*) AS n_objects FROM odd GROUP BY ALL""",
    "dict_lengths": f"{_ENTRIES} SELECT object_id, count(*) FILTER (kind <> 'null') AS n_entries FROM le GROUP BY object_id, lit",
    "dict_members": f"{_ENTRIES} SELECT object_id FROM en WHERE key = 'Resources'",
    "dict_fold": f"{_ENTRIES} SELECT key, kind, count(*) AS n_objects FROM en GROUP BY ALL",
    "typed_integers": _typed_sql("Length", "integer"),
    "typed_names": _typed_sql("Filter", "name"),
    "typed_references": _typed_sql("Contents", "reference"),
    "arrays_of_numbers": _array_sql("MediaBox", "number", 4),
    "arrays_of_names": _array_sql("Filter", "name"),
    "arrays_of_references": _array_sql("Kids", "reference"),
    "int_range": """SELECT coalesce(kind, 'none') AS kind, count(*) FILTER (NOT obj_gen BETWEEN 0 AND 65535) AS bad_gen, count(*) FILTER (NOT off BETWEEN 0 AND 2147483647) AS bad_off,
        count(*) FILTER (kind = 'inuse' AND off = 0) AS zero_off, count(idx) AS with_idx FROM xref_entries GROUP BY 1""",
    "key_forms": f"SELECT file_id, obj_num, obj_gen, CASE obj_gen WHEN 0 THEN obj_num || '' ELSE obj_num || ' [' || obj_gen || ']' END AS key_text, CASE obj_gen WHEN 0 THEN obj_num || '' ELSE obj_num || '_' || obj_gen END AS key_id FROM ({_V})",
    "name_forms": """SELECT producer, coalesce(list_aggregate(list_transform(regexp_extract_all(producer, '(?s).'), lambda x: CASE WHEN regexp_full_match(x, '[!-~]') AND NOT contains('()<>[]{}/%#', x) THEN x ELSE '#' || printf('%02X', unicode(x)) END), 'string_agg', ''), '') AS name
        FROM (SELECT DISTINCT producer FROM files WHERE producer IS NOT NULL)""",
    "file_report": """WITH f AS (SELECT file_id, max(length) AS length, max(pdf_version) AS version FROM files GROUP BY 1), o AS (SELECT file_id, count(DISTINCT object_id) AS n FROM objects GROUP BY 1), s AS (SELECT file_id, count(DISTINCT stream_id) AS n FROM streams GROUP BY 1),
        x AS (SELECT file_id, bool_or(kind = 'compressed') AS c, bool_or(kind = 'free' AND obj_num <> 0) AS e FROM xref_entries GROUP BY 1)
        SELECT f.file_id, f.version, f.length, coalesce(o.n, 0) AS n_objects, coalesce(s.n, 0) AS n_streams, coalesce(x.c, false) AS objstm, coalesce(x.e, false) AS free FROM f LEFT JOIN o USING (file_id) LEFT JOIN s USING (file_id) LEFT JOIN x USING (file_id)""",
    "asciihex_encode": f"{_BYTES} SELECT doc_id, hex(encode(text)) || '>' AS hex FROM b",
    "asciihex_round_trip": f"{_BYTES} SELECT doc_id, md5(text) AS md5 FROM b",
    "adler32": """WITH b AS (SELECT doc_id, octet_length(encode(text)) AS n, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents WHERE text IS NOT NULL),
        v AS (SELECT doc_id, n, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM b), c AS (SELECT doc_id, n, i, CAST('0x' || x AS INTEGER) AS c FROM v)
        SELECT doc_id, CAST(((max(n) + sum((n - i + 1) * c)) % 65521) * 65536 + (1 + sum(c)) % 65521 AS BIGINT) AS adler32 FROM c GROUP BY doc_id
        UNION ALL SELECT doc_id, CAST(1 AS BIGINT) FROM b WHERE n = 0""",
    "md5": f"{_BYTES} SELECT doc_id, md5(text) AS md5 FROM b",
    "codec_round_trip": "SELECT c AS codec, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_ok FROM (VALUES " + ", ".join(f"('{c}')" for c in codecs.CODED) + ") t(c)",
    "qq_balance": f"""WITH {_OPS}, s AS (SELECT *, sum(CASE op WHEN 'q' THEN 1 WHEN 'Q' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS depth FROM o)
        SELECT user_id, CAST(min(depth) AS BIGINT) AS lowest, CAST(arg_max(depth, (ts, event_id)) AS BIGINT) AS last FROM s GROUP BY 1""",
    "content_dfa": f"""WITH {_OPS}, l AS (SELECT user_id, list(op ORDER BY ts, event_id) AS ops FROM o WHERE op IS NOT NULL GROUP BY 1)
        SELECT user_id, list_reduce(list_prepend('page', ops), lambda s, x: CASE WHEN s = 'page' AND x IN ('q', 'Q') THEN 'page' WHEN s = 'page' AND x = 'BT' THEN 'text' WHEN s = 'text' AND x = 'ET' THEN 'page' WHEN s = 'text' AND x = 'Tj' THEN 'text' ELSE 'bad' END) AS state FROM l""",
    "page_language": f"""WITH l AS (SELECT unnest(string_split('{pagelang.OPERATORS.strip().replace("'", "''")}', chr(10))) AS line), o AS (SELECT split_part(line, ': ', 1) AS category, unnest(string_split(split_part(line, ': ', 2), ' ')) AS x FROM l),
        p AS (SELECT split_part(x, '(', 1) AS op, category AS c, rtrim(split_part(x, '(', 2), ')') AS operands FROM o)
        SELECT op, c AS category, operands, CASE WHEN op = 'BT' THEN 'text' WHEN op IN ('m', 're') THEN 'path' WHEN op IN ('sh', 'BI', 'Do') OR c IN ('Compatibility', 'GeneralGraphicsState', 'SpecialGraphicsState', 'Color', 'TextState', 'MarkedContent') THEN 'page' END AS page,
          CASE WHEN op = 'ET' THEN 'page' WHEN c IN ('Compatibility', 'GeneralGraphicsState', 'Color', 'TextState', 'TextPositioning', 'TextShowing', 'MarkedContent') THEN 'text' END AS text,
          CASE WHEN c = 'ClippingPath' THEN 'clipping' WHEN c = 'PathPainting' THEN 'page' WHEN c IN ('Compatibility', 'PathConstruction') THEN 'path' END AS path, CASE WHEN c = 'PathPainting' THEN 'page' WHEN c = 'Compatibility' THEN 'clipping' END AS clipping FROM p""",
    "page_runs": f"""WITH RECURSIVE s(i, op, cat) AS (VALUES {", ".join(f"({i}, '{x.split(' ')[-1]}', '{pagelang.CATEGORY[x.split(' ')[-1]]}')" for i, x in enumerate(_SAMPLE))}),
        t(cat, op, a, b) AS (VALUES ('', 'BT', 'page', 'text'), ('', 'ET', 'text', 'page'), ('', 'm', 'page', 'path'), ('', 're', 'page', 'path'), ('', 'Do', 'page', 'page'), ('Compatibility', '', 'page', 'page'), ('Compatibility', '', 'text', 'text'), ('Compatibility', '', 'path', 'path'), ('Compatibility', '', 'clipping', 'clipping'),
          ('GeneralGraphicsState', '', 'page', 'page'), ('GeneralGraphicsState', '', 'text', 'text'), ('SpecialGraphicsState', '', 'page', 'page'), ('Color', '', 'page', 'page'), ('Color', '', 'text', 'text'), ('TextState', '', 'page', 'page'), ('TextState', '', 'text', 'text'), ('MarkedContent', '', 'page', 'page'), ('MarkedContent', '', 'text', 'text'),
          ('TextPositioning', '', 'text', 'text'), ('TextShowing', '', 'text', 'text'), ('PathConstruction', '', 'path', 'path'), ('ClippingPath', '', 'path', 'clipping'), ('PathPainting', '', 'path', 'page'), ('PathPainting', '', 'clipping', 'page')),
        l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CAST(length(x) % {len(_SAMPLE)} AS INTEGER)) AS ks FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, 0 AS at, 'page' AS state, CAST(NULL AS VARCHAR) AS bad FROM l UNION ALL
          SELECT w.doc_id, w.at + 1, coalesce(x.b, y.b), CASE WHEN coalesce(x.b, y.b) IS NULL THEN 'Unexpected command ' || s.op || ' in state "' || w.state || '" of content stream' END
          FROM w JOIN l ON l.doc_id = w.doc_id JOIN s ON s.i = l.ks[w.at + 1] LEFT JOIN t x ON x.op = s.op AND x.a = w.state LEFT JOIN t y ON y.cat = s.cat AND y.op = '' AND y.a = w.state WHERE w.bad IS NULL AND w.at < len(l.ks)),
        e AS (SELECT doc_id, max(bad) AS bad FROM w GROUP BY 1), q AS (SELECT doc_id, list_transform(ks, lambda k: CASE k WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) AS steps FROM l),
        d AS (SELECT doc_id, min(s) AS low FROM (SELECT doc_id, sum(x) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (SELECT doc_id, unnest(steps) AS x, generate_subscripts(steps, 1) AS i FROM q)) GROUP BY 1)
        SELECT l.doc_id, CAST(len(ks) AS INTEGER) AS n_ops, CASE WHEN e.bad IS NOT NULL THEN e.bad WHEN d.low < 0 THEN 'Content stream contains unbalanced q and Q operators' END AS error FROM l JOIN e USING (doc_id) JOIN d USING (doc_id)""",
    "pdf_stats": """SELECT doc_id AS file_id, 5 AS version, false AS encrypted, 0 AS updatecount, false AS objstm, false AS free, 6 AS objcount, 6 AS knowntypes, false AS incompletetypes, true AS nographerror, true AS nocontentstreamerror, 'Raw' AS filter, 1 AS n_filter
        FROM documents WHERE text IS NOT NULL""",
    "pdf_stats_strict": """SELECT doc_id AS file_id, CASE WHEN contains(text, 'endstream') THEN NULL ELSE 5 END AS version, CASE WHEN contains(text, 'endstream') THEN -1 ELSE 0 END AS updatecount,
        CASE WHEN contains(text, 'endobj') OR contains(text, 'trailer') OR contains(text, 'endstream') THEN -1 ELSE 6 END AS objcount, NOT (contains(text, 'endobj') OR contains(text, 'trailer') OR contains(text, 'endstream')) AS clean FROM documents WHERE text IS NOT NULL""",
    "pdf_find_ref": "SELECT doc_id AS file_id, 3 AS obj_num, 0 AS obj_gen, '/Resources/Font/F1' AS path FROM documents WHERE text IS NOT NULL",
    "pdf_find_name": "SELECT doc_id AS file_id, v.n AS obj_num, v.p AS path FROM documents, (VALUES (3, '/Resources\\Font'), (5, '/Type')) v(n, p) WHERE text IS NOT NULL",
    "pdf_xref": f"""WITH {_BODY}, v AS (SELECT doc_id, n, CAST(unnest(range(0, 7)) AS INTEGER) AS k FROM b)
        SELECT doc_id AS file_id, k AS obj_num, CASE k WHEN 0 THEN 65535 ELSE 0 END AS obj_gen, 0 AS seq, CASE k WHEN 0 THEN 'free' ELSE 'inuse' END AS kind,
          CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN 15 WHEN 2 THEN 58 WHEN 3 THEN 107 WHEN 4 THEN 217 WHEN 5 THEN 217 + 24 + 8 + length(CAST(n AS VARCHAR))+ n + 12 ELSE 217 + 24 + 8 + length(CAST(n AS VARCHAR))+ n + 12 + 61 END AS BIGINT) AS off FROM v""",
    "pdf_types": """SELECT kind, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS cnt FROM (VALUES ('c"catalog"'), ('c"pageroot"'), ('c"page"'), ('s"content_stream"'), ('c"font_type1_standard"'), ('c"info"')) t(kind)""",
    "pdf_content_ops": """SELECT o AS op_ord, op, c AS category, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n FROM (VALUES (0, 'BT', 'Other'), (1, 'Tf', 'TextState'), (2, 'Td', 'TextPositioning'), (3, 'Tj', 'TextShowing'), (4, 'ET', 'Other')) t(o, op, c)""",
    "pdf_trailers": "SELECT doc_id AS file_id, 0 AS ord, '<<' || chr(10) || '    /Info 6 0 R' || chr(10) || '    /Root 1 0 R' || chr(10) || '    /Size 7' || chr(10) || '>>' AS text FROM documents WHERE text IS NOT NULL",
    "pdf_streams": f"WITH {_BODY} SELECT doc_id AS file_id, 4 AS obj_num, CAST(n AS BIGINT) AS n_encoded, CAST(n AS BIGINT) AS n_decoded, 0 AS n_filters FROM b",
    "pdf_type_registry": f"""WITH {_SCHEMA}, a AS (SELECT class, regexp_extract(line, '^  (\\w[^!?]*)[!?]', 1) AS entry, line LIKE '%? %' AND regexp_matches(line, '^  [^!?]*[?] ') AS optional FROM k WHERE line LIKE '  %')
        SELECT class, entry, optional FROM a UNION ALL SELECT how || part || '_' || name, key, false FROM t JOIN (VALUES ('rootnode', 'Kids'), ('rootleaf', NULL), ('node', 'Limits'), ('leaf', 'Limits')) q(part, own) ON true, LATERAL (SELECT coalesce(own, leaf) AS key)""",
    "pdf_type_includes": f"""WITH {_SCHEMA}, a AS (SELECT class, unnest(string_split(regexp_extract(line, ': (.*)$', 1), ' ')) AS included FROM k WHERE line LIKE 'class % : %')
        SELECT class, included FROM a UNION ALL SELECT how || part || '_' || name, how || 'root' || part || '_' || name FROM t, (VALUES ('node'), ('leaf')) q(part)""",
    "pdf_type_aliases": f"WITH {_SCHEMA} SELECT regexp_extract(line, '^alias (\\w+) =', 1) AS alias FROM l WHERE line LIKE 'alias %'",
    "pdf_cleanup": "SELECT doc_id AS file_id, true AS stable FROM documents WHERE text IS NOT NULL",
}
