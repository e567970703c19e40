"""Queries over files of many kinds made from the texts: every way to lay out, encode, encrypt, update and damage a file.

The kind of a file follows from its number, so the SQL says what each kind must give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.kernels import fixtures
from quire.kernels.model import Options
from quire.operators import layout, verbs
from quire.session import Scratch, spread, table
from quire.sources import pdf
from quire.streaming import ingest

KINDS = len(fixtures.VARIANTS)
SECRET = Options(user_password=fixtures.PASSWORD)


def _make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            files = [fixtures.varied(fixtures.VARIANTS[n % KINDS], t, n % 5 + 1) for n, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(f) for f in files], pa.int64()), pa.array(files, pa.binary())], names=["file_id", "length", "content"])


def files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return spread(docs, "doc_id").mapInArrow(_make, "file_id BIGINT, length BIGINT, content BINARY")


def _parsed(spark: SparkSession, d: str, name: str, options: Options = SECRET) -> DataFrame:
    return pdf.parse(files(spark, d), name, options)


def _cleaned(spark: SparkSession, d: str, **options) -> DataFrame:
    """The files in their normal form, as files again."""
    return verbs.cleanup(files(spark, d), Options(user_password=fixtures.PASSWORD, **options)).where("value is not null").select("file_id", F.col("value").alias("content"))


def varied_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _parsed(spark, d, "stats")
    return s.select(
        "file_id", "version", "updatecount", "encrypted", "objstm", "free", "objcount", "knowntypes", "incompletetypes", "nographerror",
        "nocontentstreamerror", "producer", "creation_date", "encrypt_v", "encrypt_r", "verify_user", "verify_owner", "first_error",
    )


def varied_report(spark: SparkSession, d: str) -> DataFrame:
    """The text report of each file; of the password's mark only its length is kept."""
    return _parsed(spark, d, "stats").select("file_id", F.regexp_replace("report", r"(/U : <[0-9A-F]{8})[0-9A-F]*>", "$1>").alias("report"))


def varied_content(spark: SparkSession, d: str) -> DataFrame:
    """What the page's content decodes to, after decryption, filters and prediction."""
    return _parsed(spark, d, "streams").where("obj_num = 4").select("file_id", F.array_join("filters", " ").alias("filters"), F.md5("decoded").alias("md5"), "decode_error")


def varied_titles(spark: SparkSession, d: str) -> DataFrame:
    """The title in force, from object streams, updates and under encryption."""
    return _parsed(spark, d, "nodes").where("obj_num = 6 and path = '/Title'").select("file_id", F.md5("val_bin").alias("md5"))


def varied_xref(spark: SparkSession, d: str) -> DataFrame:
    x = _parsed(spark, d, "xref_entries")
    return x.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "free").alias("n_free"), F.count_if(F.col("kind") == "compressed").alias("n_compressed"), F.count_if(F.col("seq") > 0).alias("n_shadowed"))


def varied_compressed(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "xref_entries").where("kind = 'compressed'").select("file_id", "obj_num", "off", "idx")


def varied_objects(spark: SparkSession, d: str) -> DataFrame:
    """Where each object came from."""
    return _parsed(spark, d, "objects").where("special is not null or origin = 'objstm'").select("file_id", "obj_num", "origin", "special", "is_stream")


def varied_holes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that no object covers and that are no blanks: their number, the size of the first and what it holds."""
    h = verbs.holes(files(spark, d), SECRET)
    first = F.regexp_extract("value", r"(?s)^\*Hole of ([0-9]+)[^\n]*\n(.*?)(?=\n\*Hole|\z)", 1)
    return h.select("file_id", F.regexp_count("value", F.lit(r"(?m)^\*Hole of")).alias("holes"), F.when(first != "", first.cast("int")).alias("bytes"), F.regexp_count("value", F.lit("junk ")).alias("junk"), "error")


def varied_merged(spark: SparkSession, d: str) -> DataFrame:
    """The contents of each page as one stream, after a cleanup that merges them."""
    s = pdf.parse(_cleaned(spark, d, merge_content_streams=True), "streams")
    return s.groupBy("file_id", F.array_join("filters", " ").alias("filters"), F.md5("decoded").alias("md5")).agg(F.count("*").alias("n"))


def varied_reencoded(spark: SparkSession, d: str) -> DataFrame:
    """Every stream under another filter after a cleanup that re-encodes."""
    s = pdf.parse(_cleaned(spark, d, reencode_streams="ASCII85Decode"), "streams")
    return s.groupBy("file_id", F.array_join("filters", " ").alias("filters"), F.md5("decoded").alias("md5")).agg(F.count("*").alias("n"))


def varied_simplified(spark: SparkSession, d: str) -> DataFrame:
    """The keys that a cleanup leaves in the information dictionary."""
    n = pdf.parse(_cleaned(spark, d, simplify_info=True, remove_ptex=True), "nodes")
    return n.where("elem_name in ('Producer', 'CreationDate', 'Other', 'PTEX.Fullbanner') or path = '/Info'").select("file_id", "path")


def varied_clean_objects(spark: SparkSession, d: str) -> DataFrame:
    """Numbers after a cleanup: dense, unreachable objects gone, small values in place."""
    o = pdf.parse(_cleaned(spark, d), "objects")
    return o.groupBy("file_id").agg(F.count("*").alias("n"), F.max("obj_num").alias("last"), F.count_if("is_stream").alias("n_streams"))


def varied_graph(spark: SparkSession, d: str) -> DataFrame:
    """Vertices and edges of the drawn reference graph."""
    g = verbs.dot(files(spark, d), SECRET)
    return g.select("file_id", F.regexp_count("value", F.lit(r"\[label=")).alias("vertices"), F.regexp_count("value", F.lit(" -> ")).alias("edges"))


def varied_visjs(spark: SparkSession, d: str) -> DataFrame:
    """The network as data; numbers stand for objects in the order in which they are first met."""
    return verbs.visjs(files(spark, d), SECRET).select("file_id", "value")


def varied_object(spark: SparkSession, d: str) -> DataFrame:
    return verbs.object_text(files(spark, d), 5, options=SECRET).select("file_id", "value", "error")


def varied_dump(spark: SparkSession, d: str) -> DataFrame:
    """The dump of trailers and objects, as a digest and its number of objects."""
    x = verbs.extract(files(spark, d), SECRET)
    return x.select("file_id", F.regexp_count("value", F.lit("(?m)^obj\\(")).alias("objects"), F.regexp_count("value", F.lit("(?m)^trailer$")).alias("trailers"), "error")


def varied_types(spark: SparkSession, d: str) -> DataFrame:
    """Of each type report the objects of known type, all objects, and the pages and streams among them."""
    t = verbs.types(files(spark, d), SECRET)
    known, total = (F.regexp_extract("value", "known type : ([0-9]+) / ([0-9]+)", i).cast("int") for i in (1, 2))
    pages, contents = (F.regexp_count("value", F.lit(f"(?m)^[0-9]+ : {k}$")) for k in ('c"page"', 's"content_stream"'))
    return t.where("error is null").select("file_id", known.alias("known"), total.alias("total"), pages.alias("pages"), contents.alias("contents"))


def varied_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "diagnostics").groupBy("stage", "severity", "exc", "message", "key").agg(F.count("*").alias("n"))


def varied_passwords(spark: SparkSession, d: str) -> DataFrame:
    """Files that can't be read without the password."""
    return _parsed(spark, d, "stats", Options()).where("first_error like '%password%'").select("file_id", "first_error")


def varied_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Undefined references read as null: what the run warns of, and that the files are sound then."""
    o = Options(user_password=fixtures.PASSWORD, undefined_ref_as_null=True)
    s = verbs.stats(files(spark, d), o).select("file_id", F.col("first_error").isNull().alias("sound"))
    w = pdf.parse(files(spark, d), "diagnostics", o).where("severity = 'warning'").select("file_id", "message")
    return s.join(w, "file_id").select("file_id", "sound", "message")


def varied_references(spark: SparkSession, d: str) -> DataFrame:
    return verbs.find_ref(_parsed(spark, d, "nodes"), 3).select("file_id", "key_kind", "obj_num", "path")


def varied_closure(spark: SparkSession, d: str) -> DataFrame:
    """What the trailer leads to, targets that aren't there told apart."""
    return verbs.closure(_parsed(spark, d, "nodes"))


def varied_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring objects that share a byte, where the run lets them."""
    e = _parsed(spark, d, "extents", Options(user_password=fixtures.PASSWORD, allow_overlaps=True)).where("key rlike '^[0-9]'")
    ext = e.select("file_id", F.col("key").cast("int").alias("obj_num"), F.lit(0).alias("obj_gen"), "low", "high")
    return layout.overlaps(ext)


def varied_stream(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of files that arrive as a stream, as its sink holds them."""
    base = Scratch(spark, "stream").base
    docs = spark.readStream.schema("doc_id BIGINT, text STRING").option("pathGlobFilter", "documents.parquet").parquet(d).where("text is not null")
    arriving = docs.mapInArrow(_make, "file_id BIGINT, length BIGINT, content BINARY")
    rows = ingest.table(arriving, "stats", SECRET).select("file_id", "updatecount", "objcount", "first_error")
    q = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def varied_names(spark: SparkSession, d: str) -> DataFrame:
    found = verbs.find_name(_parsed(spark, d, "nodes"), "Pages")
    return verbs.occurrences(found)


def varied_stable(spark: SparkSession, d: str) -> DataFrame:
    """Whether each file's normal form is its own normal form, with contents merged and re-encoded."""
    o = Options(user_password=fixtures.PASSWORD, merge_content_streams=True, reencode_streams="FlateDecode")
    return verbs.stable(files(spark, d), o).select("file_id", F.col("value").isNotNull().alias("stable"))


QUERIES = {k: f for k, f in globals().items() if k.startswith("varied_")}

# --- what each kind must give ------------------------------------------------------

_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(fixtures.VARIANTS))
_CRYPTED = "('rc4_40', 'rc4_128', 'crypt_rc4', 'crypt_aes')"
_UNREAD = "('wrong_offset', 'long_length', 'overlap', 'duplicate_key', 'no_startxref', 'bad_version')"  # the error is found while reading
_UPDATED = "('one_update', 'two_updates')"
_ESC = "replace(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '(', '\\('), ')', '\\)'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), chr(8), '\\b'), chr(12), '\\f')"
_VARIANT = "Type error : Invalid variant type : expected (c\"trailer_base\" | c\"trailer_xref\" | c\"trailer_hybrid\") in object trailer !"
_ERROR = f"""CASE WHEN name IN {_CRYPTED} THEN '{_VARIANT}' ELSE map_extract(map {{
    'wrong_offset': 'PDF error : Syntax error in object 2 at offset 65 [0x41] in file !',
    'outline_cycle': 'PDF error : Graph error : Cyclic tree structure in object 8 !', 'page_cycle': 'PDF error : Graph error : Cyclic tree structure in object 3 !',
    'long_length': 'PDF error : Stream size is out of bounds in object 4 at entry /Length at offset 253 [0xfd] in file !',
    'overlap': 'PDF error : The following objects overlap : 1 at [0xf, 0x6c] and 2 at [0x34, 0x63] !',
    'duplicate_key': 'PDF error : The same name appears several times in dictionary : /Type in object 3 at offset 107 [0x6b] in file !',
    'no_startxref': 'PDF error : No startxref found !', 'undefined': 'PDF error : Reference to unknown object during type checking : 50 in object 3 at entry /Annots !',
    'bad_version': 'PDF error : Invalid PDF version : 1.9 at offset 0 [0x0] in file !', 'content_error': 'PDF error : Content stream contains unbalanced q and Q operators in object 4 !'
  }}, name)[1] END"""
_FILES = f"""
d AS (SELECT doc_id AS file_id, text, {_ESC} AS esc, 'BT /F1 12 Tf 10 20 Td (' || {_ESC} || ') Tj ET' AS shown, CAST(doc_id % {KINDS} AS INTEGER) AS k, CAST(doc_id % 5 + 1 AS INTEGER) AS size FROM documents WHERE text IS NOT NULL),
v AS (SELECT d.*, n.name FROM d JOIN (VALUES {_NAMES}) n(k, name) USING (k)),
f AS (SELECT *, name IN {_UNREAD} AS unread, {_ERROR} AS err,
  CASE name WHEN 'xref_stream' THEN 7 WHEN 'object_stream' THEN 8 WHEN 'one_update' THEN 7 WHEN 'two_updates' THEN 7 WHEN 'hybrid' THEN 8 WHEN 'indirect_length' THEN 7 WHEN 'two_parts' THEN 7
    WHEN 'trees' THEN 8 + 2 * size WHEN 'outline_cycle' THEN 9 WHEN 'page_cycle' THEN 7 ELSE 6 END AS n,
  CASE name WHEN 'predictor' THEN shown || repeat(' ', CAST((8 - octet_length(encode(shown)) % 8) % 8 AS INTEGER)) WHEN 'content_error' THEN shown || ' Q' ELSE shown END AS content,
  CASE name WHEN 'hex' THEN 'ASCIIHexDecode' WHEN 'ascii85' THEN 'ASCII85Decode' WHEN 'runlength' THEN 'RunLengthDecode' WHEN 'lzw' THEN 'LZWDecode' WHEN 'flate' THEN 'FlateDecode'
    WHEN 'predictor' THEN 'FlateDecode' WHEN 'chain' THEN 'ASCII85Decode FlateDecode' ELSE '' END AS filters,
  CASE name WHEN 'one_update' THEN upper(md5(text)) WHEN 'two_updates' THEN md5(text) ELSE text END AS title FROM v),
s AS (SELECT *, CASE WHEN unread THEN -1 ELSE n END AS objects,
  CASE WHEN unread OR name = 'undefined' OR name IN {_CRYPTED} THEN -1 WHEN name IN ('one_update', 'two_updates', 'indirect_length') THEN 6 ELSE n END AS known,
  CASE WHEN name = 'bad_version' THEN NULL ELSE 5 END AS version, CASE WHEN name IN ('no_startxref', 'bad_version') THEN -1 WHEN name IN ('one_update', 'hybrid') THEN 1 WHEN name = 'two_updates' THEN 2 ELSE 0 END AS updates,
  name IN {_CRYPTED} AS enc, name IN ('object_stream', 'hybrid') AS objstm, name IN {_UPDATED} AS free FROM f),
g AS (SELECT *, known < 0 OR name = 'info_extra' AS incomplete, known >= 0 AND name NOT IN ('outline_cycle', 'page_cycle') AS graph, known >= 0 AND name NOT IN ('outline_cycle', 'page_cycle', 'content_error') AS sound,
  CASE name WHEN 'rc4_40' THEN 1 WHEN 'rc4_128' THEN 2 WHEN 'crypt_rc4' THEN 4 WHEN 'crypt_aes' THEN 4 END AS ev, CASE name WHEN 'rc4_40' THEN 2 WHEN 'rc4_128' THEN 3 WHEN 'crypt_rc4' THEN 4 WHEN 'crypt_aes' THEN 4 END AS er FROM s)"""
_CLEAN = "NOT unread AND name <> 'undefined'"
_W = f"WITH {_FILES.strip()}"

SQL = {
    "varied_stats": f"""{_W} SELECT file_id, version, updates AS updatecount, enc AS encrypted, objstm, free, objects AS objcount, known AS knowntypes, incomplete AS incompletetypes, graph AS nographerror, sound AS nocontentstreamerror,
        CASE name WHEN 'info_extra' THEN 'maker' END AS producer, CASE name WHEN 'info_extra' THEN 'D:20240101000000Z' END AS creation_date, ev AS encrypt_v, er AS encrypt_r, enc AS verify_user, false AS verify_owner, err AS first_error FROM g""",
    "varied_report": f"""{_W}, l AS (SELECT *, CASE name WHEN 'xref_stream' THEN ['FlateDecode -> 1', 'Raw -> 1'] WHEN 'object_stream' THEN ['FlateDecode -> 2', 'Raw -> 1'] WHEN 'hybrid' THEN ['FlateDecode -> 2', 'Raw -> 1']
            WHEN 'two_parts' THEN ['Raw -> 2'] WHEN 'chain' THEN ['ASCII85Decode -> 1', 'FlateDecode -> 1'] ELSE [CASE filters WHEN '' THEN 'Raw' ELSE filters END || ' -> 1'] END AS fs FROM g),
        r AS (SELECT file_id, CASE WHEN version IS NULL THEN ['Not a PDF file'] ELSE ['Version : 1.5'] END
          || CASE WHEN updates < 0 THEN [] ELSE ['Incremental updates : ' || updates] || CASE WHEN objstm THEN ['Contains object stream(s)'] ELSE [] END || CASE WHEN free THEN ['Contains free object(s)'] ELSE [] END
            || CASE WHEN objstm OR free OR updates > 0 OR enc THEN [] ELSE ['Neither updates nor object streams nor free objects nor encryption'] END
            || CASE WHEN enc THEN ['Encrypted', 'User password is valid', 'Owner password is invalid'] WHEN objects < 0 THEN [] ELSE ['Object count : ' || objects] || list_transform(fs, lambda x: 'Filter : ' || x || ' times')
              || CASE WHEN known < 0 THEN [] ELSE ['Objects of known type : ' || known, 'Known type rate : ' || printf('%.6f', known / objects)] || CASE WHEN incomplete THEN ['Some types were not fully checked'] WHEN known = objects THEN ['All types were fully checked'] ELSE [] END END
              || CASE WHEN graph THEN ['Graph has no known error'] ELSE [] END || CASE WHEN sound THEN ['Content streams have no known error'] ELSE [] END END END
          || CASE WHEN name = 'info_extra' THEN ['/Producer : (maker)', '/CreationDate : (D:20240101000000Z)'] ELSE [] END
          || CASE WHEN enc THEN ['/Encrypt/V : ' || ev, '/Encrypt/R : ' || er, '/Encrypt/U : <' || CASE er WHEN 2 THEN '49C321AD' ELSE '03802B24' END || '>', '/Encrypt/O : <000102030405060708090A0B0C0D0E0F101112131415161718191A1B1C1D1E1F>', '/Encrypt/ID : (0123456789abcdef)'] ELSE [] END
          || CASE WHEN sound AND NOT incomplete AND known = objects THEN ['No error found'] ELSE [] END || CASE WHEN err IS NULL THEN [] ELSE [err] END AS lines FROM l)
        SELECT file_id, array_to_string(lines, chr(10)) || chr(10) AS report FROM r""",
    "varied_content": f"{_W} SELECT file_id, filters, md5(content) AS md5, CAST(NULL AS VARCHAR) AS decode_error FROM g WHERE NOT unread OR name = 'overlap'",
    "varied_titles": f"{_W} SELECT file_id, md5(title) AS md5 FROM g WHERE NOT unread OR name = 'overlap'",
    "varied_xref": f"""{_W} SELECT file_id, CASE name WHEN 'xref_stream' THEN 8 WHEN 'object_stream' THEN 9 WHEN 'one_update' THEN 10 WHEN 'two_updates' THEN 11 WHEN 'hybrid' THEN 9 ELSE n + 1 END AS n,
        CASE WHEN free THEN 2 ELSE 1 END AS n_free, CASE name WHEN 'object_stream' THEN 5 WHEN 'hybrid' THEN 1 ELSE 0 END AS n_compressed, CASE name WHEN 'one_update' THEN 1 WHEN 'two_updates' THEN 2 ELSE 0 END AS n_shadowed FROM g WHERE name NOT IN ('no_startxref', 'bad_version')""",
    "varied_compressed": f"{_W} SELECT file_id, CAST(c.n AS INTEGER) AS obj_num, CAST(7 AS BIGINT) AS off, CAST(c.i AS INTEGER) AS idx FROM g JOIN (VALUES ('object_stream', 1, 0), ('object_stream', 2, 1), ('object_stream', 3, 2), ('object_stream', 5, 3), ('object_stream', 6, 4), ('hybrid', 5, 0)) c(name, n, i) USING (name)",
    "varied_objects": f"""{_W} SELECT file_id, CAST(c.n AS INTEGER) AS obj_num, CASE WHEN c.w IS NULL THEN 'objstm' ELSE 'file' END AS origin, c.w AS special, c.w IS NOT NULL AS is_stream FROM g
        JOIN (VALUES ('xref_stream', 7, 'xrefstm'), ('object_stream', 1, NULL), ('object_stream', 2, NULL), ('object_stream', 3, NULL), ('object_stream', 5, NULL), ('object_stream', 6, NULL), ('object_stream', 7, 'objstm'), ('object_stream', 8, 'xrefstm'),
          ('hybrid', 5, NULL), ('hybrid', 7, 'objstm'), ('hybrid', 8, 'xrefstm')) c(name, n, w) USING (name)""",
    "varied_holes": f"""{_W} SELECT file_id, CASE WHEN unread THEN NULL WHEN name = 'hole' THEN 1 WHEN name = 'one_update' THEN 2 WHEN name = 'two_updates' THEN 3 ELSE 0 END AS holes,
        CASE name WHEN 'hole' THEN 6 + 5 * (size + 1) WHEN 'one_update' THEN 27 + octet_length(encode(esc)) WHEN 'two_updates' THEN 27 + octet_length(encode(esc)) END AS bytes,
        CASE WHEN unread THEN NULL WHEN name = 'hole' THEN size + 1 WHEN free THEN (octet_length(encode(text)) - octet_length(encode(replace(text, 'junk ', '')))) // 5 ELSE 0 END AS junk, CASE WHEN unread THEN err END AS error FROM g""",
    "varied_merged": f"{_W} SELECT file_id, 'FlateDecode' AS filters, md5(CASE name WHEN 'two_parts' THEN content || chr(10) || 'q Q' ELSE content END) AS md5, CASE name WHEN 'trees' THEN size ELSE 1 END AS n FROM g WHERE {_CLEAN}",
    "varied_reencoded": f"{_W} SELECT file_id, 'ASCII85Decode' AS filters, md5(content) AS md5, 1 AS n FROM g WHERE {_CLEAN} UNION ALL SELECT file_id, 'ASCII85Decode', md5('q Q'), 1 FROM g WHERE name = 'two_parts'",
    "varied_simplified": f"{_W} SELECT file_id, '/Info' AS path FROM g WHERE {_CLEAN} UNION ALL SELECT file_id, p FROM g, (VALUES ('/Producer'), ('/CreationDate')) q(p) WHERE name = 'info_extra'",
    "varied_clean_objects": f"{_W} SELECT file_id, CASE WHEN name IN ('xref_stream', 'object_stream', 'one_update', 'two_updates', 'hybrid', 'indirect_length') THEN 6 ELSE n END AS n, CASE WHEN name IN ('xref_stream', 'object_stream', 'one_update', 'two_updates', 'hybrid', 'indirect_length') THEN 6 ELSE n END AS last, CASE name WHEN 'two_parts' THEN 2 ELSE 1 END AS n_streams FROM g WHERE {_CLEAN}",
    "varied_graph": f"""{_W} SELECT file_id, CASE WHEN unread THEN NULL ELSE n + 1 END AS vertices, CASE WHEN unread THEN NULL ELSE CASE name WHEN 'xref_stream' THEN 9 WHEN 'object_stream' THEN 9 WHEN 'two_parts' THEN 8 WHEN 'undefined' THEN 8
        WHEN 'outline_cycle' THEN 14 WHEN 'page_cycle' THEN 10 WHEN 'trees' THEN 2 + 3 + 1 + 1 + 3 * size + size + CASE size WHEN 1 THEN 1 ELSE 2 END + 1 + size + 2 * (size - 1) ELSE 7 END END AS edges FROM g""",
    "varied_visjs": f"""{_W}, e AS (SELECT *, CASE WHEN name = 'trees' THEN list_concat(range(1, 10), list_concat(range(11, 10 + size), range(100, 100 + size))) ELSE range(1, n + 1) END AS nums,
          [[0, 6], [0, 1]] || CASE name WHEN 'trees' THEN [[1, 9], [1, 8], [1, 2], [2, 7], [3, 7], [3, 5], [3, 4]] || list_transform(range(size - 1, 0, -1), lambda i: [7, 9 + i]) || [[7, 3], [7, 2], [8, 8 + 2 * size]]
              || CASE size WHEN 1 THEN [] ELSE [[8, 9 + size]] END || [[9, 3]] || flatten(list_transform(range(1, size), lambda i: [[9 + i, 7], [9 + i, 5], [9 + i, 4]]))
              || flatten(list_transform(range(0, size), lambda i: CASE WHEN i < size - 1 THEN [[9 + size + i, 10 + size + i]] ELSE [] END || CASE WHEN i > 0 THEN [[9 + size + i, 8 + size + i]] ELSE [] END || [[9 + size + i, 8]]))
            WHEN 'outline_cycle' THEN [[1, 7], [1, 2], [2, 3], [3, 5], [3, 4], [3, 2], [7, 9], [7, 8], [8, 8], [8, 7], [9, 8], [9, 7]] WHEN 'page_cycle' THEN [[1, 2], [2, 7], [2, 3], [3, 5], [3, 4], [3, 2], [7, 3], [7, 2]]
            ELSE [[1, 2], [2, 3]] || CASE WHEN name IN ('two_parts', 'undefined') THEN [[3, 7]] ELSE [] END || [[3, 5], [3, 4], [3, 2]] || CASE name WHEN 'xref_stream' THEN [[7, 6], [7, 1]] WHEN 'object_stream' THEN [[8, 6], [8, 1]] ELSE [] END END AS links FROM g)
        SELECT file_id, CASE WHEN NOT unread THEN 'var nodes = [' || chr(10) || '    {{id: 0, label: ''trailer''}},' || chr(10) || array_to_string(list_transform(nums, lambda x, i: '    {{id: ' || i || ', label: ''' || x || '''}},' || chr(10)), '') || '];' || chr(10) || chr(10)
          || 'var edges = [' || chr(10) || array_to_string(list_transform(links, lambda x: '    {{from: ' || x[1] || ', to: ' || x[2] || '}},' || chr(10)), '') || '];' || chr(10) || chr(10)
          || 'var container = document.getElementById(''graph'');' || chr(10) || 'var data = {{nodes: nodes, edges: edges}};' || chr(10) || 'var options = {{edges: {{style: ''arrow''}}}};' || chr(10) || 'var graph = new vis.Network(container, data, options);' || chr(10) END AS value FROM e""",
    "varied_object": f"""{_W} SELECT file_id, CASE WHEN name NOT IN ('no_startxref', 'bad_version') THEN '<<' || chr(10) || '    /BaseFont /Helvetica' || chr(10) || '    /Subtype /Type1' || chr(10) || '    /Type /Font' || chr(10) || '>>' END AS value,
        CASE WHEN name IN ('no_startxref', 'bad_version') THEN err END AS error FROM g""",
    "varied_dump": f"{_W} SELECT file_id, CASE WHEN NOT unread THEN n END AS objects, CASE WHEN NOT unread THEN updates + 1 END AS trailers, CASE WHEN unread THEN err END AS error FROM g",
    "varied_diagnostics": f"""{_W} SELECT CASE WHEN unread THEN 'parse' WHEN known < 0 THEN 'types' WHEN NOT graph THEN 'graph' ELSE 'content' END AS stage, 'error' AS severity, CASE WHEN enc THEN 'Typeerror' ELSE 'PDFerror' END AS exc,
        regexp_replace(regexp_replace(substr(err, strpos(err, ' : ') + 3), ' (in object|at offset) .*$| !$', ''), ' in object trailer$', '') AS message, nullif(regexp_extract(err, ' in object (\\w+)', 1), '') AS key, count(*) AS n FROM g WHERE err IS NOT NULL GROUP BY ALL""",
    "varied_types": f"{_W} SELECT file_id, known, n AS total, CASE WHEN name = 'trees' THEN size ELSE 1 END AS pages, CASE WHEN name = 'two_parts' THEN 2 ELSE 1 END AS contents FROM g WHERE known >= 0",
    "varied_references": f"""{_W} SELECT file_id, 'object' AS key_kind, CAST(q.n AS INTEGER) AS obj_num, q.p AS path FROM g JOIN (VALUES ('trees', 7, '/Kids[0]'), ('trees', 9, '/Names[1]/D[0]'), ('page_cycle', 2, '/Kids[1]'), ('page_cycle', 7, '/Kids[0]')) q(name, n, p) USING (name)
        UNION ALL SELECT file_id, 'object', 2, '/Kids[0]' FROM g WHERE name NOT IN ('trees', 'page_cycle', 'wrong_offset', 'no_startxref', 'bad_version')""",
    "varied_closure": f"""{_W}, o AS (SELECT file_id, unnest(CASE name WHEN 'trees' THEN list_concat(range(1, 10), list_concat(range(11, 10 + size), range(100, 100 + size)))
            WHEN 'wrong_offset' THEN [1, 2, 6] WHEN 'long_length' THEN [1, 2, 3, 4, 5, 6] WHEN 'duplicate_key' THEN [1, 2, 3, 6] WHEN 'undefined' THEN [1, 2, 3, 4, 5, 6, 50]
            ELSE range(1, CASE WHEN name IN ('xref_stream', 'object_stream', 'one_update', 'two_updates', 'hybrid', 'indirect_length') THEN 7 ELSE n + 1 END) END) AS num, name FROM g WHERE name NOT IN ('no_startxref', 'bad_version'))
        SELECT file_id, CAST(num AS INTEGER) AS obj_num, 0 AS obj_gen, NOT (name = 'undefined' AND num = 50 OR name = 'wrong_offset' AND num > 1 OR name = 'long_length' AND num > 3 OR name = 'duplicate_key' AND num > 2) AS defined FROM o""",
    "varied_overlaps": f"{_W} SELECT file_id, 2 AS obj_num, 0 AS obj_gen, CAST(52 AS BIGINT) AS low, 1 AS prev_num, 0 AS prev_gen, CAST(108 AS BIGINT) AS prev_high FROM g WHERE name = 'overlap'",
    "varied_stream": f"{_W} SELECT file_id, updates AS updatecount, objects AS objcount, err AS first_error FROM g",
    "varied_names": f"""{_W} SELECT file_id, CASE WHEN name IN ('trees', 'page_cycle') THEN 3 WHEN name = 'wrong_offset' THEN 1 ELSE 2 END AS n, CASE WHEN name IN ('trees', 'page_cycle') THEN 3 WHEN name = 'wrong_offset' THEN 1 ELSE 2 END AS n_objects FROM g
        WHERE name NOT IN ('no_startxref', 'bad_version')""",
    "varied_passwords": f"{_W} SELECT file_id, 'PDF error : Invalid user and owner passwords for encrypted document in object trailer !' AS first_error FROM g WHERE enc",
    "varied_nulls": f"{_W} SELECT file_id, true AS sound, 'Reference to unknown object : 50 in object 3 at entry /Annots' AS message FROM g WHERE name = 'undefined'",
    "varied_stable": f"{_W} SELECT file_id, {_CLEAN} AS stable FROM g",
}
