"""Rows that fail to parse: typed valid rows and rejected rows with a reason.

The raw text is read permissively by ``from_csv`` under a typed schema, whose
column for the corrupt text is the reader's verdict.  A row that the reader took
and that holds nothing it is lenient about is valid once its values are in
range.  All others, the corrupt ones first of all, are classified again from
the retained text by quoting, field count and cast checks.  All of it runs
inside the JVM in one pass over the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FIELDS = ("file_id", "obj_num", "obj_gen", "kind", "off", "idx", "zero_offset_as_free", "note")
_TYPED = "file_id BIGINT, obj_num INT, obj_gen INT, kind STRING, off INT, idx BIGINT, zero_offset_as_free STRING, note STRING, _corrupt STRING"
_TEXT = ", ".join(f"{f} STRING" for f in FIELDS)
COLUMNS = 512
_OPTIONS = {
    "mode": "PERMISSIVE", "sep": ",", "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1",
    "maxColumns": str(COLUMNS), "emptyValue": "",
}
MAX_INT, MAX_GEN = 2147483647, 65535
# A text of other characters goes to the second check: quotes, line breaks, and signs and digits that the reader takes but the format doesn't know.
_PLAIN = r"\A[ !#-*,.-~]*\z"

REASONS = (
    "missing", "quoting", "field_count", "file_id", "obj_num", "obj_gen", "kind", "off", "idx",
    "zero_offset_as_free", "zero_offset",
)


def _commas(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))


def quoting(raw: Column) -> tuple[Column, Column]:
    """(quoting is well formed, number of fields) of one comma-separated record.

    The text is cut at every double quote: pieces at even places lie outside
    quotes.  A well-formed record has an odd number of pieces, and a quote may
    only open after a comma or at the start and close before a comma or at the
    end; an empty outside piece between two others is a doubled quote.
    """
    pieces = F.split(raw, '"', -1)
    n = F.size(pieces)
    first, last = F.element_at(pieces, 1), F.element_at(pieces, -1)
    # Lambdas refer to nothing but their arguments: anything else is worked out again for every piece.
    broken = F.filter(F.slice(pieces, 2, F.greatest(n - 2, F.lit(0))), lambda s, i: (i % 2 == 1) & (s != "") & ~(s.startswith(",") & s.endswith(",")))
    lines = F.filter(pieces, lambda s, i: (i % 2 == 0) & s.rlike("[\r\n]"))
    outside = F.filter(pieces, lambda s, i: i % 2 == 0)
    wrong = (F.size(broken) > 0) | (F.size(lines) > 0) | ((first != "") & ~first.endswith(",")) | ((last != "") & ~last.startswith(","))
    plain = F.instr(raw, '"') == 0
    ok = F.when(plain, ~raw.rlike("[\r\n]")).otherwise((n % 2 == 1) & ~wrong)
    count = F.when(plain, _commas(raw)).otherwise(F.aggregate(outside, F.lit(0), lambda a, s: a + _commas(s))) + 1
    return ok, count


def _digits(c: Column) -> Column:
    return c.rlike(r"\A[0-9]+\z")


def _number(c: Column) -> Column:
    """Decimal value of a digit string; null when it exceeds 64 bits."""
    return F.when(_digits(c), c.try_cast("bigint"))


def _once(df: DataFrame, struct: Column, prefix: str, names: tuple[str, ...]) -> DataFrame:
    """``df`` plus the fields of a struct, worked out once a row: nothing is moved through a generator or repeated behind it."""
    return df.select("*", F.inline(F.array(struct)).alias(*[prefix + n for n in names]))


def classify(lines: DataFrame, text: str = "raw_line") -> DataFrame:
    """``lines`` plus the typed fields in a struct ``entry`` and ``reason``.

    ``reason`` is null for a valid record, else the first failed check of
    ``REASONS``.  Edge cases: null or empty text is ``missing``; blanks are
    data, so a line of blanks fails ``field_count``; extra columns are kept as
    they are; equal rows stay equal rows; a ``file_id`` beyond 64 bits is
    valid and kept as text in ``file_id_text`` with ``file_id`` null, as is an
    ``idx`` beyond 64 bits with ``idx`` null.  A record of any number of
    fields, length or quotes gets a reason: the reader, which fails on more
    than ``COLUMNS`` fields, isn't asked about a text with so many commas
    unless it is known to have the right number of fields.
    """
    raw = F.col(text)
    ok, count = quoting(raw)
    safe = F.when(_commas(raw) < COLUMNS, True).otherwise(ok & (count == len(FIELDS)))
    typed = F.from_csv(raw, _TYPED, _OPTIONS | {"columnNameOfCorruptRecord": "_corrupt"})
    df = _once(lines, F.when(safe, typed), "_t_", (*FIELDS, "_corrupt"))
    t = {name: F.col(f"_t_{name}") for name in FIELDS}
    taken = raw.isNotNull() & (raw != "") & raw.rlike(_PLAIN) & F.col("_t__corrupt").isNull()
    sound = (
        t["file_id"].isNotNull() & t["obj_num"].isNotNull() & t["obj_gen"].isNotNull() & (t["obj_gen"] <= MAX_GEN) & t["off"].isNotNull()
        & t["kind"].isin("free", "inuse", "compressed") & ((t["kind"] == "compressed") == t["idx"].isNotNull())
        & t["zero_offset_as_free"].isin("true", "false") & ((t["kind"] != "inuse") | (t["off"] != 0) | (t["zero_offset_as_free"] == "true"))
    )
    df = _once(df, F.struct(F.coalesce(taken & sound, F.lit(False)).alias("good")), "_", ("good",))
    # What is left is told apart by one check after the other; well-formed records of the right length are read again as text.
    df = _once(df, F.when(~F.col("_good"), F.struct(ok.alias("ok"), count.alias("n"))), "_", ("ok", "n"))
    df = _once(df, F.when(F.col("_ok") & (F.col("_n") == len(FIELDS)), F.from_csv(raw, _TEXT, _OPTIONS)), "_x_", FIELDS)
    f = {name: F.coalesce(F.col(f"_x_{name}"), F.lit("")) for name in FIELDS}
    num, gen, off = _number(f["obj_num"]), _number(f["obj_gen"]), _number(f["off"])
    within = lambda v, most: F.coalesce(v <= most, F.lit(False))
    checks: list[tuple[str, Column]] = [
        ("missing", raw.isNull() | (raw == "")),
        ("quoting", ~F.col("_ok")),
        ("field_count", F.col("_n") != len(FIELDS)),
        ("file_id", ~_digits(f["file_id"])),
        ("obj_num", ~within(num, MAX_INT)),
        ("obj_gen", ~within(gen, MAX_GEN)),
        ("kind", ~f["kind"].isin("free", "inuse", "compressed")),
        ("off", ~within(off, MAX_INT)),
        ("idx", F.when(f["kind"] == "compressed", ~_digits(f["idx"])).otherwise(f["idx"] != "")),
        ("zero_offset_as_free", ~f["zero_offset_as_free"].isin("true", "false")),
        ("zero_offset", (f["kind"] == "inuse") & (off == 0) & (f["zero_offset_as_free"] != "true")),
    ]
    reason = F.lit(None).cast("string")
    for name, failed in reversed(checks):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    again = F.struct(
        _number(f["file_id"]).alias("file_id"), f["file_id"].alias("file_id_text"), num.try_cast("int").alias("obj_num"),
        gen.try_cast("int").alias("obj_gen"), f["kind"].alias("kind"), off.alias("off"),
        F.when(f["kind"] == "compressed", _number(f["idx"])).alias("idx"),
        (f["zero_offset_as_free"] == "true").alias("zero_offset_as_free"), f["note"].alias("note"),
    )
    first = F.struct(
        t["file_id"].alias("file_id"), F.substring_index(raw, ",", 1).alias("file_id_text"), t["obj_num"].alias("obj_num"), t["obj_gen"].alias("obj_gen"),
        t["kind"].alias("kind"), t["off"].cast("bigint").alias("off"), t["idx"].alias("idx"),
        (t["zero_offset_as_free"] == "true").alias("zero_offset_as_free"), F.coalesce(t["note"], F.lit("")).alias("note"),
    )
    held = [F.col(f"`{c}`") for c in lines.columns if c not in ("reason", "entry")]
    told = _once(df, F.struct(F.when(~F.col("_good"), reason).alias("reason")), "_", ("reason",))
    entry = F.when(F.col("_good"), first).when(F.col("_reason").isNull(), again)
    return told.select(*held, F.col("_reason").alias("reason"), entry.alias("entry"))


def valid(lines: DataFrame, text: str = "raw_line", key: str = "line_id") -> DataFrame:
    """The typed valid entries, one row per valid line."""
    return classify(lines, text).where(F.col("reason").isNull()).select(key, "entry.*")


def rejected(lines: DataFrame, text: str = "raw_line") -> DataFrame:
    """The rejected lines with their raw text and reason."""
    return classify(lines, text).where(F.col("reason").isNotNull()).drop("entry")


def load(lines: DataFrame, out: str, text: str = "raw_line") -> None:
    """Write valid and rejected rows in one pass, apart: ``out/status=valid|rejected``."""
    status = F.when(F.col("reason").isNull(), "valid").otherwise("rejected")
    classify(lines, text).withColumn("status", status).write.mode("overwrite").partitionBy("status").parquet(out)
