"""Frequency of every distinct term, by heavy-light aggregation.

Two passes.  The first finds the terms that may be heavy with a bounded
frequent-items summary per partition (every term with more than 1/k of a
partition's rows survives in it).  The second counts heavy terms in exact local
counter arrays, so that a partition sends one number per heavy term however
often it occurs, and sends pre-aggregated (term, record) counts of the rest;
both count tables are then united.  Counts are exact whatever the first pass
finds; it only decides what is counted where.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quire.functions.names import unescape
from quire.session import Scratch

SUMMARY = 512  # entries of a partition's summary
HEAVY_MAX = 256  # heavy terms at most
HEAVY_CHARS = 256  # longer terms are never broadcast
FLUSH = 200_000

_FOUND = "field STRING, term STRING, n BIGINT"
_PARTIAL = "heavy BOOLEAN, field STRING, term STRING, record BIGINT, n BIGINT"
_PARTIAL_ARROW = pa.schema([("heavy", pa.bool_()), ("field", pa.string()), ("term", pa.string()), ("record", pa.int64()), ("n", pa.int64())])


def terms(object_names: DataFrame, streams: DataFrame) -> DataFrame:
    """(field, term, record) of every name and filter name; nulls are no terms."""
    names = object_names.where("val_name is not null").select(F.lit("name").alias("field"), unescape(F.col("val_name")).alias("term"), F.col("file_id").alias("record"))
    each = F.explode(F.regexp_extract_all("filter_text", F.lit(r"/([^\s\x00/()<>\[\]{}%]*)"), 1))
    filters = streams.where("filter_text is not null").select(each.alias("term"), F.col("file_id").alias("record"))
    return names.unionByName(filters.select(F.lit("filter").alias("field"), unescape(F.col("term")).alias("term"), "record"))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], int] = {}
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["field", "term"]).aggregate([([], "count_all")])
        for field, term, n in zip(*(t.column(c).to_pylist() for c in ("field", "term", "count_all"))):
            held[field, term] = held.get((field, term), 0) + n
        if len(held) > SUMMARY:  # take the (SUMMARY+1)-th largest count from all, as Misra and Gries do
            least = sorted(held.values(), reverse=True)[SUMMARY]
            held = {k: n - least for k, n in held.items() if n > least}
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), pa.array([k[1] for k in held]), pa.array(held.values(), pa.int64())], names=["field", "term", "n"])


def heavy_terms(t: DataFrame) -> list[tuple[str, str]]:
    """At most HEAVY_MAX candidate heavy terms of at most HEAVY_CHARS characters each."""
    found = t.where((F.length("term") <= HEAVY_CHARS) & F.col("field").isNotNull()).select("field", "term").mapInArrow(_summary, _FOUND)
    top = found.groupBy("field", "term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "field", "term").limit(HEAVY_MAX)
    return [(r.field, r.term) for r in top.collect()]


def _counter(heavy: list[tuple[str, str]]):
    keys = [f"{f}\x00{t}" for f, t in heavy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(keys, pa.string())
        counters = np.zeros(len(keys), np.int64)
        pairs: list[pa.Table] = []
        light: list[pa.Table] = []
        held = 0

        def pack(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by(tables[0].column_names[:-1], use_threads=False).aggregate([("n", "sum")]).rename_columns(tables[0].column_names)

        def flush() -> Iterator[pa.RecordBatch]:
            for tables, is_heavy in ((pairs, True), (light, False)):
                if tables:
                    t = pack(tables)
                    if is_heavy:
                        hid = t.column("hid").combine_chunks()
                        cols = [pa.array([heavy[i][j] for i in hid.to_pylist()], pa.string()) for j in (0, 1)]
                        n = pa.array(np.zeros(len(t), np.int64))
                    else:
                        cols, n = [t.column("field").combine_chunks(), t.column("term").combine_chunks()], t.column("n").combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array([is_heavy] * len(t), pa.bool_()), *cols, t.column("record").combine_chunks(), n], schema=_PARTIAL_ARROW)
                    tables.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            field, term, record = batch.column(0), batch.column(1), batch.column(2)
            hid = pc.index_in(pc.binary_join_element_wise(field, term, "\x00"), value_set=known)
            is_light = hid.is_null()
            hot = pc.invert(is_light)
            ids = hid.filter(hot)
            counters += np.bincount(ids.to_numpy(), minlength=len(keys)).astype(np.int64)
            ones = pa.array(np.ones(batch.num_rows, np.int64))
            for to, names, cols in ((pairs, ["hid", "record", "n"], [ids, record.filter(hot), ones.slice(0, len(ids))]), (light, ["field", "term", "record", "n"], [field.filter(is_light), term.filter(is_light), record.filter(is_light), ones.slice(0, batch.num_rows - len(ids))])):
                if len(cols[0]):
                    to.append(pack([pa.table(cols, names=names)]))
                    held += len(to[-1])
            if held > FLUSH:
                if pairs:
                    pairs[:] = [pack(pairs)]
                yield from flush()
                held = 0
        yield from flush()
        some = np.flatnonzero(counters)
        if len(some):
            cols = [pa.array([heavy[i][j] for i in some], pa.string()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(some)), *cols, pa.nulls(len(some), pa.int64()), pa.array(counters[some])], schema=_PARTIAL_ARROW)

    return run


def counts(t: DataFrame) -> DataFrame:
    """(field, term, occurrences, n_records) of all (field, term, record) rows.

    Null terms or fields are left out; a null record counts as an occurrence
    but not as a record; equal rows are separate occurrences; the empty term is
    a term.  Terms of any length are counted.  Empty input gives no rows.
    """
    t = t.where("field is not null and term is not null").select("field", "term", F.col("record").cast("bigint").alias("record"))
    part = Scratch(t.sparkSession, "terms").cut(t.mapInArrow(_counter(heavy_terms(t)), _PARTIAL))
    total, records = F.sum("n").cast("bigint").alias("occurrences"), F.count("record").alias("n_records")
    # Heavy terms and those too long to be one are spread over (term, record); the others' groups are small, so one shuffle on the term serves both steps.
    wide = F.col("heavy") | (F.length("term") > HEAVY_CHARS)
    by_record = lambda df: df.groupBy("field", "term", "record").agg(F.sum("n").alias("n")).groupBy("field", "term").agg(total, records)
    return by_record(part.where(wide)).unionByName(by_record(part.where(~wide).repartition("field", "term")))


def marked(c: DataFrame, n_records: int, rare: int = 3, common: float = 0.5) -> DataFrame:
    """``counts`` with ``mark``: rare (fewer than ``rare`` records), common (more than that share) or kept."""
    mark = F.when(F.col("n_records") < rare, "rare").when(F.col("n_records") > common * n_records, "common").otherwise("kept")
    return c.withColumn("mark", mark)
