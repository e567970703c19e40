import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
SOME = ["p2_found", "p4_found", "p5_found", "find_name", "graph_neighbors", "sanitize_nums", "undefined_refs", "xref_heads", "xref_report", "holes", "filter_histogram", "name_forms", "content_dfa", "qq_balance", "adler32", "pdf_stats", "pdf_xref", "p2_rejected", "p3_found", "p3_tables", "p3_outline_table", "p5_descendants", "inline_targets", "undefined_to_null", "class_mandatory", "pdf_type_registry", "page_runs", "dict_lengths", "typed_integers", "arrays_of_numbers", "varied_stream", "varied_overlaps", "varied_stats", "varied_report", "varied_content", "varied_titles", "varied_merged", "varied_closure", "varied_visjs"]
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for f in os.listdir(D):
        con.sql(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    return con


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {"p2_found", "p3_found", "p4_found", "p5_found"} <= set(q)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(cols).collect())))
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
