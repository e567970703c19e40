from collections import Counter, defaultdict

from quire.llm import terms

SCHEMA = "field STRING, term STRING, record BIGINT, n INT"


def brute(rows):
    n, records = Counter(), defaultdict(set)
    for f, t, r, _ in rows:
        if f is not None and t is not None:
            n[f, t] += 1
            if r is not None:
                records[f, t].add(r)
    return {k: (c, len(records[k])) for k, c in n.items()}


def test_counts_whatever_is_heavy(spark, monkeypatch):
    rows = [("name", "hot", i % 37, 0) for i in range(4000)] + [("name", f"t{i % 300}", i % 11, 0) for i in range(3000)]
    rows += [("filter", "hot", 1, 0), ("name", "", 5, 0), ("name", "", None, 0), (None, "x", 1, 0), ("name", None, 1, 0), ("name", "long" * 5000, 3, 0), ("filter", "ünï✓", 2, 0)] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    for heavy, flush in ((256, 200_000), (3, 50), (0, 200_000)):
        monkeypatch.setattr(terms, "HEAVY_MAX", heavy)
        monkeypatch.setattr(terms, "FLUSH", flush)
        got = [((r.field, r.term), (r.occurrences, r.n_records)) for r in terms.counts(df).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_summary_keeps_every_frequent_term(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(terms, "SUMMARY", 4)
    words = ["a"] * 300 + ["b"] * 250 + [f"x{i}" for i in range(400)]
    words = [words[i * 7 % len(words)] for i in range(len(words))]
    batches = [pa.RecordBatch.from_pydict({"field": ["f"] * 50, "term": words[i : i + 50]}) for i in range(0, 950, 50)]
    found = {t for b in terms._summary(iter(batches)) for t in b.column(1).to_pylist()}
    assert {"a", "b"} <= found and len(found) <= 4


def test_terms_are_decoded(spark):
    names = spark.createDataFrame([(1, "A#20b"), (1, "#41#4a"), (2, None), (2, "a#2"), (3, "#C3x"), (3, "a#23b")], "file_id BIGINT, val_name STRING")
    streams = spark.createDataFrame([(1, "[ /A /B#43\n/A]"), (2, None), (2, "[]"), (3, "/Flate#44ecode")], "file_id BIGINT, filter_text STRING")
    got = sorted((r.field, r.term, r.record) for r in terms.terms(names, streams).collect())
    assert got == sorted([("name", "A b", 1), ("name", "AJ", 1), ("name", "a#2", 2), ("name", "\xc3x", 3), ("name", "a#b", 3), ("filter", "A", 1), ("filter", "BC", 1), ("filter", "A", 1), ("filter", "FlateDecode", 3)])


def test_empty_and_marks(spark):
    assert terms.counts(spark.createDataFrame([], SCHEMA)).count() == 0
    c = spark.createDataFrame([("f", "a", 9, 2), ("f", "b", 9, 3), ("f", "c", 9, 5), ("f", "d", 9, 6)], "field STRING, term STRING, occurrences BIGINT, n_records BIGINT")
    assert [r.mark for r in terms.marked(c, 10).orderBy("term").collect()] == ["rare", "kept", "kept", "common"]
