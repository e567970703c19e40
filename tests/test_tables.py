import random

import pytest

from quire.kernels import fixtures
from quire.kernels.model import Options
from quire.operators import blocks, graph, layout, verbs
from quire.sources import datasource, pdf
from quire.streaming import ingest
from pyspark.sql import functions as F

FILES = {"a": fixtures.hello_file("alpha"), "b": fixtures.hello_file("beta", "FlateDecode"), "broken": b"%PDF-1.4\nnothing", "empty": b""}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for name, data in FILES.items():
        (d / f"{name}.pdf").write_bytes(data)
    return d


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(i, bytearray(b), "x") for i, b in enumerate(FILES.values())] + [(9, None, "x")], "file_id BIGINT, content BINARY, kind STRING")


def test_every_table(spark, files, tmp_path):
    out = str(tmp_path / "t")
    pdf.ingest(files, out)
    want = {"xref_entries": 14, "trailers": 2, "objects": 12, "streams": 2, "content_ops": 10, "obj_types": 12, "extents": 19, "diagnostics": 3, "stats": 5}
    for t, n in want.items():
        assert pdf.stored(spark, out, t).count() == n, t
    a = pdf.parse(files, "nodes").orderBy("file_id", "key_kind", "obj_num", "node_id").collect()
    assert a == pdf.stored(spark, out, "nodes").orderBy("file_id", "key_kind", "obj_num", "node_id").collect()
    assert {(r.file_id, r.first_error is None) for r in pdf.stored(spark, out, "stats").collect()} == {(0, True), (1, True), (2, False), (3, False), (9, False)}
    assert pdf.parse(files.limit(0), "nodes").count() == 0


def test_verbs(spark, files):
    nodes = pdf.parse(files, "nodes")
    assert [(r.file_id, r.obj_num, r.path) for r in verbs.find_ref(nodes, 5).orderBy("file_id").collect()] == [(0, 3, "/Resources/Font/F1"), (1, 3, "/Resources/Font/F1")]
    assert {(r.obj_num, r.path) for r in verbs.find_name(nodes, "Font").where("file_id = 0").collect()} == {(3, "/Resources\\Font"), (5, "/Type")}
    assert {(r.n, r.n_objects) for r in verbs.occurrences(verbs.find_name(nodes, "Type")).collect()} == {(4, 4)}
    assert {r.file_id: r.value is None for r in verbs.xref(files).collect()} == {0: False, 1: False, 2: True, 3: True, 9: True}
    clean = verbs.cleanup(files).where("error is null").collect()
    assert len(clean) == 2 and all(r.value.startswith(b"%PDF-1.7") for r in clean)
    assert [bytes(r.data) for r in verbs.object_stream(files, 4, decoded=True).where("file_id = 1").collect()] == [b"BT /F1 12 Tf 10 20 Td (beta) Tj ET"]
    assert verbs.object_text(files, 6).where("file_id = 0").first().value.startswith("<<\n    /Title (text)")
    assert "undeclared object" in verbs.object_text(files, 77).where("file_id = 0").first().error
    assert verbs.type_registry(spark)["classes"].count() == 115
    for v in (verbs.extract, verbs.dot, verbs.visjs, verbs.locations, verbs.holes, verbs.types):
        assert v(files).where("file_id = 0").first().error is None
    assert verbs.stats(files, Options(strict=True)).where("first_error is null").count() == 2


def test_sources_and_stream(spark, folder, tmp_path):
    assert pdf.parse(pdf.read(spark, str(folder)), "stats").count() == 3  # the scan leaves out empty files
    datasource.register(spark)
    rows = spark.read.format("quire_pdf").option("table", "obj_types").load(str(folder)).collect()
    assert len(rows) == 12 and {r.path.rsplit("/", 1)[1] for r in rows} == {"a.pdf", "b.pdf"}
    rows = spark.read.format("quire_pdf").option("table", "stats").load(str(folder / "*.pdf")).collect()
    assert {r.path.rsplit("/", 1)[1]: r.objcount for r in rows} == {"a.pdf": 6, "b.pdf": 6, "broken.pdf": -1, "empty.pdf": -1}
    assert spark.read.format("quire_pdf").load(str(folder / "none")).count() == 0
    some = pdf.read(spark, [str(folder / "a.pdf"), str(folder / "nowhere.pdf")])
    assert [(r.message, r.severity) for r in pdf.parse(some, "diagnostics").collect()] == [("No such file", "error")]
    assert pdf.parse(pdf.read(spark, str(folder / "nowhere.pdf")), "stats").first().first_error == "PDF error : No such file !"
    q = ingest.follow(ingest.files(spark, str(folder), 2), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("tbl = 'stats'").count() == 3 and got.where("tbl = 'objects'").count() == 12


@pytest.mark.parametrize("local_max", [1000, 10])
def test_closure_renumber_relink(spark, local_max):
    r = random.Random(7)
    links = [(f, r.randrange(20), r.randrange(20)) for f in range(3) for _ in range(25)] + [(5, i, i + 1) for i in range(8)] + [(None, 1, 2), (1, None, 3), (1, 2, None)]
    starts = [(f, r.randrange(20)) for f in range(3)] + [(5, 0), (6, 4)]
    want = set()
    for f, s in starts:
        todo = [s]
        while todo:
            v = todo.pop()
            if (f, v) not in want:
                want.add((f, v))
                todo += [b for g, a, b in links if g == f and a == v and b is not None]
    l, s = spark.createDataFrame(links, "file_id BIGINT, src BIGINT, dst BIGINT"), spark.createDataFrame(starts, "file_id BIGINT, node BIGINT")
    got = [tuple(x) for x in graph.closure(l, s, local_max).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    reached = spark.createDataFrame(sorted(want), "file_id BIGINT, node BIGINT")
    numbers = {(x.file_id, x.node): x.new_num for x in graph.renumber(reached).collect()}
    for f in {f for f, _ in want}:
        assert [numbers[f, n] for g, n in sorted(want) if g == f] == list(range(1, sum(g == f for g, _ in want) + 1))
    back = graph.relink(l.na.drop().distinct(), graph.renumber(reached)).collect()
    assert {tuple(x) for x in back} == {(f, numbers[f, a], numbers[f, b]) for f, a, b in links if (f, a) in numbers and (f, b) in numbers}


def test_blocks_equal_whole_windows(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, None]), i, r.randrange(-5, 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "g INT, o INT, v BIGINT")
    block = F.floor(F.col("o") / 7)
    run = {x.o: x.s for x in blocks.running(df, ["g"], ["o"], block, F.col("v"), "s").collect()}
    top = {x.o: x.s for x in blocks.running(df, ["g"], ["o"], block, F.col("v"), "s", how="max").collect()}
    prev = {x.o: x.prev for x in blocks.previous(df, ["g"], ["o"], block, F.col("v")).collect()}
    for g in (1, 2, None):
        mine = [x for x in rows if x[0] == g]
        for i, (_, o, _) in enumerate(mine):
            before = [v for _, _, v in mine[: i + 1]]
            assert run[o] == sum(before) and top[o] == max(before) and prev[o] == (mine[i - 1][2] if i else None)


def test_layout(spark):
    rows = [(1, 1, 0, 0, 5), (1, 2, 0, 5, 9), (1, 3, 0, 20, 29), (1, 3, 0, 20, 29), (1, 4, 0, 3_000_000, 3_000_009), (2, 1, 0, None, None)]
    ext = layout.extents(spark.createDataFrame(rows, "file_id BIGINT, obj_num INT, obj_gen INT, low BIGINT, high BIGINT"))
    files = spark.createDataFrame([(1, 3_000_020), (2, 7), (3, None)], "file_id BIGINT, length BIGINT")
    assert [(r.obj_num, r.prev_num) for r in layout.overlaps(ext).collect()] == [(2, 1)]
    assert sorted(tuple(r) for r in layout.gaps(ext, files).collect()) == [(1, 10, 10), (1, 30, 2_999_970), (1, 3_000_010, 10), (2, 0, 7)]


def test_closure_of_a_deep_graph(spark):
    links = spark.createDataFrame([(1, i, i + 1) for i in range(40)], "file_id BIGINT, src BIGINT, dst BIGINT")
    starts = spark.createDataFrame([(1, 3)], "file_id BIGINT, node BIGINT")
    assert sorted(r.node for r in graph.closure(links, starts, 5).collect()) == list(range(3, 41))


def test_nulled_and_left_union(spark):
    refs = spark.createDataFrame([(1, 1, 0, 5, 0), (1, 2, 0, 6, 0), (1, 2, 0, 6, 0), (1, 3, 0, None, 0), (None, 1, 0, 5, 0)] + [(1, 9, 0, 5, 0)] * 50 + [(2, 1, 0, 7, 0)] * 50, "file_id BIGINT, src_num INT, src_gen INT, ref_num INT, ref_gen INT")
    objects = spark.createDataFrame([(1, 5, 0), (1, 5, 0)], "file_id BIGINT, obj_num INT, obj_gen INT")
    got = graph.nulled(refs, objects).groupBy("file_id", "src_num", "ref_num").count().collect()
    assert {(r.file_id, r.src_num, r.ref_num): r["count"] for r in got} == {(1, 1, 5): 1, (1, 2, None): 2, (1, 3, None): 1, (None, 1, 5): 1, (1, 9, 5): 50, (2, 1, None): 50}
    a, b = spark.createDataFrame([(1, "a"), (None, "b")], "k INT, v STRING"), spark.createDataFrame([(1, "x"), (None, "y"), (2, "z"), (2, "z")], "k INT, v STRING")
    assert sorted((str(r.k), r.v) for r in graph.left_union(a, b, ["k"]).collect()) == [("1", "a"), ("2", "z"), ("2", "z"), ("None", "b")]


def test_verbs_over_a_missing_target(spark):
    files = spark.createDataFrame([(i, bytearray(fixtures.varied(n, "t", 2))) for i, n in enumerate(("plain", "undefined"))], "file_id BIGINT, content BINARY")
    got = {(r.file_id, r.obj_num): r.defined for r in verbs.closure(pdf.parse(files, "nodes")).collect()}
    assert got == {(f, n): True for f in (0, 1) for n in range(1, 7)} | {(1, 50): False}
