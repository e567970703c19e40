from quire.kernels import literal as L
from quire.operators import classes, getters, shred

TEXT = """<< /Type /Page % comment with << and (
 /Kids [ 1 0 R null << /A#20b (x \\) << [ ) /D <DEAD> >> [ [ 3
 5 R ] ] ] /N -1.5 /S ((nested) (a(b)c)) >>"""


def paths(text, **kw):
    return [(n[2], n[7], n[8]) for n in L.nodes(text, **kw)]


def test_nodes():
    assert paths(TEXT) == [
        ("", "dict", None), ("/Type", "name", "Page"), ("/Kids", "array", None), ("/Kids[0]", "ref", "1 0"), ("/Kids[1]", "null", "null"),
        ("/Kids[2]", "dict", None), ("/Kids[2]/A b", "string", "x \\) << [ "), ("/Kids[2]/D", "hex", "DEAD"), ("/Kids[3]", "array", None),
        ("/Kids[3][0]", "array", None), ("/Kids[3][0][0]", "ref", "3 5"), ("/N", "real", "-1.5"), ("/S", "string", "(nested) (a(b)c)"),
    ]
    assert [p for p, *_ in paths(TEXT, leaves=False)] == ["", "/Kids", "/Kids[0]", "/Kids[2]", "/Kids[3]", "/Kids[3][0]", "/Kids[3][0][0]"]


def test_damaged_and_deep():
    assert paths("") == [] and paths(" % only a comment") == []
    assert paths("<< /A [ 1 0 R", leaves=False) == [("", "dict", None), ("/A", "array", None), ("/A[0]", "ref", "1 0")]
    assert paths("[ ] ] >> 5", leaves=True) == [("", "array", None)]
    deep = paths("[" * 3000 + "]" * 3000, leaves=False)
    assert len(deep) == 3000 and deep[-1][0] == "[0]" * 2999
    assert paths("(" * 50 + ")" * 50)[0][1] == "string"
    assert len(paths("[" + "(a) " * 100_000 + "]")) == 100_001


def test_tables(spark):
    schema = "object_id BIGINT, literal STRING, ord STRING, path INT"
    rows = [(1, TEXT, "x", 1), (1, TEXT, "y", 2), (2, None, None, None), (3, "", None, None), (4, "<</Type/Page/Kids[<</T 1>><</T 2/U 3>>]>>", None, None), (None, "[1 0 R]", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.object_id or 0, r.path) for r in shred.containers(df).collect())
    want = sorted([(1, p) for p in ("/Kids", "/Kids[0]", "/Kids[2]", "/Kids[3]", "/Kids[3][0]", "/Kids[3][0][0]")] + [(4, "/Kids"), (4, "/Kids[0]"), (4, "/Kids[1]"), (0, "[0]")])
    assert got == want
    t = shred.grouped(df)
    assert {k: v.count() for k, v in shred.tables(t).items()} == {"dictionaries": 5, "arrays": 5, "entries": 11, "elements": 9, "references": 3}
    wide = sorted((r.object_id, r.ord, r.k_T, r.k_U) for r in shred.pivot(t, "/Kids[]", ["T", "U"]).collect())
    assert [w[2:] for w in wide if w[0] == 4] == [("1", None), ("2", "3")]
    assert {(r.parent_group, r.elem_name): r.n_dicts for r in shred.groups(t).collect()}["/Kids[]", "T"] == 2
    assert shred.containers(spark.createDataFrame([], schema)).count() == 0


def test_every_group_has_its_table(spark):
    rows = [(1, TEXT), (4, "<</Type/Page/Kids[<</T 1/T null/T 5>><</T 2/U 3/V [1]>>]>>"), (5, "<</Q<</X/a>>>>"), (6, "<<>>"), (7, "<</Z null/Z null>>")]
    df = spark.createDataFrame(rows, "object_id BIGINT, literal STRING")
    t = shred.grouped(df)
    got = shred.pivots(t).collect()
    keys = {}
    for r in shred.groups(t).collect():
        keys.setdefault(r.parent_group, {})[r.elem_name] = r.n_dicts
    for group, names in keys.items():
        here = {(r.object_id, r.ord): r.cells for r in got if r.parent_group == group}
        wide = shred.pivot(t, group, sorted(names)).collect()
        assert len(here) == len(wide)
        assert {k: sum(k in c for c in here.values()) for k in names} == names
        assert all(here[r.object_id, r.ord].get(k) == r[f"k_{k}"] for r in wide for k in names)
    assert [r.cells for r in got if r.object_id == 4 and r.parent_group == "/Kids[]"][0] == {"T": "5"}
    assert {"", "/Kids[]", "/Q"} <= {r.parent_group for r in got}


def test_groups_hold_all_triples(spark):
    df = spark.createDataFrame([(1, TEXT), (1, TEXT), (2, "7"), (3, "5 0 R"), (4, "[" + "[1] " * 10 + "]"), (5, ""), (6, None)], "object_id BIGINT, literal STRING")
    cols = shred._ARROW.names
    a = sorted(map(repr, map(tuple, shred.triples(df).select(cols).collect())))
    b = sorted(map(repr, map(tuple, shred._each(shred.grouped(df, part=3)).select(cols).collect())))
    assert a == b and shred.grouped(df, part=3).where("object_id = 4").count() == 1 + 4 + 10
    assert sorted((r.object_id, r.path) for r in shred.containers(df).where("object_id > 1").collect()) == sorted((4, f"[{i}]") for i in range(10))


def test_getters(spark):
    rows = [(1, "<</A 1/B null/A 2/C[1 2.5]/D[1/x]/E<</C[7]>>>>"), (2, "<</A/x/C[]>>"), (3, "[1 2]"), (4, "<<>>"), (5, None), (6, "<</B null>>")]
    g = shred.grouped(spark.createDataFrame(rows, "object_id BIGINT, literal STRING"), part=1)
    d = getters.dictionaries(g)
    assert {(r.object_id, r.n_entries) for r in getters.lengths(d).where("object_id <> 1").collect()} == {(2, 2), (6, 0)}
    g = shred.grouped(spark.createDataFrame(rows, "object_id BIGINT, literal STRING"))
    d = getters.dictionaries(g)
    assert {(r.object_id, r.n_entries) for r in getters.lengths(d).collect()} == {(1, 4), (2, 2), (6, 0)}
    assert {r.object_id for r in getters.holding(d, "C").collect()} == {1, 2} and getters.holding(d, "B").count() == 0
    assert {tuple(r) for r in getters.typed(d, "A", "integer").collect()} == {(1, "2", None), (2, None, "Expected integer at entry /A")}
    parts = shred.grouped(spark.createDataFrame(rows, "object_id BIGINT, literal STRING"), part=1)
    assert {(r.path, r.n, r["values"], r.error) for r in getters.arrays_of(parts, "C", "number", 2).collect()} == {("/C", 2, "1 2.5", None), ("/E/C", 1, None, "Expected array of size 2")}
    assert [r.error for r in getters.arrays_of(parts, "D", "number").collect()] == ["Expected array of numbers"]
    assert getters.fold(d).where("key = 'A'").count() == 2 and getters.lengths(getters.dictionaries(g.limit(0))).count() == 0


def test_classes(spark):
    rows = [(1, "<</Type/Page/Odd 1/MediaBox[0 0 1 1]/Parent null>>"), (1, "<</Type/Page/Odd 1/MediaBox[0 0 1 1]/Parent null>>"), (2, "<</Type/Catalog/Pages 2 0 R>>"), (3, "<</Type/Unknown/A 1>>"), (4, "<</A 1>>"), (5, "[1]"), (6, None), (7, "<</Ty#70e/Pages/Count 1>>")]
    df = spark.createDataFrame(rows, "object_id BIGINT, literal STRING")
    assert {tuple(r) for r in classes.missing(df).collect()} == {(1, "page", "Parent"), (7, "pageroot", "Kids")}
    assert [tuple(r) for r in classes.unexpected(df).collect()] == [("page", "Odd", 1)]
    assert classes.missing(df.limit(0)).count() == 0
