import pytest

from quire.llm import mojibake as M
from tests.llm import planted as P

GOOD = [
    "número página función código según también", "Größe ändert Schlüssel während für Straße", "référence élément été déjà façon où",
    "память чтение удалить ошибка строка файл", "değişiklik için çözüm açık kayıt ışık", "pamięć część gałąź źródło być żądanie",
    "設定を変わる検索エラー更新ファイルテスト", "a — b “quoted” it’s 30 °C ✓", "čtení výstup řádek žádný můžeme",
]
PAIRS = [
    (0, "utf-8", "cp1252"), (1, "utf-8", "latin-1"), (2, "utf-8", "mac_roman"), (2, "cp1252", "mac_roman"), (3, "utf-8", "cp1251"), (3, "koi8-r", "cp1251"),
    (3, "cp1251", "cp1252"), (4, "cp1254", "cp1252"), (5, "cp1250", "cp1252"), (5, "utf-8", "cp437"), (6, "shift_jis", "cp1252"), (6, "utf-8", "cp1252"), (8, "cp1250", "cp1252"), (7, "utf-8", "cp1252"),
]


def table():
    df = {}
    for line in GOOD:
        for w in M.words(line):
            df[w] = 50
    return df


def test_garbled_text_is_restored_and_good_text_left():
    m = M.Matcher(*M.patterns(table()))
    for line in GOOD:
        assert m.spans(line) == [], line
        mixed = "x = 1; " + line
        assert m.repair(mixed) == mixed
    for at, true, wrong in PAIRS:
        bad = M.garble(GOOD[at], true, wrong)
        assert m.spans(bad), (true, wrong)
        if at != 7:
            assert m.repair(bad) == GOOD[at], (true, wrong)
        assert m.repair(GOOD[3] + " | " + bad).startswith(GOOD[3] + " | ")
    twice = M.garble(M.garble(GOOD[1], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert m.repair(twice) == GOOD[1]


@pytest.mark.parametrize("text", ["├── src\n│   ├── a.py\n│   └── b.py", "NÃO AÇÃO", "5 × 3 ± 2 ½ µs", "Ødgik Çelö Žalova", "Рёбра шибко", "àéîõü ÀÉÎÕÜ ñ ß", *P.DECOYS])
def test_decoys(text):
    m = M.Matcher(*M.patterns(table()))
    assert all(m.spans(line) == [] for line in text.split("\n"))


def test_query(spark):
    rows = [(i, t, 0) for i, t in enumerate(GOOD * 6)]
    bad = M.garble(GOOD[0], "utf-8", "cp1252")
    rows += [(100, f"ok\n{bad}\n{GOOD[4]}", 0), (101, "lost Schl�ssel", 0), (102, None, 0), (103, "", 0), (104, "plain", 0), (105, "é" * 100_000, 0), (106, bad + "\n" + "x" * 200_000, 0), (106, bad, 0)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, spans INT")
    got = M.garbled(df).collect()
    assert sorted(r.doc_id for r in got) == [100, 101, 106, 106]
    by = {r.doc_id: r for r in got}
    assert by[100].repaired == f"ok\n{GOOD[0]}\n{GOOD[4]}" and by[101].repaired is None and by[101].lost == 1
    assert sorted(r.doc_id for r in M.garbled(df, repair=False).select("doc_id").distinct().collect()) == [100, 101, 106]
    assert M.garbled(df.limit(0)).count() == 0


def test_rare_words(spark):
    bad = {i: M.garble(w, "cp1250", "cp1252") for i, w in enumerate(["čeština", "příklad"])}
    rows = [(i, t) for i, t in enumerate([*GOOD * 6, *["čeština"] * 2, *["příklad"] * 3])]
    rows += [(100 + i, f"x {b} y") for i, b in bad.items()]
    got = M.garbled(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert sorted((r.doc_id, r.repaired) for r in got) == [(100, "x čeština y"), (101, "x příklad y")]


def test_text_garbled_many_times_is_restored():
    m = M.Matcher(*M.patterns(table()))
    bad = GOOD[1]
    for _ in range(6):
        bad = M.garble(bad, "utf-8", "cp1252")
    assert m.repair(bad) == GOOD[1]


def test_repair_that_goes_in_a_circle_ends():
    assert M.Matcher({"éà": ("àé", M.STRONG, False), "àé": ("éà", M.STRONG, False)}).repair("éà") == "éà"


@pytest.mark.parametrize("c", ["ế", "ש", "ع", "한", "ก", "Ω", "ж", "中", "﷼", "😀", "𝒳", "\ufeff", "ნ"])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp1253"])
def test_characters_of_every_plane_without_any_words(c, wrong):
    m = M.Matcher({})
    bad = M.garble(c * 3, "utf-8", wrong)
    spans = m.spans(f"a {bad} b")
    assert spans[0][0] == 2 and spans[-1][1] == 2 + len(bad) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    if wrong == "cp1252":
        assert m.repair(f"a {bad} b") == f"a {c * 3} b"


def test_lost_characters_and_spans_are_counted_apart():
    m = M.Matcher({})
    assert m.read("ok \ufffd x \x81") == ([], 2) and m.read("r\xc3\xa9 \ufffd") == ([(1, 3, "é")], 1) and m.read("\x85") == ([], 0)


def test_long_words_are_taken_in_pieces(spark):
    long = "длинноеслово" * 30
    rows = [(i, long) for i in range(5)] + [(9, M.garble(long, "cp1251", "cp1252")), (10, "é" * 5000)]
    got = M.garbled(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert [(r.doc_id, r.repaired == long) for r in got] == [(9, True)]


def test_planted_pairs(spark):
    docs, truth = P.corpus(seed=3, sound=40, bad=1)
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(4)
    got = {r.doc_id: r for r in M.garbled(df).collect()}
    table, wrong = P.measure({d: r.repaired for d, r in got.items()}, truth)
    n, found, restored = (sum(x[i] for x in table.values()) for i in range(3))
    assert not wrong and n > 500 and found >= 0.97 * n and restored >= 0.85 * n
    assert {r.doc_id for r in M.garbled(df, repair=False).collect()} == set(got)
    # Blocks of any size give the same rows.
    assert {r.doc_id: r for r in M.garbled(df, block=3000).collect()} == got
    assert {r.doc_id for r in M.garbled(df, repair=False, block=3000).collect()} == set(got)
