import re

from hypothesis import given, settings, strategies as st

from quire.operators import rejects

SCHEMA = "line_id BIGINT, raw_line STRING"


def fields(s):
    """A plain state machine over the characters; None where the quoting is broken."""
    out, i, n = [], 0, len(s)
    while True:
        if i < n and s[i] == '"':
            j, b = i + 1, []
            while True:
                if j >= n:
                    return None
                if s[j] == '"':
                    if j + 1 < n and s[j + 1] == '"':
                        b.append('"')
                        j += 2
                        continue
                    break
                b.append(s[j])
                j += 1
            out.append("".join(b))
            i = j + 1
            if i < n and s[i] != ",":
                return None
        else:
            j = s.find(",", i)
            j = n if j < 0 else j
            f = s[i:j]
            if '"' in f or "\n" in f or "\r" in f:
                return None
            out.append(f)
            i = j
        if i >= n:
            return out
        i += 1


def valid(s):
    f = fields(s) if s else None
    if f is None or len(f) != 8:
        return False
    digits = lambda x: re.fullmatch("[0-9]+", x) is not None
    if not all(digits(f[i]) for i in (0, 1, 2, 4)) or int(f[1]) > 2147483647 or int(f[4]) > 2147483647 or int(f[2]) > 65535:
        return False
    if f[3] not in ("free", "inuse", "compressed") or f[6] not in ("true", "false"):
        return False
    if (f[3] == "compressed" and not digits(f[5])) or (f[3] != "compressed" and f[5]):
        return False
    return not (f[3] == "inuse" and int(f[4]) == 0 and f[6] != "true")


GOOD = '1,2,0,inuse,15,,true,note'
LINES = [
    GOOD, '"1","2","0","inuse","15","","true","a ""b"", c"', '1,2,0,inuse,15,,true,"two\nlines"', "1,2,0,inuse,15,,true,", "007,2,00,free,0,,false,x",
    "1,2,0,compressed,5,3,false,x", "1,2,0,compressed,5,,false,x", "1,2,0,inuse,0,,false,x", "1,2,0,inuse,0,,true,x", "1,2,70000,inuse,5,,true,x",
    "1,2147483648,0,inuse,5,,true,x", "1,2,0,inuse,99999999999999999999,,true,x", "+1,2,0,inuse,5,,true,x", " 1,2,0,inuse,5,,true,x", "1,2,0,Inuse,5,,true,x",
    "1,2,0,inuse,5,,TRUE,x", '1,2,0,inuse,5,,true,"x', '1,2,0,inuse,5,,true,"x"y', '1,2,0,inuse,5,,true,x"y', "1,2,0,inuse,5,,true,x,y", "1,2,0", "", None, "   ", '"', '""', '"""', ",,,,,,,",
    "1,2,0,inuse,5,,true,x\ny", "1,2,0,inuse,15,9,true,x", '1,2,0,inuse,15,"",true,\\', '1,2,0,inuse,15,,true,"\\"', "99999999999999999999999,2,0,inuse,15,,true,x",
    '1,2,0,inuse,15,,true,"' + 'ab""' * 50_000 + '"', "1,2,0,inuse,15,,true," + "z" * 200_000, '1,"2,0,inuse,15,,true,x', "१,2,0,inuse,5,,true,x", "1,2,0,inuse,5,,true,ünïcode ✓",
]


def test_reasons_and_values(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), SCHEMA)
    bad = {r.line_id for r in rejects.rejected(df).select("line_id").collect()}
    assert bad == {i for i, s in enumerate(LINES) if not valid(s)}
    for r in rejects.valid(df).collect():
        f = fields(LINES[r.line_id])
        assert (r.file_id_text, r.obj_num, r.obj_gen, r.kind, r.off, r.note) == (f[0], int(f[1]), int(f[2]), f[3], int(f[4]), f[7])
        assert r.idx == (int(f[5]) if f[3] == "compressed" else None)
    reasons = {r.line_id: r.reason for r in rejects.rejected(df).collect()}
    assert reasons[21] == "missing" and reasons[22] == "missing" and reasons[16] == "quoting" and reasons[19] == "field_count" and set(reasons.values()) <= set(rejects.REASONS)


def test_empty_repeated_and_clashing(spark):
    assert rejects.rejected(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, GOOD, "a", 1), (1, GOOD, "a", 1), (2, "x", "b", 2)], SCHEMA + ", reason STRING, kind INT")
    assert rejects.valid(df).count() == 2
    assert [r.reason for r in rejects.rejected(df).collect()] == ["field_count"]


def test_load_writes_both_parts(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(LINES)), SCHEMA)
    rejects.load(df, str(tmp_path / "out"))
    got = {r.status: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("status").count().collect()}
    n = sum(map(valid, LINES))
    assert got == {"valid": n, "rejected": len(LINES) - n}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(['"', '""', ",", "1", "2", "true", "inuse", "\n", "a", '"1"', ",0,"]), max_size=24).map("".join), min_size=20, max_size=60))
def test_any_line(spark, lines):
    lines = [x for s in lines for x in (s, "1,2,0,inuse,5,,true," + s)]
    df = spark.createDataFrame(list(enumerate(lines)), SCHEMA)
    bad = {r.line_id for r in rejects.rejected(df).select("line_id").collect()}
    assert bad == {i for i, s in enumerate(lines) if not valid(s)}


def test_no_line_fails_the_job(spark, tmp_path):
    many = "," * 25_000
    lines = [
        GOOD, many, GOOD + many, '1,2,0,inuse,15,,true,"' + many + '"', '1,"2' + many, '1,2,0,inuse,15,,true,"x"' + many, '1,2,0,inuse,15,,true,"x"y' + many,
        "1,2,0,inuse,15,,true," + "z" * 10_000_000, '1,2,0,inuse,15,,true,"' + "z" * 10_000_000, "," * 511, "," * 512, '"' * 30_001, "1,2,0,inuse,15,,true\n,x" + many,
    ]
    df = spark.createDataFrame(list(enumerate(lines)), SCHEMA)
    want = {i: None if valid(s) else "field_count" if fields(s) else "quoting" for i, s in enumerate(lines)}
    assert {r.line_id: r.reason for r in rejects.classify(df).select("line_id", "reason").collect()} == want
    assert {r.line_id for r in rejects.rejected(df).select("line_id", "raw_line").collect()} == {i for i, w in want.items() if w}
    assert {(r.line_id, len(r.note)) for r in rejects.valid(df).collect()} == {(0, 4), (3, 25_000), (7, 10_000_000)}
    rejects.load(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("reason is not null").count() == len(lines) - 3


def test_the_reader_is_no_more_lenient_than_the_format(spark):
    lines = ["1,-2,0,inuse,5,,true,x", "1,2,+0,inuse,5,,true,x", "1,2,0,inuse,5,,True,x", "1,2,0,compressed,5,\u0663,true,x", "1,2,0,compressed,5,-3,true,x", "1,,0,inuse,5,,true,x", "1,2,0,free,5,7,true,x"]
    df = spark.createDataFrame(list(enumerate(lines)), SCHEMA)
    got = {r.line_id: r.reason for r in rejects.classify(df).collect()}
    assert got == dict(enumerate(["obj_num", "obj_gen", "zero_offset_as_free", "idx", "idx", "obj_num", "idx"]))
