import datetime as dt
import random

from quire.operators import orphans

T0 = dt.datetime(2024, 1, 1)
REFS = "ref_id BIGINT, file_id BIGINT, ref_num INT, ref_gen INT, seen_at TIMESTAMP, obj_num STRING"
STREAMS = "stream_id BIGINT, file_id BIGINT, length_num INT, length_gen INT, seen_at TIMESTAMP"
OBJECTS = "file_id BIGINT, obj_num INT, obj_gen INT, loaded_at TIMESTAMP, first INT"
XREF = "file_id BIGINT, obj_num INT, obj_gen INT, seq INT, kind STRING"
PARAMS = "file_id BIGINT, undefined_ref_as_null BOOLEAN"


def brute(refs, streams, objects, xref, params):
    lenient = {f for f, u in params if u}
    rows = [("object_refs", i, f, n, g, t) for i, f, n, g, t, _ in refs] + [("streams", *s) for s in streams]
    out = set()
    for table, i, f, n, g, t in rows:
        if None in (f, n, g) or f in lenient:
            continue
        there = [o[3] for o in objects if o[:3] == (f, n, g) and o[3] is not None]
        early = t is not None and any(x <= t for x in there)
        if not early or (f, n, g, 0, "free") in {x[:5] for x in xref}:
            out.add((table, i))
    return out


def run(spark, refs, streams, objects, xref, params):
    return orphans.orphans(
        spark.createDataFrame(refs, REFS), spark.createDataFrame(streams, STREAMS), spark.createDataFrame(objects, OBJECTS),
        spark.createDataFrame(xref, XREF), spark.createDataFrame(params, PARAMS),
    )


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BLOCK", 8)
    r = random.Random(5)
    time = lambda: r.choice([None, *[T0 + dt.timedelta(days=d) for d in range(6)]])
    some = lambda *xs: r.choice([None, *xs, *xs, *xs])
    refs = [(r.randrange(200), some(1, 2, 3), some(*range(30)), some(0, 0, 1), time(), "x") for _ in range(300)]
    refs = list({x[0]: x for x in refs}.values()) + [(1000 + i, 1, 7, 0, T0, None) for i in range(400)]  # one hot target
    refs += refs[:30]
    streams = [(i, some(1, 2), some(*range(30)), 0, time()) for i in range(40)]
    objects = [(some(1, 2, 3), some(*range(25)), some(0, 0, 0, 1), time(), 1) for _ in range(120)]
    xref = [(some(1, 2, 3), some(*range(25)), 0, some(0, 1), some("free", "inuse")) for _ in range(60)]
    params = [(3, True), (3, True), (1, None), (2, False), (None, True)]
    got = [(x.src_table, x.row_id) for x in run(spark, refs, streams, objects, xref, params).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(refs, streams, objects, xref, params)


def test_empty_tables_and_report(spark):
    assert run(spark, [], [], [], [], []).count() == 0
    found = run(spark, [(1, 1, 5, 0, T0, None), (1, 1, 5, 0, T0, None), (2, 1, 6, 0, T0, None)], [], [(1, 6, 0, T0 + dt.timedelta(1), 0)], [], [])
    got = sorted(tuple(r) for r in orphans.report(found).collect())
    assert got == [("object_refs", "2024-01", "late", 1), ("object_refs", "2024-01", "undefined", 1)]


def test_runs(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BLOCK", 4)
    df = spark.createDataFrame([(1, n, 0, T0, 0) for n in (0, 1, 2, 3, 4, 5, 9, 9)], OBJECTS)
    assert sorted((r.run_start, r.run_end) for r in orphans.runs(df).collect()) == [(0, 3), (4, 5), (9, 9)]


def test_a_hot_sound_target_is_heavy(spark):
    """A target that a third of all references name counts as heavy although it is defined, and its rows meet a broadcast only."""
    refs = [(i, 1, 7, 0, T0, None) for i in range(600)] + [(1000 + i, 2, i, 0, T0, None) for i in range(1200)]
    objects = [(1, 7, 0, T0, 0)] + [(2, i, 0, T0, 0) for i in range(600)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = run(spark, refs, [], objects, [], [])
        assert {r.row_id for r in got.collect()} == {1000 + i for i in range(600, 1200)}
        targets = spark.createDataFrame([(1, 7, 0, 600)] + [(2, i, 0, 1) for i in range(1200)], "file_id BIGINT, obj_num INT, obj_gen INT, n BIGINT")
        assert [tuple(r) for r in orphans.heavy_keys(targets, orphans.KEY).collect()] == [(1, 7, 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
