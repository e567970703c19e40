import datetime as dt
import random

import pytest

from quire.operators import hierarchy

SCHEMA = "grp BIGINT, node BIGINT, parent BIGINT"


def brute(rows):
    par = {(g, n): p for g, n, p in rows}
    out, size = {}, {}
    for g, n in par:
        path, seen = [n], {n}
        while (p := par[g, path[-1]]) is not None and (g, p) in par:
            if p in seen:
                path = None
                break
            seen.add(p)
            path.append(p)
        out[g, n] = path[::-1] if path else None
        for a in path or []:
            size[g, a] = size.get((g, a), 0) + 1
    return out, size


def forest(seed):
    r = random.Random(seed)
    rows = {}
    for g in range(4):
        n = r.choice([1, 5, 30, 60])
        for v in range(n):
            rows[g, v] = r.choice([None, max(0, v - 1), v - 1 if v else None, r.randrange(n), r.randrange(n + 3), r.randrange(max(1, v)) if v else None])
    rows.update({(9, v): v - 1 if v else None for v in range(130)})  # a chain
    rows.update({(10, v): 0 if v else None for v in range(80)})  # a star
    rows.update({(11, v): (v + 1) % 5 for v in range(5)} | {(11, 7): 3})  # a cycle and a node below it
    return [(g, v, p) for (g, v), p in rows.items()]


@pytest.mark.parametrize("local_max", [100_000, 40])
def test_against_brute_force(spark, local_max):
    rows = forest(3)
    path, size = brute(rows)
    h = hierarchy.decompose(spark.createDataFrame(rows, SCHEMA), local_max)
    got = {(r.grp, r.node): r for r in hierarchy.paths(h).collect()}
    assert set(got) == set(path)
    for k, r in got.items():
        want = path[k]
        assert (r.root, r.depth, r.size, r.path) == ((None, None, None, None) if want is None else (want[0], len(want) - 1, size[k], want)), k


def test_descendants_and_segments(spark):
    rows = forest(8)
    path, _ = brute(rows)
    h = hierarchy.decompose(spark.createDataFrame(rows, SCHEMA))
    got = [tuple(r) for r in hierarchy.descendants(h).collect()]
    want = {(g, a, n) for (g, n), p in path.items() for a in (p or [])[:-1]}
    assert len(got) == len(set(got)) and set(got) == want


def test_links_reads_every_form(spark):
    t = dt.datetime(2024, 1, 1)
    late = t + dt.timedelta(1)
    rows = [
        (1, 7, "5", None, t), (2, 7, "00006 [2]", " 05  0 R", t), (3, 7, "8_1", "6 2\nR", t), (4, 7, "8_1", "5 0 R", late), (5, 7, "9", "null", t),
        (6, 7, None, "5 0 R", t), (7, None, "5", None, t), (8, 7, "", None, t), (9, 7, "99999999999999999999", None, t), (10, 7, "10", "10 0 R", None),
    ]
    df = spark.createDataFrame(rows, "link_id BIGINT, file_id BIGINT, node_key STRING, parent_ref STRING, loaded_at TIMESTAMP")
    code = lambda n, g=0: (n << 32) + g
    got = {r.node: r.parent for r in hierarchy.links(df).collect()}
    assert got == {code(5): None, code(6, 2): code(5), code(8, 1): code(5), code(9): None, code(10): code(10)}
    assert hierarchy.links(df.limit(0)).count() == 0
    assert hierarchy.decompose(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed,local_max", [(3, 100_000), (3, 20), (5, 0)])
def test_numbers_are_intervals_of_descendants(spark, seed, local_max):
    rows = forest(seed)
    path, _ = brute(rows)
    got = {(r.grp, r.node): r for r in hierarchy.decompose(spark.createDataFrame(rows, SCHEMA), local_max).collect()}
    for (g, n), p in path.items():
        r = got[g, n]
        if p is None:
            assert r.pre is None
            continue
        below = {m for (h, m), q in path.items() if h == g and q and n in q[:-1]}
        assert below == {m for (h, m), o in got.items() if h == g and o.root == r.root and o.pre is not None and r.pre < o.pre < r.pre + r["size"]}
    assert len({(g, r.root, r.pre) for (g, _), r in got.items() if r.pre is not None}) == sum(p is not None for p in path.values())


def test_both_ways_agree(spark):
    df = spark.createDataFrame(forest(11), SCHEMA)
    a, b = (sorted(map(tuple, hierarchy.decompose(df, m).collect())) for m in (100_000, 0))
    assert [tuple(-1 if x is None else x for x in r) for r in a] == [tuple(-1 if x is None else x for x in r) for r in b]


def test_hot_chain_and_hot_parent_without_broadcast(spark):
    rows = [(1, v, v - 1 if v else None) for v in range(300)] + [(1, 1000 + v, 150) for v in range(300)] + [(2, v, None) for v in range(50)]
    path, size = brute(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.grp, r.node): (r.path, r.size) for r in hierarchy.paths(hierarchy.decompose(spark.createDataFrame(rows, SCHEMA), 100)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {k: (p, size[k]) for k, p in path.items()}
