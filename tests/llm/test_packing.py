import random

from hypothesis import given, strategies as st

from quire.llm import packing, tokens

SIZES = "pack_id INT, label STRING, capacity_tokens INT"


def first_fit(sizes, capacity):
    free, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, f in enumerate(free):
            if f >= sizes[i]:
                break
        else:
            free.append(capacity)
            b = len(free) - 1
        free[b] -= sizes[i]
        out[i] = b
    return out


@given(st.lists(st.integers(0, 50), max_size=80))
def test_tournament_is_first_fit_decreasing(sizes):
    assert packing.first_fit_decreasing(sizes, 50) == first_fit(sizes, 50)


@given(st.integers(0, 1000), st.integers(1, 100))
def test_pieces(size, capacity):
    parts = packing.pieces(size, capacity)
    assert sum(n for _, n in parts) == size and all(n <= capacity for _, n in parts)
    assert len(parts) == max(1, -(-size // capacity)) and [a for a, _ in parts] == [i * capacity for i in range(len(parts))]


def test_pack(spark):
    r = random.Random(2)
    rows = [(i % 90, r.choice([0, 1, 30, 77, 100, 101, 450]), "x") for i in range(400)] + [(None, 20, None)] + [(7, 5, "same id")] * 150
    items = spark.createDataFrame(rows, "doc_id BIGINT, tokens BIGINT, bin STRING")
    sizes = spark.createDataFrame([(1, "a", 100), (2, "b", 64), (2, "b", 64), (None, "c", 5)], SIZES)
    got = packing.pack(items, sizes, group=60).collect()
    for pack, capacity in ((1, 100), (2, 64)):
        mine = [g for g in got if g.pack_id == pack]
        assert sum(g.tokens for g in mine) == sum(n for _, n, _ in rows)
        used = {}
        for g in mine:
            used[g.bin] = used.get(g.bin, 0) + g.tokens
            assert g.piece == 0 or g.start == g.piece * capacity
        assert max(used.values()) <= capacity
        assert len({b >> 32 for b in used}) > 1
        split = sum(n > capacity for _, n, _ in rows)
        assert sum(g.piece == 0 for g in mine) == len(rows) and len({(g.doc_id, g.start) for g in mine if g.piece}) <= split * 7
    assert {r.pack_id: round(r.filled, 1) for r in packing.fill(packing.pack(items, sizes, group=600), sizes.where("pack_id = 1")).collect()} == {1: 1.0}
    assert packing.pack(items.limit(0), sizes).count() == 0


def test_counts_equal_the_tokenizer(spark):
    c = tokens.counter()
    texts = ["", "Hello, world's  end\n\n\n", "Grüße 你好 ½ ٣  x", " " * 25_000 + "a", "a" * 3000, "\n" * 30_000, "it's <|endoftext|>"]
    for t in texts:
        assert c.count(t) == sum(len(c.piece.encode_ordinary(x)) for x in tokens.splitter().findall(t))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(99, None, 0)], "doc_id BIGINT, text STRING, tokens INT")
    assert {r.doc_id: r.tokens for r in packing.count_tokens(df).collect()} == {i: c.count(t) for i, t in enumerate(texts)}


def test_blocks_of_capacities_change_nothing(spark, monkeypatch):
    items = spark.createDataFrame([(i, i * 7 % 90) for i in range(200)], "doc_id BIGINT, tokens BIGINT")
    sizes = spark.createDataFrame([(i, c) for i, c in enumerate((100, 64, 90, 33, 500))], "pack_id INT, capacity_tokens INT")
    place = lambda: sorted((r.pack_id, r.doc_id, r.piece, r.start, r.tokens) for r in packing.pack(items, sizes).collect())
    want = place()
    monkeypatch.setattr(packing, "CAPACITIES", 2)
    assert place() == want
    audit = packing.audit(packing.pack(items, sizes), sizes).collect()
    assert len(audit) == 5 and all((r.n_docs, r.overfull, r.split_small, r.gaps, r.near) == (200, 0, 0, 0, True) for r in audit)
