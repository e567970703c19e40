import random
import re

import numpy as np

from quire.llm import leaks

DOCS = "doc_id BIGINT, text STRING, item_id STRING, words INT"
ITEMS = "item_id BIGINT, text STRING, doc_id INT"


def shared(a, b):
    """Longest run of words both hold."""
    a, b = (re.findall(r"[^\W_]+", x.lower()) for x in (a, b))
    best, prev = 0, [0] * (len(b) + 1)
    for w in a:
        cur = [0] + [prev[j] + 1 if w == v else 0 for j, v in enumerate(b)]
        best, prev = max(best, *cur), cur
    return best


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y and x else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 5, r.integers(0, 25)), r.integers(1, 5, r.integers(0, 25))
        assert leaks.align(a.astype(np.int32), b.astype(np.int32))[0] == smith_waterman(list(a), list(b))


def test_alignment_of_many():
    r = np.random.default_rng(2)
    for _ in range(40):
        item = r.integers(1, 6, r.integers(1, 25)).astype(np.int32)
        passages = [r.integers(0, 9, r.integers(1, 40)).astype(np.int32) for _ in range(r.integers(1, 9))]
        want = [leaks.align(p, item) for p in passages]
        assert list(zip(*(x.tolist() for x in leaks.align_many(passages, item)))) == want
        known = np.zeros(10, bool)
        assert all(b >= w[0] for b, w in zip(leaks.bounds(passages, item, known), want)) and not known.any()


def corpus():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of"] * 10
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    stock = "answer the question using only the text below"
    items = [(i, f"{stock} {text(r.randint(2, 60))}", 0) for i in range(25)] + [(90, None, 0), (91, "", 0), (92, "one two", 0), (93, items_same := text(40), 0), (94, items_same, 0)]
    docs = []
    for d in range(150):
        body = text(r.randint(0, 80))
        words = r.choice(items[:25])[1].split()
        n = r.choice([0, 5, 11, 12, 13, 40])
        at = r.randrange(max(1, len(words) - n))
        glue = r.choice([" ", "\n+", "_", " -- "])
        docs.append((d, f"{body} {glue.join(w.upper() for w in words[at : at + n])} {text(5)}", "x", 1))
    docs += [(500, None, None, None), (501, "", None, None), (502, items[3][1] * 400, None, None), (503, stock, None, None), (504, items_same, None, None)]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = {(d, i) for d, t, *_ in docs if t for i, s, _ in items if s and shared(t, s) >= leaks.RUN}
    for block in (4_000_000, 1500):
        monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
        rows = leaks.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
        assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
        assert {(r.doc_id, r.item_id) for r in rows if r.run >= leaks.RUN} == want
    assert (504, 93) in want and (504, 94) in want


def test_edited_copies_score(spark):
    words = [f"term{i}" for i in range(60)]
    edited = [w if i % 9 else "changed" for i, w in enumerate(words)]
    docs = [(1, "prefix " + " ".join(edited), None, None), (2, "nothing here", None, None)]
    rows = leaks.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, " ".join(words), 0)], ITEMS)).collect()
    assert [(r.doc_id, r.item_id, r.run) for r in rows] == [(1, 5, 8)] and rows[0].score > 80


def test_empty(spark):
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    docs, items = corpus()
    assert leaks.leaks(none[0], spark.createDataFrame(items, ITEMS)).count() == 0
    assert leaks.leaks(spark.createDataFrame(docs, DOCS), none[1]).count() == 0


def test_edited_copy_beside_a_verbatim_one(spark):
    words = [f"term{i}" for i in range(60)]
    edited = [w if i % 9 else "changed" for i, w in enumerate(words)]
    docs = [(1, " ".join(words), None, None), (2, " ".join(edited), None, None), (3, " ".join(words[:30]), None, None)]
    rows = leaks.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, " ".join(words), 0)], ITEMS)).collect()
    assert sorted((r.doc_id, r.run) for r in rows) == [(1, 60), (2, 8), (3, 30)]


def test_edited_copy_of_items_that_are_alike(spark):
    words = [f"term{i}" for i in range(60)]
    edited = [w if i % 9 else "changed" for i, w in enumerate(words)]
    items = [(i, " ".join([*words, f"own{i}"]), 0) for i in range(6)]
    rows = leaks.leaks(spark.createDataFrame([(1, " ".join(edited), None, None)], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.item_id, r.run) for r in rows) == [(i, 8) for i in range(6)]


def test_short_item_copied_whole(spark):
    items = [(1, "one two three four five six", 0), (2, "one two three four five seven", 0)]
    rows = leaks.leaks(spark.createDataFrame([(1, "zero one two three four five six", None, None)], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert [(r.doc_id, r.item_id, r.score, r.run) for r in rows] == [(1, 1, 12, 6)]


def edits(r, words, rate):
    """Words changed, dropped, inserted and swapped at a rate each word has for itself."""
    out = []
    for w in words:
        x = r.random()
        out += [] if x < rate / 4 else ["other"] if x < rate / 2 else [w, "more"] if x < 3 * rate / 4 else [w]
    if rate and len(out) > 10:
        i = r.randrange(len(out) - 1)
        out[i], out[i + 1] = out[i + 1], out[i]
    return out


def planted(seed=6):
    """(documents, items, {kind: planted pairs}): edited, halved and reordered copies in noise, and stock phrases that are no leak."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)] + ["the", "of", "to"] * 60
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    stock = "read the passage below and answer the question in one".split()  # 10 words that all items share
    items = [(i, stock + text(r.randint(38, 130))) for i in range(60)] + [(100 + i, text(r.randint(6, 11))) for i in range(20)]
    docs, truth = [], {}

    def put(kind, words, item=None):
        if item is not None:
            truth.setdefault(kind, set()).add((len(docs), item))
        docs.append((len(docs), " ".join(text(r.randint(0, 200)) + words + text(50)), None, None))

    for i, w in items:
        long = len(w) > 40
        for rate in (0.05, 0.1, 0.15) if long else ():
            put(f"edited {rate}", edits(r, w, rate), i)
        put("whole", w, i)
        if long:
            at = len(w) // 2
            put("half", edits(r, w[:at + 5], 0.05), i)
            put("moved", edits(r, w[at:] + w[:at], 0.05), i)
    for _ in range(300):
        put("noise", stock if r.random() < 0.5 else [])
    return docs, [(i, " ".join(w), 0) for i, w in items], truth


def test_recall_and_precision_of_edited_copies(spark):
    docs, items, truth = planted()
    got = {(x.doc_id, x.item_id) for x in leaks.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    every = set().union(*truth.values())
    recall = {k: len(v & got) / len(v) for k, v in truth.items()}
    print({k: (len(truth[k]), round(x, 3)) for k, x in recall.items()}, "precision", round(len(got & every) / len(got), 3))
    assert min(recall.values()) >= 0.9 and len(got & every) >= 0.95 * len(got)


def test_blocks_change_nothing(spark, monkeypatch):
    docs, items, _ = planted(7)
    args = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = sorted(map(tuple, leaks.leaks(*args).collect()))
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 4000)
    assert sorted(map(tuple, leaks.leaks(*args).collect())) == want


def test_places():
    r = np.random.default_rng(5)
    item = np.arange(1, 30, dtype=np.int32)
    passages = [np.concatenate([np.zeros(r.integers(0, 9), np.int32), item[a:b], np.zeros(r.integers(0, 5), np.int32)]) for a, b in ((0, 29), (5, 20), (3, 4))]
    first, last = leaks.places(passages, item)
    for p, a, b in zip(passages, first, last):
        at = np.flatnonzero(p)
        assert (a, b) == (at[0], at[-1])


def test_items_of_one_template(spark):
    """Of items that differ in a few words only the copied one leaks, and an edited copy is told from its kin."""
    r = random.Random(2)
    fill = lambda i: " ".join(f"neither the person{i}{k} nor the keeper{i}{k} noticed that the thing{i}{k} had been moved beside the place{i}{k}" for k in range(4))
    items = [(i, fill(i), 0) for i in range(12)]
    words = items[3][1].split()
    docs = [(1, "x " * 30 + items[5][1] + " y" * 30, None, None), (2, "x " * 30 + " ".join(edits(r, words, 0.1)), None, None), (3, items[1][1] + " z" * 20 + " ".join(edits(r, items[2][1].split(), 0.05)), None, None)]
    got = {(x.doc_id, x.item_id) for x in leaks.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(1, 5), (2, 3), (3, 1), (3, 2)}
