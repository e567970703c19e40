"""Evaluation passages in training text: n-gram seeds, then Smith-Waterman alignment.

One pass over the training texts turns each into word numbers of the test
vocabulary and keeps only passages around n-grams that the test items hold.
Every n-gram of an item is a seed, however many documents or items hold it, so
no edit of one copy and no likeness of two items can hide another copy.
Passages that can reach the least score, by an exact bound, are aligned to the
items of their seeds.  A passage leaks an item if both share a run of RUN words,
or if the alignment reaches a share of what the whole item would score: a stock
phrase of a long item doesn't, an edited or partial copy does.

Test items are worked on in blocks of bounded size, so what is broadcast
doesn't grow with the test set.  With several blocks, one pass over the texts
keeps the passages around n-grams that any item may hold, by a bitmap of fixed
size, and the blocks read those instead of the texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from quire.session import Scratch, spread

GRAM = 5  # words of a seed
RUN = 12  # words of a shared run that is reported as verbatim
PAD = 160  # words kept on either side of a hit, so that edited copies align as a whole
MATCH, MISMATCH, GAP = 2, -1, -1
SHARE = 0.35  # of the score of a whole item, from which on a passage counts as its edited copy
BETTER = 1.5  # times the score of an edited copy, from which on another item explains the same words
LEAST_WORDS = 8  # of short items so many words at least, or all
GRAM_BITS = 24  # bits of the bitmap of n-grams of all items
BLOCK_CHARS = 4_000_000  # text of the test items of one block
TASK_PASSAGES = 20_000
CELLS = 1 << 15  # words of the passages that are aligned to an item at once

_SEP = r"[^\pL\pN]+"
_MULT = np.uint64(0x9E3779B97F4A7C15)
_PASSAGE = "doc_id BIGINT, start BIGINT, words ARRAY<INT>, grams ARRAY<INT>"
_PASSAGE_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.int32())), ("grams", pa.list_(pa.int32()))])
_ALIGNED = "doc_id BIGINT, item_id BIGINT, score INT, run INT, matched INT, words INT, first BIGINT, last BIGINT"
_ALIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.int32()), ("run", pa.int32()), ("matched", pa.int32()), ("words", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])


def split_words(texts: pa.Array) -> pa.ListArray:
    """Maximal runs of letters and digits in lower case; empty strings may stand at either end."""
    return pc.split_pattern_regex(pc.utf8_lower(texts), pattern=_SEP)


def least(words: int) -> int:
    """The least score of an edited copy of an item of so many words."""
    return min(MATCH * words, max(MATCH * LEAST_WORDS, int(SHARE * MATCH * words)))


def _grams(ids: np.ndarray) -> np.ndarray:
    """A 64-bit number for each run of GRAM word numbers; 0 where one of them is 0."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    ok = np.ones(n, bool)
    for k in range(GRAM):
        part = ids[k : k + n]
        ok &= part > 0
        out = (out ^ part.astype(np.uint64)) * _MULT
        out ^= out >> np.uint64(29)
    out[~ok] = 0
    return out


class Items:
    """The index of one block of test items: vocabulary, word numbers and n-grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        words = split_words(pa.array([r[1] for r in rows], pa.string())).to_pylist()
        words = [[w for w in ws if w] for ws in words]
        self.vocab = sorted({w for ws in words for w in ws})
        number = {w: i + 1 for i, w in enumerate(self.vocab)}
        self.words = [np.array([number[w] for w in ws], np.int32) for ws in words]
        per = [_grams(w) for w in self.words]
        self.grams = np.unique(np.concatenate([*per, np.empty(0, np.uint64)]))
        self.grams = self.grams[self.grams != 0]
        self.at = [np.searchsorted(self.grams, g).astype(np.int32) for g in per]

    def seeds(self) -> dict[int, np.ndarray]:
        """n-gram to the items that hold it; each is a seed of all of them."""
        out: dict[int, list[int]] = defaultdict(list)
        for i, g in enumerate(self.at):
            for x in np.unique(g).tolist():
                out[x].append(i)
        return {x: np.array(items) for x, items in out.items()}

    def run_grams(self) -> np.ndarray:
        """Of each item the fewest different n-grams in RUN consecutive words; more than it has where it is shorter."""
        size = RUN - GRAM + 1
        return np.array([min((len(set(g[i : i + size].tolist())) for i in range(len(g) - size + 1)), default=1 << 30) for g in self.at])


def _numbered(lists: pa.ListArray) -> np.ndarray:
    """A 63-bit number for each word, the same for the same word everywhere; 0 for the empty strings at the ends."""
    words = lists.values.dictionary_encode()
    numbers = np.array([xxhash.xxh3_64_intdigest(w) >> 1 | 1 if w else 0 for w in words.dictionary.to_pylist()], np.uint64)
    return numbers[words.indices.to_numpy()] if len(numbers) else np.empty(0, np.uint64)


def _item_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in the bitmap of the n-grams of items."""
    for batch in batches:
        found = [_grams(w[w > 0]) for w in (_numbered(split_words(batch.column(0).slice(i, 1))) for i in range(batch.num_rows))]
        bits = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]) >> np.uint64(64 - GRAM_BITS))
        yield pa.RecordBatch.from_arrays([pa.array(bits.astype(np.int32))], names=["bit"])


def _near(bitmap):
    """(doc_id, text) of the passages around n-grams whose bit is set, with room for an alignment on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).astype(bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = split_words(part.column(1))
                found = _grams(_numbered(lists))
                if not len(found):
                    continue
                hit = np.flatnonzero((found != 0) & bits[found >> np.uint64(64 - GRAM_BITS)])
                offsets = lists.offsets.to_numpy()
                doc = np.searchsorted(offsets, hit, side="right") - 1
                whole = hit + GRAM <= offsets[doc + 1]
                hit, doc = hit[whole], doc[whole]
                if not len(hit):
                    continue
                cut = np.flatnonzero(np.append(True, (np.diff(hit) > 2 * PAD) | (np.diff(doc) > 0)))
                keys, docs, texts, base = part.column(0).to_pylist(), [], [], []
                for a, b in zip(cut, [*cut[1:], len(hit)]):
                    first, last = max(offsets[doc[a]], hit[a] - PAD), min(offsets[doc[a] + 1], hit[b - 1] + GRAM + PAD)
                    docs.append(keys[doc[a]])
                    base.append(int(first - offsets[doc[a]]))
                    texts.append(" ".join(lists.values.slice(first, last - first).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.string()), pa.array(base, pa.int64())], names=["doc_id", "text", "base"])

    return run


def _passages(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = index.value
        vocab, grams = pa.array(it.vocab, pa.string()), it.grams
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = split_words(part.column(1))
                # Empty strings at the ends are no words; their number 0 can't be part of an n-gram.
                ids = np.where((x := pc.index_in(lists.values, value_set=vocab)).is_null().to_numpy(False), 0, x.fill_null(0).to_numpy() + 1).astype(np.int32)
                found = _grams(ids)
                if not len(found) or not len(grams):
                    continue
                place = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
                hit = np.flatnonzero(grams[place] == found)
                if not len(hit):
                    continue
                offsets = lists.offsets.to_numpy()
                doc = np.searchsorted(offsets, hit, side="right") - 1
                whole = hit + GRAM <= offsets[doc + 1]
                hit, doc = hit[whole], doc[whole]
                if not len(hit):
                    continue
                cut = np.flatnonzero(np.append(True, (np.diff(hit) > 2 * PAD) | (np.diff(doc) > 0)))
                keys, base = part.column(0).to_pylist(), part.column(2).to_pylist()
                rows: list[tuple] = []
                for a, b in zip(cut, [*cut[1:], len(hit)]):
                    d = doc[a]
                    first, last = max(offsets[d], hit[a] - PAD), min(offsets[d + 1], hit[b - 1] + GRAM + PAD)
                    rows.append((keys[d], base[d] + int(first - offsets[d]), ids[first:last], np.unique(place[hit[a:b]]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PASSAGE_ARROW)], schema=_PASSAGE_ARROW)

    return run


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(score, longest common run, matched words) of the best local alignment of word numbers; 0 matches nothing.

    Row by row over the shorter side; within a row, gaps are a running maximum.
    """
    if not len(a) or not len(b):
        return 0, 0, 0
    matched = int(np.isin(b, a[a > 0]).sum())
    if len(a) > len(b):
        a, b = b, a
    n = len(b)
    step = -GAP * np.arange(1, n + 1, dtype=np.int32)
    prev = np.zeros(n + 1, np.int32)
    runs = np.zeros(n + 1, np.int32)
    new = np.zeros(n + 1, np.int32)
    best = longest = 0
    inside = np.isin(a, b) & (a > 0)
    idle = True
    for w, known in zip(a.tolist(), inside.tolist()):
        if not known:
            if idle:
                continue
            runs[:] = 0
            h = np.maximum(prev[:-1] + MISMATCH, prev[1:] + GAP)
        else:
            same = b == w
            new[1:] = (runs[:-1] + 1) * same
            runs, new = new, runs
            longest = max(longest, int(runs.max()))
            h = np.maximum(prev[:-1] + np.where(same, MATCH, MISMATCH), prev[1:] + GAP)
        h = np.maximum.accumulate(np.maximum(h, 0) + step) - step
        prev[1:] = h
        top = int(h.max())
        idle = top == 0
        best = max(best, top)
    return best, longest, matched


def align_many(passages: list[np.ndarray], item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``align`` of each passage to one item, word by word of the item over all passages at once."""
    n = max(map(len, passages))
    b = np.zeros((len(passages), n), np.int32)
    for row, p in zip(b, passages):
        row[: len(p)] = p
    step = -GAP * np.arange(1, n + 1, dtype=np.int32)
    prev, runs, new = (np.zeros((len(b), n + 1), np.int32) for _ in range(3))
    best, longest, matched = (np.zeros(len(b), np.int32) for _ in range(3))
    for w in item.tolist():
        same = b == w
        matched += same.any(axis=1)
        np.multiply(runs[:, :-1] + 1, same, out=new[:, 1:])
        runs, new = new, runs
        np.maximum(longest, runs.max(axis=1), out=longest)
        h = prev[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH))
        np.maximum(h, prev[:, 1:] + GAP, out=h)
        np.maximum(h, 0, out=h)
        h += step
        np.subtract(np.maximum.accumulate(h, axis=1), step, out=prev[:, 1:])
        np.maximum(best, prev.max(axis=1), out=best)
    return best, longest, matched


def _ends(passages: list[np.ndarray], item: np.ndarray) -> np.ndarray:
    """The word of each passage at which its best alignment to the item first ends."""
    n = max(map(len, passages))
    b = np.zeros((len(passages), n), np.int32)
    for row, p in zip(b, passages):
        row[: len(p)] = p
    step = -GAP * np.arange(1, n + 1, dtype=np.int32)
    prev = np.zeros((len(b), n + 1), np.int32)
    best, end = np.zeros(len(b), np.int32), np.zeros(len(b), np.int64)
    for w in item.tolist():
        h = np.maximum(prev[:, :-1] + np.where(b == w, np.int32(MATCH), np.int32(MISMATCH)), prev[:, 1:] + GAP)
        h = np.maximum(h, 0) + step
        prev[:, 1:] = np.maximum.accumulate(h, axis=1) - step
        at = prev.argmax(axis=1)
        top = prev[np.arange(len(b)), at]
        end = np.where(top > best, at - 1, end)
        best = np.maximum(best, top)
    return end


def places(passages: list[np.ndarray], item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) word of each passage that its best alignment covers."""
    last = _ends(passages, item)
    back = _ends([p[: e + 1][::-1] for p, e in zip(passages, last.tolist())], item[::-1])
    return last - back, last


def bounds(passages: list[np.ndarray], item: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The most each passage can score: a word of the item gains MATCH, any other costs a mismatch or gap; best stretch of these.

    ``known`` is all False, longer than the vocabulary, and comes back so.
    """
    sizes = np.array([len(p) for p in passages])
    heads = np.append(0, np.cumsum(sizes + 1)[:-1])
    words = np.zeros(int(sizes.sum()) + len(sizes), np.int32)
    for at, p in zip(heads.tolist(), passages):
        words[at + 1 : at + 1 + len(p)] = p
    known[item] = True
    gain = np.where(known[words], MATCH, max(MISMATCH, GAP)).astype(np.int64)
    known[item] = False
    gain[heads] = -MATCH * len(words)  # deeper than all before, so that no stretch goes over a head
    total = np.cumsum(gain)
    return np.maximum.reduceat(total - np.minimum.accumulate(total), heads)


def _aligner(index, seeds, placed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, seed = index.value, seeds.value
        known = np.zeros(len(it.vocab) + 1, bool)
        fewest = it.run_grams()
        for batch in batches:
            rows: list[tuple] = []
            docs, words, starts = batch.column(0).to_pylist(), [w.values.to_numpy() for w in batch.column(1)], batch.column(3).to_pylist()
            held: dict[int, list[tuple[int, bool]]] = defaultdict(list)
            for k, grams in enumerate(batch.column(2).to_pylist()):
                # A shared run of RUN words shares all its n-grams.
                shared = np.bincount(np.concatenate([seed[g] for g in grams]), minlength=len(fewest))
                for i in np.flatnonzero(shared if placed else shared >= fewest).tolist():
                    held[i].append((k, bool(shared[i] >= fewest[i])))
            for i, pairs in sorted(held.items()):
                item = it.words[i]
                edited = least(len(item))
                most = bounds([words[k] for k, _ in pairs], item, known)
                ks = sorted((k for (k, may_run), m in zip(pairs, most.tolist()) if m >= (min(edited, MATCH * RUN) if may_run else edited)), key=lambda k: len(words[k]))
                while ks:
                    size = max(1, CELLS // len(words[ks[-1]]))
                    part, ks = ks[-size:], ks[:-size]
                    aligned = align_many([words[k] for k in part], item) if len(part) > 1 else [[x] for x in align(words[part[0]], item)]
                    kept = [x for x in zip(part, *aligned) if x[1] >= edited or x[2] >= RUN]
                    at = zip(*(a.tolist() for a in places([words[x[0]] for x in kept], item))) if kept and placed else [(None, None)] * len(kept)
                    rows += [(docs[k], it.ids[i], int(s), int(r), int(m), len(item), *((None, None) if a is None else (starts[k] + a, starts[k] + b))) for (k, s, r, m), (a, b) in zip(kept, at)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ALIGNED_ARROW)], schema=_ALIGNED_ARROW)

    return run


def _unexplained(t: pa.Table) -> pa.Table:
    """Of one document, the rows whose place no far better alignment covers for the greater part."""
    first, last, score = (t.column(c).to_numpy() for c in ("first", "last", "score"))
    low = int(first.min())
    best = np.zeros(int(last.max()) - low + 1, np.int32)
    order = np.argsort(score, kind="stable")
    for a, b, s in zip((first[order] - low).tolist(), (last[order] - low).tolist(), score[order].tolist()):
        best[a : b + 1] = s  # in rising order, so that the best stays
    keep = [r >= RUN or np.median(best[a - low : b + 1 - low]) < BETTER * s for a, b, s, r in zip(first.tolist(), last.tolist(), score.tolist(), t.column("run").to_pylist())]
    return t.filter(pa.array(keep))


def _block(documents: DataFrame, rows: list[tuple[int, str]], scratch: Scratch, placed: bool) -> DataFrame:
    spark = documents.sparkSession
    items = Items(rows)
    index = spark.sparkContext.broadcast(items)
    passages = scratch.cut(spread(documents.select("doc_id", "text", "base"), "doc_id").mapInArrow(_passages(index), _PASSAGE))
    seeds = spark.sparkContext.broadcast(items.seeds())
    # Few rows but much work: not fewer tasks than cores, and not more rows in one than it takes minutes for.
    tasks = max(spark.sparkContext.defaultParallelism * 2, -(-passages.count() // TASK_PASSAGES))
    hits = passages.select("doc_id", "words", "grams", "start").repartition(tasks)
    return hits.mapInArrow(_aligner(index, seeds, placed), _ALIGNED)


def leaks(documents: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", edited: bool = True) -> DataFrame:
    """(doc_id, item_id, score, run, matched, words): every document that holds a passage of a test item.

    ``run`` is the longest run of words both share, ``score`` the best local
    alignment (2 a match, -1 a mismatch or gap), ``matched`` the words of the
    item that occur in the passage, ``words`` those of the item.  A pair comes
    out if ``run`` is RUN or more or ``score`` is ``least(words)`` or more and
    no other item scores BETTER times as much over the greater part of the same
    words: items made from one template resemble each other, but only the one
    that is copied leaked.  Without ``edited`` only the first kind comes out.
    An item of fewer than GRAM words holds no n-gram and is not found.  Null or
    empty texts and items hold no words and leak nothing; repeated documents or
    items give one row per pair of ids; texts are read whole, whatever their
    length.
    """
    docs = documents.where(F.col(text).isNotNull()).select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.lit(0).cast("bigint").alias("base"))
    tests = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    scratch = Scratch(documents.sparkSession, "leaks")
    parts = []
    if blocks > 1:
        bits = np.zeros(1 << GRAM_BITS, np.uint8)
        bits[[r.bit for r in tests.select("text").mapInArrow(_item_bits, "bit INT").distinct().collect()]] = 1
        bitmap = documents.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())
        docs = scratch.cut(spread(docs, "doc_id").mapInArrow(_near(bitmap), "doc_id BIGINT, text STRING, base BIGINT"))
    for b in range(blocks):
        rows = tests.where(F.pmod(F.hash("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        parts.append(_block(docs, [(r.item_id, r.text) for r in rows], scratch, edited))
    both = reduce(DataFrame.unionByName, parts)
    both = both.groupBy("doc_id").applyInArrow(_unexplained, _ALIGNED) if edited else both.where(F.col("run") >= RUN)
    return both.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("run").alias("run"), F.max("matched").alias("matched"), F.max("words").alias("words"))
