"""Text garbled by a wrong character encoding: find it and restore what can be restored.

Garbled sequences are precomputed for pairs of a true and a wrong encoding and
matched by multi-pattern automata; only matched spans are replaced.

* UTF-8 read as an encoding of one byte a character gives sequences of a lead
  and continuation bytes.  They follow from the byte structure, for characters
  of all planes: the automaton holds their first two characters, the rest is
  compared with the encoding's table.  How much a sequence proves by itself
  depends on whether correct text may hold it.
* Between encodings of one byte a character, and with encodings of several
  bytes, a single character gives sequences that may well be correct, so words
  (of scripts without blanks: pairs of characters) are garbled instead.  The
  words come from the collection itself: one pass counts the documents of every
  word with a non-ASCII character, and a garbled form counts only where the word
  it comes from is clearly the commoner one.  Forms are made, pruned and weighed
  as DataFrames, so neither the words nor their forms meet on the driver: only
  those that the texts can hold are matched, in blocks of bounded size.
* Characters that no correct text has (U+FFFD, C1 controls) are patterns of
  their own and mark what stays lost.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.session import Scratch, spread

# Names of encodings whose mix-ups are looked for.
SINGLE = (
    "cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp1254", "mac_roman", "cp437", "cp850", "cp866", "cp852", "cp1253", "cp1255",
    "cp1256", "cp1257", "cp1258", "iso8859-5", "iso8859-7", "iso8859-15", "koi8-u", "mac_cyrillic", "cp874",
)
WIDE = ("shift_jis", "euc_jp", "gbk", "big5", "euc_kr")
WRONG_WIDE = ("cp932", "gbk", "big5", "euc_kr")

PIECE = 40  # a longer word is taken in pieces of so many characters, which needn't stand alone
DOCS_MIN = 3  # documents from which on a word outweighs garbled forms in fewer; a rarer one must be the commoner by count
DOMINANCE = 2  # times as many documents as its garbled form
BLOCK = 500_000  # garbled forms of one automaton; all blocks are matched
GRAM_BITS = 22  # a bit for each hash of two neighbouring characters of the texts
LINE_SUPPORT = 3  # sure sequences of an encoding that make its doubtful ones in the same line count

STRONG, HALF, WEAK = 3, 2, 1  # counts alone; where two of one encoding touch; where it touches a strong one

_NEAR = "、-ヿ㐀-䶿一-鿿가-힣！-～"  # scripts whose words are taken as pairs
_WORD = re.compile(r"[A-Za-z]*[^\x00-\x7f\s](?:[A-Za-z]|[^\x00-\x7f\s])*")
_WIDE = re.compile(f"[{_NEAR}]")
_WIDE_RUN = re.compile(f"[{_NEAR}]{{2,}}")
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_LOST = "�" + "".join(map(chr, range(0x80, 0xA0))).replace("\x85", "")


# --- tables of the encodings ---------------------------------------------------


@cache
def _table(wrong: str) -> str:
    """The character each byte turns into; bytes the encoding lacks stay as C1 controls."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@cache
def _bytes(wrong: str) -> dict[str, int]:
    """The byte from 128 on that gives a character."""
    return {c: b for b, c in enumerate(_table(wrong)) if b > 127}


def _read(raw: bytes, wrong: str) -> str | None:
    if wrong in SINGLE:
        return codecs.charmap_decode(raw, "strict", _table(wrong))[0]
    try:
        return raw.decode(wrong)
    except UnicodeDecodeError:
        return None


def garble(text: str, true: str, wrong: str) -> str | None:
    """``text`` as it looks after its ``true`` bytes were read as ``wrong``; None if it can't be or stays equal."""
    try:
        out = _read(text.encode(true), wrong)
    except UnicodeEncodeError:
        return None
    return None if out == text else out


# --- UTF-8 by its byte structure -----------------------------------------------


_SCRIPTS = (
    ("latin", 0, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("thai", 0xE00, 0xE7F),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
)


@cache
def _letter(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "M"


@cache
def _script(c: str) -> str:
    n = ord(c)
    return next((name for name, low, high in _SCRIPTS if low <= n <= high), "other")


def _closes(c: str) -> bool:
    """Punctuation, blanks and soft hyphens, which may follow any letter."""
    return unicodedata.category(c)[0] in "PZ" or c == "\xad"


def proof(g: str, original: str) -> int:
    """How far ``g`` proves that ``original`` was meant: STRONG, HALF, or 0 where it is ordinary text."""
    scripts = {_script(c) for c in g}
    if all(map(_letter, g)) and len(scripts) == 1 and not scripts & {"latin", "other"}:
        return 0 if not scripts <= {"greek", "cyrillic"} else HALF if len(g) < 4 else STRONG
    if len(g) > 2:
        return STRONG
    first, second = g
    doubtful = (_closes(second) and (first.isalpha() or unicodedata.category(first) == "Mn")) or (_closes(first) and second.isalpha())
    if original <= "ſ":
        return HALF if doubtful and (_script(first) != "latin" or not first.isalpha()) else STRONG
    return HALF if doubtful or g.isalpha() else STRONG


_USED = {"C": {"​", "‌", "‍", "﻿", "\xad"}}


@cache
def _original(raw: bytes) -> str | None:
    """The character of a UTF-8 sequence, if texts may hold it."""
    try:
        c = raw.decode()
    except UnicodeDecodeError:
        return None
    return c if unicodedata.category(c)[0] != "C" or c in _USED["C"] else None


@cache
def _prefixes() -> ahocorasick.Automaton:
    """The first two characters of every sequence in every wrong encoding, with the encodings; and the lost characters."""
    found: dict[str, list[tuple[str, int, int]]] = defaultdict(list)
    for wrong in SINGLE:
        t = _table(wrong)
        for lead in range(0xC2, 0xF5):
            for second in range(0x80, 0xC0):
                found[t[lead] + t[second]].append((wrong, lead, second))
    auto = ahocorasick.Automaton()
    for g, ways in found.items():
        auto.add_word(g, tuple(ways))
    for c in _LOST:
        auto.add_word(c, None)
    auto.make_automaton()
    return auto


def _sequences(line: str) -> tuple[dict[int, list[tuple[int, str, str]]], list[int]]:
    """({start: [(end, original, encoding)]}, places of lost characters) of the UTF-8 sequences of a line."""
    out: dict[int, list[tuple[int, str, str]]] = defaultdict(list)
    lost = []
    for last, ways in _prefixes().iter(line):
        if ways is None:
            lost.append(last)
            continue
        start = last - 1
        for wrong, lead, second in ways:
            size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            raw = [lead, second]
            if size > 2:
                table = _bytes(wrong)
                raw += [table.get(c, 0) for c in line[start + 2 : start + size]]
            if len(raw) == size and (c := _original(bytes(raw))):
                out[start].append((start + size, c, wrong))
    return out, lost


# --- words and their garbled forms ---------------------------------------------


def words(line: str) -> set[str]:
    """Runs of ASCII letters and any non-ASCII characters, long ones in pieces; of scripts without blanks every two neighbours."""
    out = set()
    for w in _WORD.findall(line):
        if not _WIDE.search(w):
            out |= {w} if len(w) <= PIECE else {w[i : i + PIECE] for i in (*range(0, len(w) - PIECE, PIECE), len(w) - PIECE)}
    for run in _WIDE_RUN.findall(line):
        out.update(a + b for a, b in zip(run, run[1:]))
    return out


_MASK = (1 << GRAM_BITS) - 1


def _gram(a: str, b: str) -> int:
    return (ord(a) * 40503 + ord(b)) & _MASK


def grams(line: str) -> set[int]:
    """Hashes of two neighbours of which one isn't ASCII."""
    return {_gram(a, b) for a, b in zip(line, line[1:]) if a > "\x7f" or b > "\x7f"}


class Grams:
    """Which pairs of neighbours the texts may hold; without any, all."""

    def __init__(self, bits: bytes | None):
        self.bits = bits

    def may_hold(self, g: str) -> bool:
        bits = self.bits
        if bits is None:
            return True
        for a, b in zip(g, g[1:]):
            if (a > "\x7f" or b > "\x7f") and not bits[(x := _gram(a, b)) >> 3] & (1 << (x & 7)):
                return False
        return True


def natural(word: str) -> bool:
    """Letters of one script, and otherwise only punctuation: what a word looks like that isn't garbled itself."""
    letters = [c for c in word if _letter(c)]
    return bool(letters) and len({_script(c) for c in letters}) == 1 and all(_letter(c) or unicodedata.category(c)[0] == "P" for c in word)


def _word_part(g: str) -> str | None:
    """The script of what may stand inside an ordinary word: letters of one script, of Latin with an ASCII one."""
    scripts = {_script(c) for c in g}
    if not all(map(_letter, g)) or len(scripts) > 1 or scripts == {"other"} or (scripts == {"latin"} and all(c > "\x7f" for c in g)):
        return None
    return scripts.pop()


def rival(g: str) -> str:
    """What tells how common ``g`` is as correct text: itself, or its first pair in scripts without blanks."""
    m = _WIDE_RUN.search(g)
    return m.group()[:2] if m else g


def forms(word: str, cases: bool, held: Grams) -> Iterator[tuple[str, str, int, bool]]:
    """(garbled form, original, strength, must stand alone) of a word, and with ``cases`` of the ways it may be written.

    A form of one or two letters counts only in a line with several longer ones.
    """
    wide = bool(_WIDE.search(word))
    if not natural(word):
        return
    alone = not wide and len(word) < PIECE
    for form in {word, word.lower(), word.capitalize(), word.upper()} if cases and not wide else (word,):
        raws: set[bytes] = set()
        for true in ("utf-8", *WIDE) if wide else ("utf-8", *SINGLE):
            try:
                raws.add(form.encode(true))
            except UnicodeEncodeError:
                continue
        for raw in raws:
            for wrong in (*SINGLE, *WRONG_WIDE):
                g = _read(raw, wrong)
                if g is None or g == form or g.isascii():
                    continue
                if not alone and (part := _word_part(g)):
                    if part == "latin" and held.may_hold(g):
                        yield g, form, WEAK, False
                    continue
                short = len(g) < 2 or (len(g) == 2 and g.isalpha())
                if (not short or (alone and g.isalpha())) and held.may_hold(g):
                    yield g, form, HALF if short else STRONG, alone
    if wide:  # single characters count only beside a pair
        for c in set(word):
            for true in WIDE:
                for wrong in SINGLE:
                    if (g := garble(c, true, wrong)) and _word_part(g) in (None, "latin") and held.may_hold(g):
                        yield g, c, WEAK, False


def _inner(c: str) -> bool:
    return c.isalnum() or _letter(c)


def _capitals(line: str, start: int, end: int) -> bool:
    """A capital and a closing mark at the end of a word in capitals."""
    return line[start].isupper() and start > 0 and line[start - 1].isupper() and not (end < len(line) and line[end].isalpha())


class Matcher:
    """Automata over the UTF-8 sequences and over garbled forms, and the tiling of a line by their matches."""

    def __init__(self, found: dict[str, tuple[str, int, bool]], ordinary: set[str] = frozenset()):
        self.auto = None
        if found:
            self.auto = ahocorasick.Automaton()
            for g, (original, strength, alone) in found.items():
                self.auto.add_word(g, (len(g), original, strength, alone))
            self.auto.make_automaton()
        self.ordinary = ordinary  # sequences of three letters that common words hold

    def _forms(self, line: str) -> dict[int, tuple[int, str, int]]:
        out: dict[int, tuple[int, str, int]] = {}
        n = len(line)
        for last, (size, original, strength, alone) in self.auto.iter(line) if self.auto else ():
            end = last + 1
            start = end - size
            if alone and ((start and _inner(line[start - 1])) or (end < n and _inner(line[end]))):
                continue
            if start not in out or out[start][0] < end:
                out[start] = (end, original, strength)
        return out

    def read(self, line: str) -> tuple[list[tuple[int, int, str]], int]:
        """(accepted (start, end, original), lost characters outside) of a line: leftmost and longest first, not overlapping."""
        found, lost = _sequences(line)
        whole = self._forms(line)
        usual: Counter[str] = Counter()
        for ways in found.values():
            usual.update(wrong for _, _, wrong in ways)
        tiles: list[tuple[int, int, str, int, str]] = []  # start, end, original, strength, encoding
        at = 0
        for start in sorted({*found, *whole}):
            if start < at:
                continue
            best = (*whole[start], "") if start in whole else None
            for end, c, wrong in sorted(found.get(start, ()), key=lambda x: (-x[0], -usual[x[2]])):
                if best and end <= best[0]:
                    break
                g = line[start:end]
                strength = 0 if g in self.ordinary else proof(g, c)
                if strength == STRONG and len(g) == 2 and _closes(g[1]) and _capitals(line, start, end):
                    strength = HALF
                if strength:
                    best = (end, c, strength, wrong)
                    break
            if best:
                tiles.append((start, *best))
                at = best[0]
        out: list[tuple] = []
        doubtful: list[tuple] = []
        group: list[tuple] = []
        for t in [*tiles, (len(line) + 2, len(line) + 2, "", 0, "")]:
            if group and group[-1][1] != t[0]:
                sure = any(x[3] == STRONG for x in group) or any(a[3] == b[3] == HALF and a[4] == b[4] != "" for a, b in zip(group, group[1:]))
                (out if sure else doubtful).extend(group)
                group = []
            group.append(t)
        if doubtful and out:
            support = Counter(x[4] for x in out if x[3] == STRONG or x[4])
            out += [x for x in doubtful if x[3] == HALF and support[x[4]] >= LINE_SUPPORT]
            out.sort()
        inside = {i for s, e, *_ in out for i in range(s, e)} if lost else ()
        return [x[:3] for x in out], sum(i not in inside for i in lost)

    def spans(self, line: str) -> list[tuple[int, int, str]]:
        return self.read(line)[0]

    def step(self, line: str) -> str:
        """The line with its spans replaced once."""
        parts, at = [], 0
        for start, end, original in self.spans(line):
            parts += [line[at:start], original]
            at = end
        return "".join([*parts, line[at:]])

    def repair(self, line: str) -> str:
        """The line repaired until no span is left, however often it was garbled; a line that comes back ends it."""
        seen: set[str] = set()
        while line not in seen:
            seen.add(line)
            line = self.step(line)
        return line


def patterns(df: dict[str, int]) -> tuple[dict[str, tuple[str, int, bool]], set[str]]:
    """The forms of a few words with their documents, and what is ordinary: the same rules as ``_weighed``, without a cluster."""
    total: Counter[str] = Counter()
    common: Counter[str] = Counter()
    for w, n in df.items():
        total[w.lower()] += n
        common[w.lower()] += n * (n >= DOCS_MIN)
    best: dict[str, tuple] = {}
    for w, docs in df.items():
        firm = docs >= DOCS_MIN
        sums = common if firm else total
        n = docs if _WIDE.search(w) else sums[w.lower()]
        for g, original, strength, alone in forms(w, True, Grams(None)):
            seen = df.get(rival(g), 0)
            seen = 0 if firm and seen < DOCS_MIN else seen
            if strength != WEAK and not (n >= DOMINANCE * seen and sums[g.lower()] < n):
                continue
            best[g] = max(best.get(g, ()), (strength, firm, n, docs, original, alone))
    found = {g: (b[4], b[0], b[5]) for g, b in best.items()}
    return found, {x for w, n in df.items() if n >= DOCS_MIN and found.get(w, ("", 0))[1] != STRONG for x in _ordinary(w)}


def _ordinary(word: str) -> set[str]:
    """Runs of three letters that might be taken for a garbled character of the scripts from U+3000 on."""
    out = set()
    for run in _LETTERS.findall(word):
        if not run.isascii():
            out |= {run[s:e] for s, ways in _sequences(run)[0].items() for e, c, _ in ways if e - s == 3 and c >= "　"}
    return out


# --- DataFrames ----------------------------------------------------------------

_SURVEY = pa.schema([("word", pa.string()), ("low", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])
_FORMS = pa.schema([("g", pa.string()), ("low_g", pa.string()), ("rival", pa.string()), ("original", pa.string()), ("strength", pa.int32()), ("alone", pa.bool_()), ("firm", pa.bool_()), ("n", pa.int64()), ("docs", pa.int64())])
_HITS = pa.schema([("doc_id", pa.int64()), ("g", pa.string())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.int32()), ("lost", pa.int32()), ("repaired", pa.string())])
_DDL = {pa.string(): "STRING", pa.int64(): "BIGINT", pa.int32(): "INT", pa.bool_(): "BOOLEAN"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    pairs: set[int] = set()

    def flush() -> pa.RecordBatch:
        out = _batch([(w, w.lower(), None, n) for w, n in held.items()], _SURVEY)
        held.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen: set[str] = set()
            for line in text.split("\n"):
                if not line.isascii():
                    seen |= words(line)
                    pairs |= grams(line)
            held.update(seen)
            if len(held) > 100_000:
                yield flush()
    if held:
        yield flush()
    if pairs:
        yield _batch([(None, None, x, 0) for x in pairs], _SURVEY)


def _maker(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Grams(bits.value)
        for batch in batches:
            rows: list[tuple] = []
            for word, docs, rep, total, common in zip(*(c.to_pylist() for c in batch.columns)):
                firm = docs >= DOCS_MIN
                n = docs if _WIDE.search(word) else common if firm else total
                rows += [(g, g.lower(), rival(g), original, strength, alone, firm, n, docs) for g, original, strength, alone in forms(word, word == rep, held)]
                if len(rows) > 20_000:
                    yield _batch(rows, _FORMS)
                    rows = []
            if rows:
                yield _batch(rows, _FORMS)

    return run


def _ordinaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {x for w in batch.column(0).to_pylist() for x in _ordinary(w)}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["g"])


def _weighed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, set[str]]:
    """(g, original, strength, alone) of the garbled forms that the texts can hold, and the ordinary sequences.

    What meets on the driver is bounded by the encodings: a bitmap of 2^GRAM_BITS
    bits and the sequences of three letters.
    """
    spark = docs.sparkSession
    seen = scratch.cut(docs.select("text").mapInArrow(_survey, _ddl(_SURVEY)))
    bits = np.zeros(1 << GRAM_BITS, np.uint8)
    bits[[r.gram for r in seen.where("gram is not null").select("gram").distinct().collect()]] = 1
    bitmap = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    counted = scratch.cut(seen.where("word is not null").groupBy("word", "low").agg(F.sum("n").alias("docs")))
    firm = F.col("docs") >= DOCS_MIN
    lows = counted.groupBy("low").agg(F.sum("docs").alias("total"), F.sum(F.when(firm, F.col("docs")).otherwise(0)).alias("common"), F.max_by("word", F.struct("docs", "word")).alias("rep"))
    made = counted.join(lows, "low").select("word", "docs", "rep", "total", "common")
    made = scratch.cut(spread(made, "word").mapInArrow(_maker(bitmap), _ddl(_FORMS)))
    rivals = made.select("g", "low_g", "rival").distinct()
    rivals = rivals.join(counted.select(F.col("word").alias("rival"), F.col("docs").alias("seen")), "rival", "left").join(lows.select(F.col("low").alias("low_g"), F.col("total").alias("total_g"), F.col("common").alias("common_g")), "low_g", "left")
    known = made.join(rivals.select("g", "seen", "total_g", "common_g"), "g")
    against = F.when(F.col("firm") & (F.col("seen") < DOCS_MIN), 0).otherwise(F.coalesce("seen", F.lit(0)))
    written = F.coalesce(F.when(F.col("firm"), F.col("common_g")).otherwise(F.col("total_g")), F.lit(0))
    fair = (F.col("strength") == WEAK) | ((F.col("n") >= DOMINANCE * against) & (written < F.col("n")))
    best = known.where(fair).groupBy("g").agg(F.max(F.struct("strength", "firm", "n", "docs", "original", "alone")).alias("b"))
    found = scratch.cut(best.select("g", "b.original", "b.strength", "b.alone"))
    sound = counted.where(firm).join(found.where(F.col("strength") == STRONG).select(F.col("g").alias("word")), "word", "left_anti")
    ordinary = {r.g for r in sound.select("word").mapInArrow(_ordinaries, "g STRING").distinct().collect()}
    scratch.drop(seen, counted, made)
    return found, ordinary


_MADE: dict[str, Matcher] = {}


def _matcher(key: str, found, ordinary) -> Matcher:
    """One automaton of forms per worker process."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Matcher(found.value, ordinary.value)
    return _MADE[key]


def _examined(m: Matcher, doc: int, text: str, repair: bool) -> tuple | None:
    spans = lost = 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if line.isascii():
            continue
        here, gone = m.read(line)
        if here and repair:
            lines[i] = m.repair(line)
            gone = m.read(lines[i])[1]
        spans += len(here)
        lost += gone
        if (spans or lost) and not repair:
            break
    return (doc, spans, lost, "\n".join(lines) if repair and spans else None) if spans or lost else None


def _finder(key: str, found, ordinary, repair: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(key, found, ordinary)
        for batch in batches:
            rows = [r for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (r := _examined(m, doc, text, repair))]
            if rows:
                yield _batch(rows, _FOUND)

    return run


def _hitter(key: str, found, ordinary):
    """Forms of one block that stand in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(key, found, ordinary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = {line[s:e] for line in text.split("\n") if not line.isascii() for s, (e, *_) in m._forms(line).items()}
                rows += [(doc, g) for g in held]
            if rows:
                yield _batch(rows, _HITS)

    return run


def _apart(ordinary, repair: bool):
    """Each document with its own forms (columns doc_id, text, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, held in zip(*(c.to_pylist() for c in batch.columns)):
                m = Matcher({h["g"]: (h["original"], h["strength"], h["alone"]) for h in held or ()}, ordinary.value)
                if r := _examined(m, doc, text, repair):
                    rows.append(r)
            if rows:
                yield _batch(rows, _FOUND)

    return run


def _stepper(ordinary):
    """Each document (doc_id, text, held) after one round of repair, if that changes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = [], []
            for doc, text, held in zip(*(c.to_pylist() for c in batch.columns)):
                m = Matcher({h["g"]: (h["original"], h["strength"], h["alone"]) for h in held or ()}, ordinary.value)
                after = "\n".join(line if line.isascii() else m.step(line) for line in text.split("\n"))
                if after != text:
                    docs.append(doc)
                    texts.append(after)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def garbled(documents: DataFrame, repair: bool = True, doc: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, spans, lost, repaired) of every document with garbled text.

    ``spans`` counts the garbled sequences that can be put right, ``repaired``
    is the text with just those replaced (null without any), ``lost`` counts
    characters that stay damaged.  Without ``repair`` only doc_id comes out.
    Null, empty and ASCII texts give no row; a document delivered twice gives
    two.  Texts and words are taken whole, whatever their length.

    Where the forms exceed ``block`` they are matched block by block, round by
    round of the repair until none brings up another; each document is then
    repaired with the forms that it held in any round, so the blocks change no
    result.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "garbled")
    docs = spread(documents.where(F.octet_length(text) > F.char_length(text)).select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "doc_id")
    found, ordinary = _weighed(docs, scratch)
    ordinary = spark.sparkContext.broadcast(ordinary)
    blocks = max(1, -(-found.count() // block))

    def part(b: int):
        rows = found.where(F.pmod(F.xxhash64("g"), F.lit(blocks)) == b).collect()
        return spark.sparkContext.broadcast({r.g: (r.original, r.strength, r.alone) for r in rows})

    if blocks == 1:
        out = docs.mapInArrow(_finder(uuid.uuid4().hex, part(0), ordinary, repair), _ddl(_FOUND))
        return out if repair else out.select("doc_id")
    held, texts = None, docs
    while True:
        new = None
        for b in range(blocks):
            one = texts.mapInArrow(_hitter(uuid.uuid4().hex, part(b), ordinary), _ddl(_HITS))
            new = one if new is None else new.unionByName(one)
        new = scratch.cut(new.distinct() if held is None else new.distinct().join(held, ["doc_id", "g"], "left_anti"))
        if held is not None and new.isEmpty():
            break
        held = new if held is None else scratch.cut(held.unionByName(new))
        own = held.join(found, "g").groupBy("doc_id").agg(F.collect_list(F.struct("g", "original", "strength", "alone")).alias("held"))
        each = docs.join(own, "doc_id", "left").select("doc_id", "text", "held")
        now = texts.join(own, "doc_id", "left").select("doc_id", "text", "held")
        texts = scratch.cut(now.mapInArrow(_stepper(ordinary), "doc_id BIGINT, text STRING"))
    out = each.mapInArrow(_apart(ordinary, repair), _ddl(_FOUND))
    return out if repair else out.select("doc_id")
