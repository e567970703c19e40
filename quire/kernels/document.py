"""One file: header, cross-reference chain, objects and trailers, leniently or strictly.

``load`` never raises: the first error ends the stage it was found in and is
kept with the document, so a damaged file still gives what was read of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from quire.kernels import codecs, crypt
from quire.kernels.model import TRAILER, Key, Options, PdfError, Place, Name, Ref, Stream, edit, walk
from quire.kernels.scan import Keyword, LexError, Scanner, SyntaxFault

FREE, INUSE, COMPRESSED = "free", "inuse", "compressed"
STRUCTURE = "structure"
_EOL = rb"(?:\r\n|\r|\n)"
_HEADER = re.compile(rb"%PDF-([0-9])\.([0-9])" + _EOL)
_TAIL = re.compile(rb"(?:^|(?<=[\r\n]))startxref *" + _EOL + rb"([0-9]+) *" + _EOL + rb"[\r\n]*+%%EOF[\r\n]*+\Z")
_SECTION = re.compile(rb"[ \r\n]*([0-9]+) ([0-9]+) *" + _EOL)
_ENTRY = re.compile(rb"([0-9]{10}) ([0-9]{5}) ([nf])(?: [\r\n]|\r\n)")
_STREAM_EOL = re.compile(rb"\r\n|\n|\r")


class Entry(NamedTuple):
    kind: str
    off: int
    idx: int | None = None


@dataclass
class Document:
    data: bytes
    options: Options
    version: int | None = None  # the minor number; -1 if any version is allowed and it isn't known
    updates: int = -1
    xref: dict[Ref, list[Entry]] = field(default_factory=dict)
    trailers: list[dict[str, Any]] = field(default_factory=list)  # newest first
    objects: dict[Ref, Any] = field(default_factory=dict)
    origin: dict[Ref, str] = field(default_factory=dict)  # file or objstm
    special: dict[Ref, str] = field(default_factory=dict)  # objstm or xrefstm
    extents: list[tuple[int, int, Key]] = field(default_factory=list)
    handler: crypt.Handler | None = None
    encrypt_ref: Ref | None = None
    has_objstm: bool = False
    has_free: bool = False
    complete: bool = False
    kept: dict[str, Any] = field(default_factory=dict, repr=False)  # what was already derived, by what it is
    errors: list[PdfError] = field(default_factory=list)

    @property
    def trailer(self) -> dict[str, Any]:
        return self.trailers[0] if self.trailers else {}

    def get(self, x: Any) -> Any:
        """The object a reference leads to (one step), None if there is none; other values as they are."""
        return self.objects.get(x) if isinstance(x, Ref) else x

    def all(self) -> list[tuple[Key, Any]]:
        """Every object in key order, then the main trailer."""
        return [*sorted(self.objects.items()), (TRAILER, self.trailer)]


def _whole(x: Any) -> bool:
    return type(x) is int


def _natural(x: Any, place: Place, least: int = 0) -> int:
    if not _whole(x) or x < least:
        raise PdfError("Expected positive integer" if least else "Expected non-negative integer", place)
    return x


class Loader:
    """The lenient reader: objects are fetched where the cross-reference table says."""

    def __init__(self, doc: Document):
        self.doc, self.data, self.options = doc, doc.data, doc.options
        self.busy: set[Ref] = set()
        self.containers: dict[Ref, list[tuple[int, Any]]] = {}
        self.seen: set[int] = set()

    # --- structure ---

    def header(self) -> None:
        m = _HEADER.match(self.data)
        if m and (m[1] == b"1" and m[2] <= b"7"):
            self.doc.version = int(m[2])
            self.doc.extents.append((0, m.end() - 1, "version"))
        elif self.options.allow_invalid_version:
            if self.data[:4] != b"%PDF":
                raise PdfError("Invalid PDF signature", Place(offset=0))
            self.doc.version = -1
        elif m:
            raise PdfError(f"Invalid PDF version : {m[1].decode()}.{m[2].decode()}", Place(offset=0))
        else:
            raise PdfError("Syntax error", Place(offset=0))

    def structure(self) -> None:
        last = self.data.rfind(b"startxref")  # nothing but line ends may follow the end mark, however many
        m = _TAIL.match(self.data, last) if last >= 0 else None
        if not m:
            raise PdfError("No startxref found")
        self.doc.extents.append((m.start(), len(self.data) - 1, TRAILER))
        pending: list[tuple[int, Place]] = [(int(m[1]), Place())]
        while pending:
            at, place = pending.pop()
            trailer = self.section(at)
            self.doc.trailers.append(trailer)
            self.doc.updates += 1
            here = Place(TRAILER, offset=at)
            for key in ("Prev", "XRefStm"):  # the stack takes XRefStm first
                if key in trailer:
                    pending.append((_natural(trailer[key], here.at(f"/{key}"), 1), here))
        if self.options.zero_offset_as_free:
            for ref, entries in self.doc.xref.items():
                for i, e in enumerate(entries):
                    if e.kind == INUSE and e.off == 0:
                        self.options.warnings.append(f"in-use object {ref.num} is at offset 0, it should be marked as free instead")
                        entries[i] = Entry(FREE, 0)

    def add(self, ref: Ref, entry: Entry) -> None:
        """The first entry of a key stays its head; later ones come right behind it."""
        entries = self.doc.xref.setdefault(ref, [])
        entries.insert(min(1, len(entries)), entry)

    def section(self, at: int) -> dict[str, Any]:
        if at in self.seen:
            raise PdfError("Cyclic xref tables detected", Place(offset=at))
        self.seen.add(at)
        if at >= len(self.data):
            raise PdfError("Invalid startxref", Place(offset=at))
        m = re.compile(rb"xref *" + _EOL).match(self.data, at)
        return self.table(at, m.end()) if m else self.xref_stream(at)

    def table(self, start: int, at: int) -> dict[str, Any]:
        while m := _SECTION.match(self.data, at):
            first, count = int(m[1]), int(m[2])
            at = m.end()
            for num in range(first, first + count):
                e = _ENTRY.match(self.data, at)
                if not e:
                    raise self.unexpected(at, rb"[0-9 nf\r\n]")
                self.add(Ref(num, int(e[2])), Entry(INUSE if e[3] == b"n" else FREE, int(e[1])))
                at = e.end()
        scanner = Scanner(self.data, at, self.options)
        if scanner.token() != b"trailer":
            raise self.unexpected(scanner.start, rb"[0-9 a-z\r\n]")
        value, keyword = scanner.value()
        if not isinstance(value, dict):
            raise SyntaxFault(scanner.start)
        self.doc.extents.append((start, scanner.start - 1, TRAILER))
        return value

    def unexpected(self, at: int, fine: bytes) -> PdfError:
        """The first byte from ``at`` on its line that a table can't hold, or a plain syntax error."""
        for i in range(at, min(at + 20, len(self.data))):
            if not re.match(fine, self.data[i : i + 1]):
                return LexError(f"unexpected character : 0x{self.data[i]:x}", i)
        return SyntaxFault(at)

    def xref_stream(self, at: int) -> dict[str, Any]:
        ref, value = self.indirect(at, None)
        place = Place(ref, offset=at)
        if not isinstance(value, Stream):
            raise PdfError("Expected stream for xref but got non-stream object", place)
        d = value.dict
        content = self.decoded(value, place)
        w = d.get("W")
        if not isinstance(w, list) or len(w) != 3 or not all(_whole(x) and x >= 0 for x in w):
            raise PdfError("Expected array of 3 non-negative ints", place.at("/W"))
        size = _natural(d.get("Size"), place.at("/Size"))
        index = d.get("Index", [0, size])
        if not isinstance(index, list) or not all(_whole(x) and x >= 0 for x in index):
            raise PdfError("Expected array of non-negative ints", place.at("/Index"))
        if len(index) % 2 or not index:
            raise PdfError("Expected pairs of ints", place.at("/Index"))
        pairs = list(zip(index[::2], index[1::2]))
        if any(b[0] < a[0] + a[1] for a, b in zip(pairs, pairs[1:])):
            raise PdfError("Xref stream subsections must come in ascending order", place.at("/Index"))
        if sum(n for _, n in pairs) * sum(w) != len(content):
            raise PdfError("Xref stream length does not match parameters", place.at("/W"))
        pos = 0
        for num in (n for first, count in pairs for n in range(first, first + count)):
            spot = Place(Ref(num, 0), offset=pos, inside=ref)
            cells = []
            for width in w:
                cells.append(int.from_bytes(content[pos : pos + width], "big") if width else None)
                pos += width
            kind = 1 if cells[0] is None else cells[0]
            if kind not in (0, 1, 2):
                raise PdfError("Error in xref stream", spot)
            if cells[1] is None:
                raise PdfError("Convert error in xref stream : Binary integer has length zero", spot)
            if cells[2] is None and kind != 1:
                message = "Free object entry in xref stream has no next generation number" if kind == 0 else "Compressed object entry in xref stream has no index"
                if not self.options.xref_stream_default_zero:
                    raise PdfError(message, spot)
                self.options.warnings.append(message + str(spot))
            last = cells[2] or 0
            if kind == 2:
                self.add(Ref(num, 0), Entry(COMPRESSED, cells[1], last))
            else:
                self.add(Ref(num, last), Entry(INUSE if kind else FREE, cells[1]))
        self.doc.special[ref] = "xrefstm"
        return d

    # --- objects ---

    def indirect(self, at: int, want: Ref | None, resolve: bool = False) -> tuple[Ref, Any]:
        """The object at a byte; the extent is noted when it was asked for by key."""
        place = Place(want, offset=at)
        scanner = Scanner(self.data, at, self.options)
        try:
            head = [scanner.token() for _ in range(3)]
            if not (_whole(head[0]) and _whole(head[1]) and head[0] >= 0 and head[1] >= 0 and head[2] == b"obj"):
                raise SyntaxFault(scanner.start)
            ref = Ref(head[0], head[1])
            place.key = ref if want is None else want
            value, keyword = scanner.value()
            if keyword == b"endobj" and value is not ...:
                end = scanner.at - 1
            elif keyword == b"stream" and isinstance(value, dict):
                eol = _STREAM_EOL.match(self.data, scanner.at)
                body = eol.end() if eol else scanner.at
            else:
                raise SyntaxFault(scanner.start)
        except PdfError as e:
            e.place = Place(place.key, offset=at if e.place.offset is None else e.place.offset)
            raise
        if want is not None and ref != want:
            raise PdfError("Object definition does not match xref table", place)
        if keyword == b"stream":
            if resolve:
                value = {k: self.resolved(v) if k in ("Length", "Filter", "DecodeParms") else v for k, v in value.items()}
                value = {k: v for k, v in value.items() if v is not None}
            length = _natural(value.get("Length"), place.at("/Length"))
            if body + length >= len(self.data):
                raise PdfError("Stream size is out of bounds", Place(place.key, "/Length", body))
            after = Scanner(self.data, body + length, self.options)
            try:
                if after.token() != b"endstream" or after.token() != b"endobj":
                    raise SyntaxFault(after.start)
            except PdfError as e:
                e.place.key = place.key
                raise
            end = after.at - 1
            value = Stream(value, self.data[body : body + length])
        if want is not None:
            self.doc.extents.append((at, end, want))
        return ref, value

    def resolved(self, x: Any) -> Any:
        """References replaced by what they lead to, at any depth; one to a stream stays."""
        if isinstance(x, Ref):
            target = self.named(x)
            if isinstance(target, Stream):
                return x
            self.busy.add(x)
            out = self.resolved(target)
            self.busy.discard(x)
            return out
        if isinstance(x, dict):
            return {k: self.resolved(v) for k, v in x.items()}
        if isinstance(x, list):
            return [self.resolved(v) for v in x]
        return x

    def named(self, ref: Ref) -> Any:
        entries = self.doc.xref.get(ref)
        if not entries:
            raise PdfError("Reference to undeclared object", Place(ref))
        if entries[0].kind == FREE:
            raise PdfError("Reference to free object", Place(ref))
        return self.fetch(ref, entries[0])

    def fetch(self, ref: Ref, entry: Entry) -> Any:
        place = Place(ref, offset=entry.off) if entry.kind == INUSE else Place(ref, inside=Ref(entry.off, 0), index=entry.idx)
        if ref in self.busy:
            raise PdfError("Circular definition detected", place)
        if ref in self.doc.objects:
            return self.doc.objects[ref]
        self.busy.add(ref)
        if entry.kind == INUSE:
            if entry.off >= len(self.data):
                raise PdfError("Object position is out of bounds", place)
            value = self.decrypted(ref, self.indirect(entry.off, ref, resolve=True)[1])
        else:
            value = self.compressed(ref, entry, place)
        self.busy.discard(ref)
        self.doc.objects[ref] = value
        self.doc.origin[ref] = "file" if entry.kind == INUSE else "objstm"
        return value

    def decrypted(self, ref: Ref, value: Any) -> Any:
        h = self.doc.handler
        if not h or ref == self.doc.encrypt_ref:
            return value
        kind = value.dict.get("Type") if isinstance(value, Stream) else None
        if kind == "XRef" or (kind == "Metadata" and not h.metadata):
            return value
        try:
            out = edit(value, lambda x: h.decrypt(ref, x, strings=True) if isinstance(x, bytes) else x)
            if isinstance(out, Stream):
                out.raw = h.decrypt(ref, out.raw)
                out.dict["Length"] = len(out.raw)
        except PdfError as e:
            e.place.key = ref
            raise
        return out

    def decoded(self, s: Stream, place: Place) -> bytes:
        if s.data is None:
            s.data = decode_stream(s, place, self.options)
        return s.data

    def compressed(self, ref: Ref, entry: Entry, place: Place) -> Any:
        holder = Ref(entry.off, 0)
        if holder not in self.containers:
            entries = self.doc.xref.get(holder)
            if not entries or entries[0].kind != INUSE:
                raise PdfError("Object stream must not be free or compressed", Place(holder))
            s = self.fetch(holder, entries[0])
            if not isinstance(s, Stream):
                raise PdfError("Object stream must be a stream", Place(holder))
            self.containers[holder] = self.members(holder, s)
            self.doc.special[holder] = "objstm"
        members = self.containers[holder]
        found = next((i for i, (num, _) in enumerate(members) if num == ref.num), None)
        if found is None:
            raise PdfError("Object not found in object stream", place)
        if found != entry.idx:
            raise PdfError("Compressed object index does not match object stream", place)
        return members[found][1]

    def members(self, holder: Ref, s: Stream) -> list[tuple[int, Any]]:
        place = Place(holder)
        n = _natural(s.dict.get("N"), place.at("/N"))
        first = _natural(s.dict.get("First"), place.at("/First"), 1)
        body = self.decoded(s, place)
        if first >= len(body):
            raise PdfError("First entry is beyond size of object stream", place)
        scanner, head = Scanner(body, 0, self.options, end=first), []
        try:
            while not isinstance(t := scanner.token(), Keyword):
                head.append(t)
        except PdfError:
            raise PdfError("Parsing error in object stream", place) from None
        if not all(_whole(x) and x >= 0 for x in head) or len(head) % 2 or t != b"":
            raise PdfError("Parsing error in object stream", place)
        if len(head) != 2 * n:
            raise PdfError("Number of entries does not match /N in object stream", place)
        nums, offs = head[::2], head[1::2]
        if n and offs[0]:
            raise PdfError("First offset must be zero in object stream", place)
        if n and first + offs[-1] >= len(body):
            raise PdfError("Last entry offset is beyond object stream size", place)
        if any(b <= a for a, b in zip(offs, offs[1:])):
            raise PdfError("Offsets are not in increasing order in object stream", place)
        if len(set(nums)) < len(nums):
            raise PdfError("Object appears several times in object stream", place)
        out = []
        for i, (num, off) in enumerate(zip(nums, offs)):
            end = first + offs[i + 1] if i + 1 < n else len(body)
            try:
                value, rest = Scanner(body, first + off, self.options, end=end).value()
                if value is ... or rest != b"":
                    raise SyntaxFault(first + off)
            except PdfError as e:
                e.place = Place(Ref(num, 0), inside=holder, index=i)
                raise
            out.append((num, value))
        return out

    def encryption(self) -> None:
        trailer = self.doc.trailer
        x = trailer.get("Encrypt")
        if self.options.ignore_crypt or x is None:
            return
        if self.options.no_decrypt:
            raise PdfError("Encrypted document")
        if isinstance(x, Ref):
            self.doc.encrypt_ref = x
            entries = self.doc.xref.get(x)
            if not entries or entries[0].kind == FREE:
                raise PdfError("/Encrypt object is free", Place(x))
            d = self.resolved(x)
        else:
            d = self.resolved(x)
        if not isinstance(d, dict):
            raise PdfError("/Encrypt shall be a dictionary", Place(TRAILER, "/Encrypt"))
        ids = self.resolved(trailer.get("ID"))
        if not isinstance(ids, list) or len(ids) != 2 or not all(isinstance(i, bytes) for i in ids):
            raise PdfError("Expected array of two strings", Place(TRAILER, "/ID"))
        try:
            self.doc.handler = crypt.handler(d, ids[0], self.options.user_password, self.options.owner_password)
        except PdfError as e:
            e.place.key = self.doc.encrypt_ref or TRAILER
            raise

    def load(self, only: Ref | str | None = None) -> None:
        doc = self.doc
        self.header()
        self.structure()
        if only == STRUCTURE:
            return
        self.encryption()
        if isinstance(only, Ref):
            self.named(only)
            return
        for ref, entries in doc.xref.items():
            doc.has_objstm |= any(e.kind == COMPRESSED for e in entries)
            doc.has_free |= ref.num != 0 and any(e.kind == FREE for e in entries)
        for ref, entries in sorted(doc.xref.items()):
            for e in entries:
                if e.kind != FREE:
                    self.fetch(ref, e)
        if not self.options.allow_overlaps and (clash := overlap(doc.extents)):
            (low1, high1, key1), (low2, high2, key2) = clash
            raise PdfError(f"The following objects overlap : {_key(key1)} at [0x{low1:x}, 0x{high1:x}] and {_key(key2)} at [0x{low2:x}, 0x{high2:x}]")


def _key(key: Key) -> str:
    from quire.kernels.model import key_text

    return key_text(key)


def overlap(extents: list[tuple[int, int, Key]]) -> tuple | None:
    """The first two extents in order of their start that share a byte."""
    rows = sorted(extents, key=lambda e: e[0])
    return next(((a, b) for a, b in zip(rows, rows[1:]) if b[0] <= a[1]), None)


def decode_stream(s: Stream, place: Place, options: Options) -> bytes:
    filters, parms = s.dict.get("Filter"), s.dict.get("DecodeParms")
    filters = [] if filters is None else filters if isinstance(filters, list) else [filters]
    if not all(isinstance(f, Name) for f in filters):
        raise PdfError("Expected name or array of names", place.at("/Filter"))
    if parms is not None:
        parms = parms if isinstance(parms, list) else [parms]
        if len(parms) != len(filters) or not all(p is None or isinstance(p, dict) for p in parms):
            raise PdfError("Expected dictionary or array of dictionaries", place.at("/DecodeParms"))
    try:
        return codecs.decode_chain(s.raw, filters, parms, options.warnings)
    except codecs.CodecError as e:
        raise PdfError(str(e), place) from None


# --- the strict reader ---------------------------------------------------------

_STRICT_MARK = re.compile(rb"%[\x80-\xff]{4}" + _EOL)
_STRICT_ENTRY = re.compile(rb"([0-9]{10}) ([0-9]{5}) ([nf])(?: [\r\n]|\r\n)")


def load_strict(doc: Document) -> None:
    """The whole file against one linear grammar: header, objects, one table from 0, trailer, end."""
    data, options = doc.data, Options(strict=True)
    m = _HEADER.match(data)
    if not m or m[1] != b"1" or m[2] > b"7":
        raise PdfError("Syntax error", Place(offset=0))
    version, at = int(m[2]), m.end()
    if mark := _STRICT_MARK.match(data, at):
        at = mark.end()
    found: dict[Ref, int] = {}
    while True:
        scanner = Scanner(data, at, options, strict=True)
        try:
            head = scanner.token()
            start = scanner.start
            if head == b"xref":
                break
            gen, word = scanner.token(), scanner.token()
            if not (_whole(head) and _whole(gen) and word == b"obj"):
                raise SyntaxFault(scanner.start)
            value, keyword = scanner.value()
            if keyword == b"stream" and isinstance(value, dict):
                eol = re.compile(rb"\r\n|\n").match(data, scanner.at)
                if not eol:
                    raise SyntaxFault(scanner.at)
                stop = data.find(b"endstream", eol.end())
                if stop < 0:
                    raise LexError("stream is not terminated at end of file", len(data))
                value = Stream(value, data[eol.end() : stop])
                scanner.at = stop + len(b"endstream")
                keyword = scanner.token()
            if keyword != b"endobj" or value is ...:
                raise SyntaxFault(scanner.start)
        except PdfError as e:
            if e.place.offset is None:
                e.place.offset = at
            raise
        ref = Ref(head, gen)
        found[ref] = start
        doc.objects[ref] = value
        doc.origin[ref] = "file"
        doc.extents.append((start, scanner.at - 1, ref))
        at = scanner.at
    table = start
    m = re.compile(rb"xref *" + _EOL + rb"([0-9]+) ([0-9]+) *" + _EOL).match(data, table)
    if not m:
        raise SyntaxFault(table)
    first, count, at = int(m[1]), int(m[2]), m.end()
    entries = []
    while e := _STRICT_ENTRY.match(data, at):
        entries.append(e)
        at = e.end()
    if len(entries) != count:
        raise PdfError("Missmatch between number of entries and xref section header", Place(offset=table))
    if first:
        raise PdfError("Xref does not start at object 0", Place(offset=table))
    for num, e in enumerate(entries):
        doc.xref[Ref(num, int(e[2]))] = [Entry(INUSE if e[3] == b"n" else FREE, int(e[1]))]
    scanner = Scanner(data, at, options, strict=True)
    if scanner.token() != b"trailer":
        raise SyntaxFault(scanner.start)
    trailer, keyword = scanner.value()
    if not isinstance(trailer, dict) or keyword != b"startxref":
        raise SyntaxFault(scanner.start)
    where = scanner.token()
    if not _whole(where) or not re.compile(_EOL + rb"%%EOF[\r\n]*\Z").match(data, scanner.at):
        raise SyntaxFault(scanner.start)
    if where != table:
        raise PdfError("Startxref does not match real position", Place(offset=table))
    for ref, pos in sorted(found.items()):
        entry = doc.xref.get(ref)
        if not entry or entry[0].kind != INUSE:
            raise PdfError("Xref table does not contain object", Place(ref, offset=pos))
        if entry[0].off != pos:
            raise PdfError(f"Xref table states position {entry[0].off}, which does not match", Place(ref, offset=pos))
    for ref, (entry,) in sorted(doc.xref.items()):
        if entry.kind == INUSE and ref not in found:
            raise PdfError("Xref table contains object that does not exist", Place(ref, offset=entry.off))
    doc.trailers.append(trailer)
    doc.version, doc.updates = version, 0
    for ref in sorted(doc.objects):
        if ref.gen:
            raise PdfError("Object has a non-zero generation number", Place(ref))
    for ref, value in sorted(doc.objects.items()):
        if isinstance(value, Stream):
            length = _natural(doc.get(value.dict.get("Length")), Place(ref, "/Length"))
            rest = value.raw[length:] if length <= len(value.raw) else b"?"
            if rest not in (b"", b"\r", b"\n", b"\r\n"):
                raise PdfError(f"Length ({len(value.raw)}) of stream does not match reported length ({length})", Place(ref, "/Length"))
            value.raw = value.raw[:length]
            for word in (b"endstream", b"endobj", b"trailer"):
                if word in value.raw:
                    raise PdfError(f'Stream contains unallowed keyword "{word.decode()}"', Place(ref))


def undefined_to_null(doc: Document) -> None:
    """References to objects that aren't there become null, in every trailer and object; each is a warning."""

    def change(key: Key, x: Any) -> Any:
        lost = [(path, v) for path, v in walk(x) if isinstance(v, Ref) and v not in doc.objects]
        doc.options.warnings += [f"Reference to unknown object : {_key(v)}{Place(key, path)}" for path, v in lost]
        return edit(x, lambda v: None if isinstance(v, Ref) and v not in doc.objects else v) if lost else x

    doc.trailers = [change(TRAILER, t) for t in doc.trailers]
    doc.objects = {k: change(k, v) for k, v in doc.objects.items()}


def load(data: bytes, options: Options | None = None, only: Ref | str | None = None) -> Document:
    """The document; with ``only`` just its cross-reference table and trailers (STRUCTURE), or one object besides.

    The strict grammar always reads the whole file.
    """
    doc = Document(data, options or Options())
    try:
        if len(data) > 2**31 - 1:
            raise PdfError("integer overflow")
        load_strict(doc) if doc.options.strict else Loader(doc).load(only)
        if doc.options.undefined_ref_as_null and only is None:
            undefined_to_null(doc)
        if doc.options.decode_streams:
            for ref, s in sorted(doc.objects.items()):
                if isinstance(s, Stream) and s.data is None:
                    try:
                        s.data = decode_stream(s, Place(ref), doc.options)
                    except PdfError as e:
                        if not doc.options.relax_streams:
                            raise
                        s.error = str(e)
        doc.complete = True
    except PdfError as e:
        doc.errors.append(e)
    except RecursionError:
        doc.errors.append(PdfError("Circular definition detected"))
    return doc
