"""Small files made from text, for tests and for queries over files."""

from __future__ import annotations

import hashlib
from typing import Any

import numpy as np

from quire.kernels import codecs, crypt, writer
from quire.kernels.model import Name, Ref, Stream, compact, edit, escape_string

HEAD = b"%PDF-1.5\n%\x80\x80\x80\x80\n"


def hello(text: str, filter_name: str = "") -> tuple[dict[Ref, Any], dict[str, Any]]:
    """Six objects: catalog, page root, page, a content stream that shows the text, font, info."""
    shown = escape_string(text.encode("utf-8")).encode("latin-1")
    raw = codecs.encode(b"BT /F1 12 Tf 10 20 Td (" + shown + b") Tj ET", filter_name)
    stream = Stream({"Length": len(raw)} | ({"Filter": Name(filter_name)} if filter_name else {}), raw)
    objects = {
        Ref(1, 0): {"Type": Name("Catalog"), "Pages": Ref(2, 0)},
        Ref(2, 0): {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1},
        Ref(3, 0): {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, 300, 400], "Contents": Ref(4, 0), "Resources": {"Font": {"F1": Ref(5, 0)}}},
        Ref(4, 0): stream,
        Ref(5, 0): {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")},
        Ref(6, 0): {"Title": b"text"},
    }
    return objects, {"Root": Ref(1, 0), "Info": Ref(6, 0), "Size": 7}


def hello_file(text: str, filter_name: str = "") -> bytes:
    return writer.write(*hello(text, filter_name), head=HEAD)


# --- files of many kinds ---------------------------------------------------------

#: What ``varied`` builds, by number: the number of a text modulo their count picks one.
VARIANTS = (
    "plain", "xref_stream", "object_stream", "one_update", "two_updates", "hybrid", "rc4_40", "rc4_128", "crypt_rc4", "crypt_aes", "hex",
    "ascii85", "runlength", "lzw", "flate", "predictor", "chain", "indirect_length", "two_parts", "trees", "info_extra", "wrong_offset",
    "outline_cycle", "page_cycle", "long_length", "hole", "overlap", "duplicate_key", "no_startxref", "undefined", "bad_version", "content_error",
)
PASSWORD, FILE_ID = b"secret", b"0123456789abcdef"
_FILTER = {"hex": "ASCIIHexDecode", "ascii85": "ASCII85Decode", "runlength": "RunLengthDecode", "lzw": "LZWDecode", "flate": "FlateDecode"}
_CRYPT = {"rc4_40": (1, 2, 40, None), "rc4_128": (2, 3, 128, None), "crypt_rc4": (4, 4, 128, "V2"), "crypt_aes": (4, 4, 128, "AESV2")}
COLUMNS = 8  # bytes of a row under the predictor


class _File:
    """Bytes with the places of the objects written so far."""

    def __init__(self, head: bytes = HEAD):
        self.out = bytearray(head)
        self.at: dict[int, int] = {}

    def object(self, num: int, value: Any) -> None:
        self.at[num] = len(self.out)
        gap = b"\n" if isinstance(value, (Stream, int)) else b""
        self.out += b"%d 0 obj%s%s%sendobj\n" % (num, gap if isinstance(value, int) else b"", compact(value).encode("latin-1"), gap)

    def table(self, rows: dict[int, bytes], trailer: dict[str, Any]) -> int:
        start = len(self.out)
        self.out += b"xref\n"
        for first in sorted(n for n in rows if n - 1 not in rows):
            run = [n for n in range(first, max(rows) + 1) if all(m in rows for m in range(first, n + 1))]
            self.out += b"%d %d\n" % (first, len(run)) + b"".join(b"%s \n" % rows[n] for n in run)
        self.out += b"trailer\n%s\n" % compact(trailer).encode("latin-1")
        return start

    def used(self, *nums: int) -> dict[int, bytes]:
        return {n: b"%010d 00000 n" % self.at[n] for n in nums}

    def xref_stream(self, num: int, compressed: dict[int, tuple[int, int]], trailer: dict[str, Any], nums: list[int]) -> int:
        """Rows of 1, 4 and 2 bytes of the numbers named, in runs."""
        self.at[num] = start = len(self.out)
        body, index = b"", []
        for n in nums:
            kind, a, b = (2, *compressed[n]) if n in compressed else (1, self.at[n], 0) if n in self.at else (0, 0, 65535)
            body += bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big")
            if index and sum(index[-2:]) == n:
                index[-1] += 1
            else:
                index += [n, 1]
        raw = codecs.encode(body, "FlateDecode")
        self.object(num, Stream({"Type": Name("XRef"), "W": [1, 4, 2], "Index": index, "Filter": Name("FlateDecode"), "Length": len(raw)} | trailer, raw))
        return start

    def end(self, start: int) -> bytes:
        return bytes(self.out + b"startxref\n%d\n%%%%EOF\n" % start)


def _object_stream(objects: dict[Ref, Any], nums: list[int]) -> Stream:
    texts = [compact(objects[Ref(n, 0)]).encode("latin-1") for n in nums]
    head = b" ".join(b"%d %d" % (n, sum(len(t) + 1 for t in texts[:i])) for i, n in enumerate(nums)) + b"\n"
    raw = codecs.encode(head + b" ".join(texts), "FlateDecode")
    return Stream({"Type": Name("ObjStm"), "N": len(nums), "First": len(head), "Filter": Name("FlateDecode"), "Length": len(raw)}, raw)


def _sealed(objects: dict[Ref, Any], name: str) -> tuple[dict[Ref, Any], dict[str, Any]]:
    """The objects under the user password, and the entries of the trailer that say so."""
    version, revision, bits, method = _CRYPT[name]
    d: dict[str, Any] = {"Filter": Name("Standard"), "V": version, "R": revision, "Length": bits, "P": -44, "O": bytes(range(32)), "U": bytes(32)}
    if method:
        d |= {"CF": {"StdCF": {"CFM": Name(method)}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    key = crypt._file_key(PASSWORD, d, FILE_ID, bits, revision, True)
    d["U"] = crypt._user_mark(key, FILE_ID, revision).ljust(32, b"\0")
    handler = crypt.handler(d, FILE_ID, PASSWORD)
    out = {}
    for ref, x in objects.items():
        x = edit(x, lambda v: handler.encrypt(ref, v, strings=True) if isinstance(v, bytes) else v)
        if isinstance(x, Stream):
            x.raw = handler.encrypt(ref, x.raw)
            x.dict["Length"] = len(x.raw)
        out[ref] = x
    return out, {"Encrypt": d, "ID": [FILE_ID, FILE_ID]}


def _up_rows(data: bytes) -> bytes:
    """Rows of COLUMNS bytes, each less the row above it."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, COLUMNS)
    above = np.vstack([np.zeros((1, COLUMNS), np.uint8), rows[:-1]])
    return np.hstack([np.full((len(rows), 1), 2, np.uint8), rows - above]).tobytes()


def varied(name: str, text: str, size: int) -> bytes:
    """A file with the text as title and on its page, of the kind named; ``size`` is a small number that some kinds use."""
    objects, trailer = hello(text)
    objects[Ref(6, 0)] = {"Title": text.encode("utf-8")}
    content = objects[Ref(4, 0)].raw
    page = objects[Ref(3, 0)]
    later = hashlib.md5(text.encode("utf-8")).hexdigest().encode()

    def stream(raw: bytes, **more: Any) -> Stream:
        return Stream({"Length": len(raw)} | more, raw)

    if name in _FILTER:
        objects[Ref(4, 0)] = stream(codecs.encode(content, _FILTER[name]), Filter=Name(_FILTER[name]))
    elif name == "predictor":
        padded = content + b" " * (-len(content) % COLUMNS)
        objects[Ref(4, 0)] = stream(codecs.encode(_up_rows(padded), "FlateDecode"), Filter=Name("FlateDecode"), DecodeParms={"Predictor": 12, "Columns": COLUMNS})
    elif name == "chain":
        objects[Ref(4, 0)] = stream(codecs.encode(codecs.encode(content, "FlateDecode"), "ASCII85Decode"), Filter=[Name("ASCII85Decode"), Name("FlateDecode")])
    elif name == "indirect_length":
        objects[Ref(7, 0)] = len(content)
        objects[Ref(4, 0)] = Stream({"Length": Ref(7, 0)}, content)
    elif name == "two_parts":
        objects[Ref(7, 0)] = stream(b"q Q")
        page["Contents"] = [Ref(4, 0), Ref(7, 0)]
    elif name == "content_error":
        objects[Ref(4, 0)] = stream(content + b" Q")
    elif name == "trees":
        # Two levels of pages, a name tree and an outline of ``size`` items.
        kids = [Ref(10 + i, 0) for i in range(size)]
        objects[Ref(2, 0)] = {"Type": Name("Pages"), "Kids": [Ref(7, 0)], "Count": size}
        objects[Ref(7, 0)] = {"Type": Name("Pages"), "Parent": Ref(2, 0), "Kids": [Ref(3, 0), *kids[1:]], "Count": size}
        page["Parent"] = Ref(7, 0)
        objects |= {k: dict(page) for k in kids[1:]}
        items = [Ref(100 + i, 0) for i in range(size)]
        objects[Ref(1, 0)] |= {"Outlines": Ref(8, 0), "Names": {"Dests": Ref(9, 0)}}
        objects[Ref(8, 0)] = {"First": items[0], "Last": items[-1], "Count": size}
        objects[Ref(9, 0)] = {"Names": [b"top", {"D": [Ref(3, 0), Name("Fit")]}]}
        for i, item in enumerate(items):
            near = {k: items[j] for k, j in (("Prev", i - 1), ("Next", i + 1)) if 0 <= j < size}
            objects[item] = {"Title": b"item %d" % i, "Parent": Ref(8, 0)} | near
    elif name == "info_extra":
        objects[Ref(6, 0)] |= {"Producer": b"maker", "Other": b"more", "PTEX.Fullbanner": b"banner", "CreationDate": b"D:20240101000000Z"}
    elif name == "outline_cycle":
        objects[Ref(1, 0)]["Outlines"] = Ref(7, 0)
        objects[Ref(7, 0)] = {"First": Ref(8, 0), "Last": Ref(9, 0), "Count": 2}
        objects[Ref(8, 0)] = {"Title": b"a", "Parent": Ref(7, 0), "Next": Ref(8, 0)}
        objects[Ref(9, 0)] = {"Title": b"b", "Parent": Ref(7, 0), "Prev": Ref(8, 0)}
    elif name == "page_cycle":
        objects[Ref(2, 0)]["Kids"] = [Ref(7, 0), Ref(3, 0)]
        objects[Ref(7, 0)] = {"Type": Name("Pages"), "Parent": Ref(2, 0), "Kids": [Ref(3, 0)], "Count": 1}
    elif name == "long_length":
        objects[Ref(4, 0)] = Stream({"Length": 1_999_999_999}, content)
    elif name == "undefined":
        page["Annots"] = Ref(50, 0)
    elif name in _CRYPT:
        objects, more = _sealed(objects, name)
        trailer |= more

    f = _File(b"%PDF-1.9\n%\x80\x80\x80\x80\n" if name == "bad_version" else HEAD)
    if name == "hole":
        f.out += b"junk " * (size + 1)
    inner = [1, 2, 3, 5, 6] if name == "object_stream" else [5] if name == "hybrid" else []
    if name == "overlap":
        objects[Ref(1, 0)]["X"] = b"2 0 obj" + compact(objects.pop(Ref(2, 0))).encode() + b"endobj"
    for ref, value in sorted(objects.items()):
        if ref.num not in inner:
            f.object(ref.num, value)
    if name == "overlap":
        f.at[2] = f.out.index(b"2 0 obj")
    if name == "wrong_offset":
        f.at[2] += 1
    last = max(r.num for r in objects)
    trailer["Size"] = last + 1
    if name == "duplicate_key":  # as long as it was
        f.out[:] = f.out.replace(b"/MediaBox[0 0 300 400]", b"/Type/Page/MediaBox[ ]", 1)
    free = {0: b"0000000000 65535 f"}
    if name == "xref_stream":
        return f.end(f.xref_stream(7, {}, trailer | {"Size": 8}, list(range(8))))
    if name == "object_stream":
        f.object(7, _object_stream(objects, inner))
        return f.end(f.xref_stream(8, {n: (7, i) for i, n in enumerate(inner)}, trailer | {"Size": 9}, list(range(9))))
    if name == "hybrid":
        f.object(7, _object_stream(objects, inner))
        at = f.xref_stream(8, {5: (7, 0)}, {"Size": 9}, [5, 7, 8])
        return f.end(f.table(free | f.used(1, 2, 3, 4, 6), trailer | {"Size": 9, "XRefStm": at}))
    if name in ("one_update", "two_updates"):
        f.object(7, {"Unused": True})
    start = f.table(free | f.used(*f.at), trailer | ({"Size": 8} if 7 in f.at else {}))
    if name == "no_startxref":
        return bytes(f.out)
    data = f.end(start)
    for k in range({"one_update": 1, "two_updates": 2}.get(name, 0)):
        f.out[:] = data
        f.object(6, {"Title": later if k else later.upper()})
        rows = f.used(6) | ({7: b"0000000000 00001 f"} if not k else {})
        data = f.end(start := f.table(rows, trailer | {"Size": 8, "Prev": start}))
    return data
