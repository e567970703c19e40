"""Files written from objects."""

from __future__ import annotations

from typing import Any

from quire.kernels.model import Ref, Stream, _wordy, compact

HEAD = b"%PDF-1.7\n%\x80\x80\x80\x80\n"


def write(objects: dict[Ref, Any], trailer: dict[str, Any], head: bytes = HEAD) -> bytes:
    """Header, objects in key order, the table (one section from 0 if the numbers are dense), trailer; no line end after the end mark."""
    out = [head]
    at = len(head)
    offsets: dict[Ref, int] = {}
    for ref, value in sorted(objects.items()):
        text = compact(value).encode("latin-1")
        before = b" " if _wordy(value) else b""
        after = b" " if _wordy(value, True) else b""
        body = b"%d %d obj%s%s%sendobj\n" % (ref.num, ref.gen, before, text, after)
        if isinstance(value, Stream):
            body = b"%d %d obj%s\nendobj\n" % (ref.num, ref.gen, text)
        offsets[ref] = at
        out.append(body)
        at += len(body)
    rows = {0: b"0000000000 65535 f \n"} | {r.num: b"%010d %05d n \n" % (o, r.gen) for r, o in offsets.items()}
    out.append(b"xref\n")
    for first in sorted(n for n in rows if n - 1 not in rows):
        last = first
        while last + 1 in rows:
            last += 1
        out.append(b"%d %d\n" % (first, last - first + 1))
        out += [rows[n] for n in range(first, last + 1)]
    out.append(b"trailer\n%s\nstartxref\n%d\n%%%%EOF" % (compact(trailer).encode("latin-1"), at))
    return b"".join(out)
