"""What is reported of one file: statistics, the cross-reference table, objects, layout, graphs; and its normal form."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quire.kernels import codecs, pagelang, schema, trees, writer
from quire.kernels.document import COMPRESSED, FREE, Document, decode_stream
from quire.kernels.model import TRAILER, Key, Name, PdfError, Place, Ref, Stream, edit, key_id, key_text, pretty, walk

# The keys that are kept of the trailer, and of the information dictionary.
TRAILER_KEYS = ("Size", "Root", "Info", "ID")
INFO_KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped")


@dataclass
class Stats:
    version: int | None = None
    updates: int = -1
    has_objstm: bool = False
    has_free: bool = False
    encrypted: bool = False
    user_ok: bool = False
    owner_ok: bool = False
    objects: int = -1
    filters: dict[str, int] = field(default_factory=dict)
    known: int = -1
    incomplete: bool = True
    graph_ok: bool = False
    content_ok: bool = False
    info: dict[str, bytes] = field(default_factory=dict)
    encrypt: dict[str, Any] = field(default_factory=dict)
    first_id: bytes | None = None
    error: PdfError | None = None
    stage: str = "parse"  # the last stage that began
    warnings: list[str] = field(default_factory=list)

    def clean(self) -> bool:
        return self.graph_ok and self.content_ok and not self.incomplete and self.known == self.objects

    def text(self) -> str:
        """The report, the first error in its last line."""
        out: list[str] = []
        if self.version is None:
            out.append("Not a PDF file")
        else:
            out.append("Version : unknown" if self.version < 0 else f"Version : 1.{self.version}")
            if self.updates >= 0:
                self._body(out)
        out += [f"/{k} : {pretty(v)}" for k, v in self.info.items()]
        out += [f"/Encrypt/{k} : {pretty(v)}" for k, v in self.encrypt.items()]
        if self.first_id is not None:
            out.append(f"/{'Encrypt/' if self.encrypted else ''}ID : {pretty(self.first_id)}")
        if self.clean():
            out.append("No error found")
        if self.error:
            out.append(str(self.error))
        return "\n".join(out) + "\n"

    def _body(self, out: list[str]) -> None:
        out.append(f"Incremental updates : {self.updates}")
        if self.has_objstm:
            out.append("Contains object stream(s)")
        if self.has_free:
            out.append("Contains free object(s)")
        if not (self.has_objstm or self.has_free or self.updates or self.encrypted):
            out.append("Neither updates nor object streams nor free objects nor encryption")
        if self.encrypted:
            out.append("Encrypted")
            out += [f"{who} password is {'valid' if ok else 'invalid'}" for who, ok in (("User", self.user_ok), ("Owner", self.owner_ok))]
            return
        if self.objects < 0:
            return
        out.append(f"Object count : {self.objects}")
        out += [f"Filter : {f} -> {n} times" for f, n in sorted(self.filters.items())]
        if self.known >= 0:
            out.append(f"Objects of known type : {self.known}")
            out.append(f"Known type rate : {self.known / self.objects if self.objects else float('nan'):f}")
        if self.known >= 0 and self.incomplete:
            out.append("Some types were not fully checked")
        elif self.known == self.objects:
            out.append("All types were fully checked")
        if self.graph_ok:
            out.append("Graph has no known error")
        if self.content_ok:
            out.append("Content streams have no known error")


def _text_of(doc: Document, d: Any, key: str) -> bytes | None:
    v = doc.get(d.get(key)) if isinstance(d, dict) else None
    return v if isinstance(v, bytes) else None


def filters_of(doc: Document) -> dict[str, int]:
    """Streams by filter; one without any counts as Raw."""
    out: dict[str, int] = {}
    for ref, s in sorted(doc.objects.items()):
        if isinstance(s, Stream):
            f = s.dict.get("Filter")
            names = [] if f is None else f if isinstance(f, list) else [f]
            if not all(isinstance(n, Name) for n in names):
                raise PdfError("Expected name or array of names", Place(ref, "/Filter"))
            for n in names or ["Raw"]:
                out[str(n)] = out.get(str(n), 0) + 1
    return out


CONTENT = {"content_stream": False, "xobject_form": False, "content_stream_font3": True}


def content_errors(doc: Document, types: dict[Ref, schema.Kind]) -> tuple[PdfError | None, list[str]]:
    """The first error of the page-drawing streams, each taken by itself, and all warnings."""
    warnings: list[str] = []
    for ref, kind in sorted(types.items()):
        if kind.tag == "stream" and kind.args[0] in CONTENT:
            s = doc.objects.get(ref)
            if not isinstance(s, Stream):
                return PdfError('Expected a stream for object of type "content_stream"', Place(ref)), warnings
            try:
                data = s.data if s.data is not None else decode_stream(s, Place(ref), doc.options)
                ops = pagelang.parse(data, doc.options)
                warnings += [w + str(Place(ref)) for w in pagelang.check(ops, ref, CONTENT[kind.args[0]])]
            except PdfError as e:
                e.place = Place(ref, offset=e.place.offset, inside=ref if e.place.offset is not None else None)
                return e, warnings
    return None, warnings


def stats(doc: Document, types: schema.Registry | None = None) -> Stats:
    """Each stage runs only if all before it found no error; worked out once a document."""
    reg = types or schema.registry()
    if doc.kept.get("stats_registry") is not reg:
        doc.kept |= {"stats_registry": reg, "stats": _stats(doc, reg)}
    return doc.kept["stats"]


def _stats(doc: Document, types: schema.Registry) -> Stats:
    s = Stats(doc.version, doc.updates, doc.has_objstm, doc.has_free, warnings=doc.options.warnings)
    trailer = doc.trailer
    if doc.handler:
        s.encrypted, s.user_ok, s.owner_ok = True, doc.handler.user_ok, doc.handler.owner_ok
    if doc.errors:
        s.error = doc.errors[0]
        return s
    info = doc.get(trailer.get("Info"))
    for key in ("Producer", "Creator", "CreationDate", "ModDate"):
        if (v := _text_of(doc, info, key)) is not None:
            s.info[key] = v
    enc = doc.get(trailer.get("Encrypt"))
    if isinstance(enc, dict):
        s.encrypted = True
        s.encrypt = {k: enc[k] for k in ("V", "R", "U", "O") if k in enc}
    ids = doc.get(trailer.get("ID"))
    if isinstance(ids, list) and len(ids) == 2 and all(isinstance(i, bytes) for i in ids):
        s.first_id = ids[0]
    s.objects, s.stage = len(doc.objects), "filters"
    try:
        s.filters = filters_of(doc)
    except PdfError as e:
        s.error = e
        return s
    s.stage = "types"
    known, incomplete, error = schema.check(doc, types)
    if error:
        s.error = error
        return s
    s.known, s.incomplete, s.stage = len(known), incomplete, "graph"
    if error := trees.check(doc):
        s.error = error
        return s
    s.graph_ok, s.stage = True, "content"
    error, warnings = content_errors(doc, known)
    s.warnings += warnings
    if error:
        s.error = error
        return s
    s.content_ok, s.stage = True, "done"
    return s


def xref_text(doc: Document) -> str:
    """A line per entry, shadowed ones starred, then four totals."""
    lines, n, free, comp, shadowed = [], 0, 0, 0, 0
    for ref, entries in sorted(doc.xref.items()):
        for i, e in enumerate(entries):
            where = f"[not used, next is {e.off}]" if e.kind == FREE else f"in ({e.off}, 0) [at {e.idx}]" if e.kind == COMPRESSED else f"at {e.off} [0x{e.off:x}]"
            lines.append(f"{'*' if i else ''}({ref.num}, {ref.gen}) {where}")
            n, free, comp, shadowed = n + 1, free + (e.kind == FREE), comp + (e.kind == COMPRESSED), shadowed + (i > 0)
    return "\n".join([*lines, "", f"{n} object(s) in total", f"{free} free object(s)", f"{comp} compressed object(s)", f"{shadowed} shadowed object(s)"]) + "\n"


def dump_text(doc: Document) -> str:
    """Trailers, then objects."""
    out = [f"trailer\n{pretty(t)}\n\n" for t in doc.trailers]
    out += [f"obj({r.num}, {r.gen})\n{pretty(x)}\n\n" for r, x in sorted(doc.objects.items())]
    return "".join(out)


def is_blank(data: bytes) -> bool:
    """Only blanks and comments."""
    for line in data.replace(b"\r", b"\n").split(b"\n"):
        line = line.strip(b"\0\t\x0c ")
        if line and not line.startswith(b"%"):
            return False
    return True


def layout_text(doc: Document, holes_only: bool = False) -> str:
    """Extents of the objects with the bytes between them that are no blanks."""
    out, last = [], 0
    for low, high, key in [*sorted(doc.extents, key=lambda e: e[0]), (len(doc.data), None, None)]:
        hole = doc.data[last:low]
        if hole and not is_blank(hole):
            out.append(f"*Hole of {len(hole)} (0x{len(hole):x}) bytes at {last} [0x{last:x}] :")
            if holes_only:
                out.append(hole.decode("latin-1"))
        if high is not None:
            if not holes_only:
                out.append(f"[0x{low:x} -> 0x{high:x} = 0x{high - low + 1:x} bytes] = {key_text(key)}")
            last = high + 1
    return "".join(x + "\n" for x in out)


def edges(doc: Document) -> list[tuple[Key, Ref, str]]:
    """(object, target, first path in it) of each distinct reference, the main trailer last."""
    out = []
    for key, x in doc.all():
        seen: set[Ref] = set()
        for path, v in walk(x):
            if isinstance(v, Ref) and v not in seen:
                seen.add(v)
                out.append((key, v, path))
    return out


def find(doc: Document, target: Ref | str) -> list[tuple[Key, str]]:
    """(object, path) of every reference to a key, or of every use of a name as value (/n) or key (\\n)."""
    out = []
    for key, x in doc.all():
        for path, v in walk(x):
            if isinstance(target, Ref):
                if v == target and isinstance(v, Ref):
                    out.append((key, path))
                continue
            if isinstance(v, Name) and v == target:
                out.append((key, path))
            d = v.dict if isinstance(v, Stream) else v
            if isinstance(d, dict) and target in d:
                out.append((key, f"{path}\\{target}"))
    return out


# The colours of vertices by type; a trailing * stands for any ending.
COLORS = """
c"resources" green
s"content_stream" blue
c"destination" orange
c"page* red
c"annot_* yellow
c"outline* turquoise
c"nametree* brown
c"action_* magenta
c"font_* purple
s"font_* purple
"""
_COLORS = [line.rsplit(" ", 1) for line in COLORS.strip().splitlines()]


def _color(kind: schema.Kind | None) -> str:
    text = kind.text() if kind else ""
    return next((c for p, c in _COLORS if text == p or (p.endswith("*") and text.startswith(p[:-1]))), "")


def _drawn(doc: Document) -> tuple[list[Key], list[tuple[Key, Key]]]:
    """Vertices and distinct edges in the order in which they are drawn: the trailer first, targets from the last to the first."""
    order = lambda key: (isinstance(key, tuple), key)
    links = {(a, b) for a, b, _ in edges(doc)}
    return sorted((k for k, _ in doc.all()), key=order), sorted(links, key=lambda e: (order(e[0]), -e[1].num, -e[1].gen))


def dot_text(doc: Document, types: dict[Ref, schema.Kind] | None = None) -> str:
    """The reference graph in DOT; with types, vertices are coloured by theirs."""
    vertices, links = _drawn(doc)
    out = ["digraph objects {"]
    for key in vertices:
        color = _color((types or {}).get(key))
        out.append(f'    R_{key_id(key)} [label="{key_text(key)}"' + (f', color="{color}"' if color else "") + "];")
    out += [f"    R_{key_id(a)} -> R_{key_id(b)};" for a, b in links]
    return "\n".join([*out, "}"]) + "\n"


# Fixed value: what follows the data in a file for a vis.js network.
NETWORK = """var container = document.getElementById('graph');
var data = {nodes: nodes, edges: edges};
var options = {edges: {style: 'arrow'}};
var graph = new vis.Network(container, data, options);
"""


def visjs_text(doc: Document) -> str:
    """The reference graph as the data of a vis.js network; a key's number is the order in which it is first met."""
    vertices, links = _drawn(doc)
    seen: dict[str, int] = {}
    number = lambda key: seen.setdefault(key_text(key), len(seen))
    out = ["var nodes = [", *(f"    {{id: {number(k)}, label: '{key_text(k)}'}}," for k in vertices), "];", ""]
    out += ["var edges = [", *(f"    {{from: {number(a)}, to: {number(b)}}}," for a, b in links), "];", ""]
    return "\n".join(out) + "\n" + NETWORK


# --- normal form ---------------------------------------------------------------


def closure(doc: Document, start: Any) -> set[Ref]:
    """Objects reachable from a value; PdfError at a reference to none."""
    seen: set[Ref] = set()
    stack = [(TRAILER, start)]
    while stack:
        key, x = stack.pop()
        for path, v in walk(x):
            if isinstance(v, Ref) and v not in seen:
                if v not in doc.objects:
                    raise PdfError(f"Reference to unknown object : {key_text(v)}", Place(key, path))
                seen.add(v)
                stack.append((v, doc.objects[v]))
    return seen


def merge_contents(doc: Document, glue_first: bool = False) -> None:
    """Each page's content streams as one Flate stream with a fresh number; failures are warnings.

    A line end separates all parts; with ``glue_first`` the first two are
    joined without one.
    """
    fresh = max((r.num for r in doc.objects), default=0)
    for page in trees.pages(doc):
        try:
            c = doc.objects[page].get("Contents")
            c = doc.get(c) if isinstance(doc.get(c), list) else c
            if c is None:
                continue
            parts = []
            for ref in c if isinstance(c, list) else [c]:
                s = doc.get(ref)
                if not isinstance(ref, Ref):
                    raise PdfError("Expected reference or array of references", Place(page, "/Contents"))
                if not isinstance(s, Stream):
                    raise PdfError("Content stream shall be a stream", Place(ref))
                parts.append(s.data if s.data is not None else decode_stream(s, Place(ref), doc.options))
            data = (b"".join(parts[:2]) if glue_first else b"\n".join(parts[:2])) + b"".join(b"\n" + p for p in parts[2:])
            fresh += 1
            raw = codecs.encode(data, "FlateDecode")
            doc.objects[Ref(fresh, 0)] = Stream({"Length": len(raw), "Filter": Name("FlateDecode")}, raw, data)
            doc.objects[page]["Contents"] = Ref(fresh, 0)
        except PdfError:
            doc.options.warnings.append("Could not cleanup content stream(s) for page" + str(Place(page)))


def reencode(s: Stream, name: str, place: Place, doc: Document) -> Stream:
    data = s.data if s.data is not None else decode_stream(s, place, doc.options)
    raw = codecs.encode(data, name)
    d = {k: v for k, v in s.dict.items() if k not in ("Filter", "DecodeParms")} | {"Length": len(raw)}
    return Stream(d | ({"Filter": Name(name)} if name else {}), raw, data)


def clean(doc: Document) -> bytes:
    """The file in its normal form: small values in place, unreachable objects gone, numbers dense."""
    o = doc.options
    if o.merge_content_streams:
        try:
            merge_contents(doc)
        except PdfError:
            o.warnings.append("Could not merge content stream arrays in all pages")
    if o.reencode_streams is not None or o.decode_streams:
        for ref, s in sorted(doc.objects.items()):
            if isinstance(s, Stream):
                try:
                    doc.objects[ref] = reencode(s, o.reencode_streams or "", Place(ref), doc)
                except (PdfError, codecs.CodecError):
                    if not o.relax_streams:
                        raise

    def inline(x: Any) -> Any:
        if not isinstance(x, Ref):
            return x
        if x not in doc.objects:
            raise PdfError(f"Reference to unknown object : {key_text(x)}", Place(x))
        target = doc.objects[x]
        return x if isinstance(target, (list, dict, Stream)) else target

    def simple(x: Any) -> Any:
        if o.remove_ptex:
            x = _without_ptex(x)
        return edit(x, inline)

    trailer = {k: v for k, v in doc.trailer.items() if k in TRAILER_KEYS}
    if o.simplify_info and isinstance(trailer.get("Info"), Ref) and isinstance(doc.objects.get(trailer["Info"]), dict):
        doc.objects[trailer["Info"]] = {k: v for k, v in doc.objects[trailer["Info"]].items() if k in INFO_KEYS}
    objects = {k: simple(v) for k, v in doc.objects.items()}
    trailer = simple(trailer)
    doc.objects = objects
    kept = sorted(closure(doc, trailer))
    to = {old: Ref(i, 0) for i, old in enumerate(kept, 1)}
    move = lambda x: to.get(x, x) if isinstance(x, Ref) else x
    return writer.write({to[k]: edit(objects[k], move) for k in kept}, edit(trailer, move) | {"Size": len(kept) + 1})


def _without_ptex(x: Any) -> Any:
    if isinstance(x, Stream):
        return Stream(_without_ptex(x.dict), x.raw, x.data, x.error)
    if isinstance(x, dict):
        return {k: _without_ptex(v) for k, v in x.items() if not k.startswith("PTEX.")}
    return [_without_ptex(v) for v in x] if isinstance(x, list) else x
