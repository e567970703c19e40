"""The type registry and the check of objects against it.

Types are read from a declarative text (``schema.txt``, or one given), so a
collection can be checked against other rules by giving other text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path
from typing import Any

from quire.kernels.document import Document, overlap
from quire.kernels.model import TRAILER, Key, Name, PdfError, Place, Real, Ref, Stream, TypeMismatch, key_text

DEFAULT = Path(__file__).with_name("schema.txt")
_LEX = re.compile(r"\s*(\{\{|/\{|=\{|\}\[\]|[()\[\]{}<>|*?]|=-?\d+|-?\d*\.\.-?\d*|[acs]:[\w-]+|/[\w-]+|-?\d+|\w+(?:-\w+)*)")


@dataclass(frozen=True)
class Kind:
    """A type: ``tag`` with its arguments; ``direct`` forbids a reference."""

    tag: str
    args: tuple = ()
    direct: bool = False

    def plain(self) -> Kind:
        return Kind(self.tag, self.args)

    def __str__(self) -> str:
        return self.text() + ("*" if self.direct else "")

    def text(self) -> str:
        """The notation used in reports and messages, without the mark of direct types."""
        t, a = self.tag, self.args
        if t in ("alias", "class", "stream"):
            return f'{t[0]}"{a[0]}"'
        if t == "range":
            low, high = a
            return "(int" + (f" >= {low}" if low is not None else "") + (f" <= {high}" if high is not None else "") + ")"
        if t == "int_in":
            return "(int = " + " | ".join(map(str, a)) + ")"
        if t == "int_is":
            return f"(int = {a[0]})"
        if t == "name_is":
            return f"(/{a[0]})"
        if t == "name_in":
            return "(" + ", ".join(f"/{x}" for x in sorted(a)) + ")"
        if t == "array":
            return f"{a[0]}[]"
        if t == "array_or_one":
            return f"{a[0]}[?]"
        if t == "sized":
            return f"{a[0]}[{', '.join(map(str, a[1]))}]"
        if t == "tuples":
            return "{" + ", ".join(map(str, a)) + "}[]"
        if t == "tuple":
            return "{{" + ", ".join(map(str, a)) + "}}"
        if t == "variant":
            return "(" + " | ".join(x.text() for x in a) + ")"
        if t == "dict":
            return f"{a[0]}{{}}"
        return t


@dataclass
class Class:
    lenient: bool = False
    includes: list[str] = field(default_factory=list)
    entries: dict[str, tuple[Kind, bool]] = field(default_factory=dict)  # key to (type, optional)


class _Types:
    """Recursive descent over the type notation."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"type notation: {text[at:]}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def until(self, end: str) -> list[str]:
        out = []
        while (t := self.next()) != end:
            out.append(t)
        return out

    def many(self, end: str) -> tuple[Kind, ...]:
        out = []
        while self.peek() != end:
            out.append(self.kind())
            if self.peek() == "|":
                self.next()
        self.next()
        return tuple(out)

    def kind(self) -> Kind:
        out = self.bare()
        if self.peek() == "*":
            self.next()
            out = Kind(out.tag, out.args, True)
        return out

    def bare(self) -> Kind:
        t = self.next()
        if t == "(":
            return Kind("variant", self.many(")"))
        if t == "{{":
            of = self.many("}")
            self.until("}")
            return Kind("tuple", of)
        if t == "{":
            return Kind("tuples", self.many("}[]"))
        if t == "<":
            return Kind("dict", self.many(">"))
        if t == "[":
            of = self.many("]")[0]
            if self.peek() == "?":
                self.next()
                return Kind("array_or_one", (of,))
            if self.peek() == "{":
                self.next()
                return Kind("sized", (of, tuple(map(int, self.until("}")))))
            if self.peek().isdigit():
                return Kind("sized", (of, (int(self.next()),)))
            return Kind("array", (of,))
        if t == "/{":
            return Kind("name_in", tuple(self.until("}")))
        if t == "={":
            return Kind("int_in", tuple(map(int, self.until("}"))))
        if t.startswith("/"):
            return Kind("name_is", (t[1:],))
        if t.startswith("="):
            return Kind("int_is", (int(t[1:]),))
        if ".." in t:
            low, _, high = t.partition("..")
            return Kind("range", (int(low) if low else None, int(high) if high else None))
        if t[1:2] == ":":
            return Kind({"a": "alias", "c": "class", "s": "stream"}[t[0]], (t[2:],))
        return Kind(t)


@dataclass
class Registry:
    classes: dict[str, Class] = field(default_factory=dict)
    aliases: dict[str, Kind] = field(default_factory=dict)

    @classmethod
    def read(cls, text: str) -> Registry:
        out, trees = cls(), {}
        lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
        for line in lines:  # trees may be named before they are declared
            if line.startswith("tree "):
                _, name, how, _ = line.split(" ", 3)
                stem = "nametree" if how == "names" else "numtree"
                roots = ("rootnode", "rootleaf", "node", "leaf") if how == "names" else ("rootnode", "rootleaf")
                trees[f"a:{stem}_{name}"] = "(" + " | ".join(f"c:{stem}{r}_{name}" for r in roots) + ")"
        current = None
        for line in lines:
            for short, full in trees.items():
                line = line.replace(short, full)
            if line.startswith("  "):
                key, kind = line.split(None, 1)
                current.entries[key[:-1]] = (_Types(kind).kind(), key[-1] == "?")
                continue
            word, rest = line.split(" ", 1)
            if word == "alias":
                name, kind = rest.split(" = ", 1)
                out.aliases[name] = _Types(kind).kind()
            elif word == "class":
                head, _, includes = rest.partition(" : ")
                name, *flags = head.split()
                current = out.classes[name] = Class("lenient" in flags, includes.split())
            elif word == "tree":
                name, how, kind = rest.split(" ", 2)
                stem, key, of = ("nametree", "Names", "string") if how == "names" else ("numtree", "Nums", "int")
                node = f"(c:{stem}node_{name} | c:{stem}leaf_{name})"
                for part, include, entry, t in (
                    ("rootnode", None, "Kids", f"[{node}]"), ("rootleaf", None, key, f"{{{of}* {kind}}}[]"),
                    ("node", "rootnode", "Limits", f"[{of}]2"), ("leaf", "rootleaf", "Limits", f"[{of}]2"),
                ):
                    out.classes[f"{stem}{part}_{name}"] = Class(False, [f"{stem}{include}_{name}"] if include else [], {entry: (_Types(t).kind(), False)})
        out.verify()
        return out

    def verify(self) -> None:
        """Every class and alias that is mentioned must be declared."""

        def visit(k: Kind, where: str) -> None:
            if k.tag == "alias" and k.args[0] not in self.aliases:
                raise ValueError(f'Undeclared alias type "{k.args[0]}", used in "{where}"')
            if k.tag in ("class", "stream") and k.args[0] not in self.classes:
                raise ValueError(f'Undeclared class type "{k.args[0]}", used in "{where}"')
            for x in k.args:
                if isinstance(x, Kind):
                    visit(x, where)

        for name, c in self.classes.items():
            for i in c.includes:
                if i not in self.classes:
                    raise ValueError(f'Undeclared class type "{i}", included by class "{name}"')
            for key, (kind, _) in c.entries.items():
                visit(kind, f"class {name}/{key}")
        for name, kind in self.aliases.items():
            visit(kind, f"alias {name}")

    def dump(self) -> str:
        """All classes, then all aliases, sorted."""
        out = []
        for name, c in sorted(self.classes.items()):
            out.append(f"class {name}")
            out += [f"\t#include : {i}" for i in sorted(c.includes)]
            out += [f"\t/{k} : {kind}{' [optional]' if optional else ''}" for k, (kind, optional) in sorted(c.entries.items())]
        for name, kind in sorted(self.aliases.items()):
            out += [f"alias {name} :", f"\t{kind.text()}"]
        return "\n".join(out) + "\n"

    # --- kinds ---

    def bare(self, k: Kind) -> Kind:
        while k.tag == "alias":
            k = self.aliases[k.args[0]]
        return k.plain()

    def options(self, k: Kind) -> list[Kind]:
        """The alternatives of a kind with all aliases and nested variants undone, sorted."""
        k = self.bare(k)
        if k.tag != "variant":
            return [k]
        return sorted({o for x in k.args for o in self.options(x)}, key=lambda o: (o.tag, o.text()))

    def intersect(self, a: Kind, b: Kind, place: Place) -> Kind:
        both = [m for x in self.options(a) for y in self.options(b) if (m := _meet(x, y))]
        if not both:
            raise TypeMismatch(f"Inconsistent type inference between {a.text()} and {b.text()}", place)
        return both[0] if len(both) == 1 else Kind("variant", tuple(both))


def _meet(a: Kind, b: Kind) -> Kind | None:
    if a.tag == "any":
        return b
    if b.tag == "any":
        return a
    if a.tag == "array_or_one":
        if b.tag in ("array", "array_or_one") and a.args == b.args:
            return b
        return _meet(a.args[0].plain(), b)
    if b.tag == "array_or_one":
        return _meet(b, a)
    return a if a == b else None


@cache
def registry(text: str | None = None) -> Registry:
    return Registry.read(DEFAULT.read_text() if text is None else text)


_SIMPLE = {
    "bool": lambda x: isinstance(x, bool), "int": lambda x: type(x) is int, "real": lambda x: isinstance(x, Real),
    "string": lambda x: isinstance(x, bytes), "name": lambda x: isinstance(x, Name), "text": lambda x: isinstance(x, bytes),
    "date": lambda x: isinstance(x, bytes), "null": lambda x: x is None,
}


class Checker:
    """Types spread from the trailer along references; the object seen last is checked first."""

    def __init__(self, doc: Document, types: Registry):
        self.doc, self.reg = doc, types
        self.types: dict[Ref, Kind] = {}
        self.queue: list[tuple[Ref, Place]] = []
        self.incomplete = False

    def run(self) -> None:
        self.check(self.doc.trailer, Kind("alias", ("trailer",), True), Place(TRAILER))
        for ref, what in sorted(self.doc.special.items()):
            self.types[ref] = Kind("alias", ("stream_objstm" if what == "objstm" else "stream_xrefstm",))
            self.queue.append((ref, Place()))
        while self.queue:
            ref, place = self.queue.pop()
            if ref not in self.doc.objects:
                raise PdfError(f"Reference to unknown object during type checking : {key_text(ref)}", place)
            k = self.types[ref]
            self.types[ref] = self.check(self.doc.objects[ref], Kind(k.tag, k.args, True), Place(ref)).plain()

    def check(self, x: Any, k: Kind, place: Place) -> Kind:
        while k.tag == "alias":
            to = self.reg.aliases[k.args[0]]
            k = Kind(to.tag, to.args, k.direct)
        t, a = k.tag, k.args
        if isinstance(x, Ref) and not k.direct:
            return self.reference(x, k, place)
        if t in _SIMPLE:
            if _SIMPLE[t](x):
                return k
        elif t in ("true", "false"):
            if isinstance(x, bool):
                self.want(x == (t == "true"), f"Boolean value {str(x).lower()} is not the expected one ({t})", place)
                return k
        elif t == "range":
            if type(x) is int:
                low, high = a
                self.want(low is None or x >= low, f"Integer value {x} is below the minimum ({low})", place)
                self.want(high is None or x <= high, f"Integer value {x} is above the maximum ({high})", place)
                return k
        elif t in ("int_is", "int_in"):
            if type(x) is int:
                what = f"is not the expected one ({a[0]})" if t == "int_is" else f"is not among the expected ones ({', '.join(map(str, a))})"
                self.want(x in a, f"Integer value {x} {what}", place)
                return k
        elif t in ("name_is", "name_in"):
            if isinstance(x, Name):
                what = f"is not the expected one (/{a[0]})" if t == "name_is" else f"is not among the expected ones ({', '.join('/' + n for n in sorted(a))})"
                self.want(x in a, f"Name value /{x} {what}", place)
                return k
        elif t == "array_or_one":
            if isinstance(x, list):
                self.each(x, a, place)
                return Kind("array", a, k.direct)
            return self.check(x, a[0], place)
        elif t == "variant":
            return self.variant(x, k, place)
        elif t == "any":
            self.incomplete = True
            return k
        elif t == "class" and isinstance(x, dict):
            self.members(x, a[0], place)
            return k
        elif t == "stream" and isinstance(x, Stream):
            self.members(x.dict, a[0], place)
            return k
        elif t == "dict" and isinstance(x, dict):
            for key, v in sorted(x.items()):
                self.check(v, a[0], place.at(f"/{key}"))
            return k
        elif isinstance(x, list) and t in ("array", "sized", "tuples", "tuple", "differences"):
            n = len(x)
            if t == "sized":
                of, sizes = a
                message = f"is not the expected one ({sizes[0]})" if len(sizes) == 1 else f"is not among the expected ones ({', '.join(map(str, sizes))})"
                self.want(n in sizes, f"Array size ({n}) {message}", place)
                self.each(x, (of,), place)
            elif t == "tuples":
                self.want(n % len(a) == 0, f"Array size ({n}) is not among the expected ones (multiples of {len(a)}) for this array of tuples", place)
                self.each(x, a, place)
            elif t == "tuple":
                self.want(n == len(a), f"Array size ({n}) is not the expected one ({len(a)}) for this tuple", place)
                self.each(x, a, place)
            elif t == "differences":
                self.differences(x, place)
            else:
                self.each(x, a, place)
            return k
        raise TypeMismatch(f"Invalid type : expected {k.text()}", place)

    def want(self, ok: bool, message: str, place: Place) -> None:
        if not ok:
            raise TypeMismatch(message, place)

    def each(self, x: list[Any], kinds: tuple[Kind, ...], place: Place) -> None:
        for i, v in enumerate(x):
            self.check(v, kinds[i % len(kinds)], place.at(f"[{i}]"))

    def differences(self, x: list[Any], place: Place) -> None:
        spans: list[list[int]] = []
        for v in x:
            if type(v) is int:
                spans.append([v, v - 1])
            elif not isinstance(v, Name):
                raise TypeMismatch("Invalid differences", place)
            elif not spans:
                raise TypeMismatch("No code for differences", place)
            else:
                spans[-1][1] += 1
        if overlap([(low, high, None) for low, high in spans]):
            raise TypeMismatch("Overlapping differences", place)

    def reference(self, ref: Ref, k: Kind, place: Place) -> Kind:
        if ref not in self.types:
            self.types[ref] = k.plain()
            self.queue.append((ref, place))
            return k
        self.types[ref] = self.reg.intersect(k.plain(), self.types[ref], Place(ref))
        return self.types[ref]

    def variant(self, x: Any, k: Kind, place: Place) -> Kind:
        """The first alternative that holds; what a failed one noted is forgotten."""
        for option in k.args:
            before = dict(self.types), list(self.queue), self.incomplete
            try:
                return self.check(x, option.plain(), place)
            except PdfError:
                self.types, self.queue, self.incomplete = before
        raise TypeMismatch(f"Invalid variant type : expected {k.text()}", place)

    def members(self, d: dict[str, Any], name: str, place: Place) -> None:
        left = set(d)
        self.inherit(d, name, place, left)
        if not (name == "info" and self.doc.options.allow_arbitrary_info) and left:
            self.incomplete = True
        if not self.reg.classes[name].lenient:
            for key in sorted(left):
                raise TypeMismatch(f"Unexpected entry /{key} in instance of class {name}", place)

    def inherit(self, d: dict[str, Any], name: str, place: Place, left: set[str]) -> None:
        c = self.reg.classes[name]
        for key, (kind, optional) in c.entries.items():
            if key in d:
                self.check(d[key], kind, place.at(f"/{key}"))
                left.discard(key)
            elif not optional:
                raise TypeMismatch(f"Mandatory entry /{key} was not found in instance of class {name}", place)
        for i in c.includes:
            self.inherit(d, i, place, left)


def check(doc: Document, types: Registry | None = None) -> tuple[dict[Ref, Kind], bool, PdfError | None]:
    """(type of each object reached, whether something wasn't fully checked, first error); worked out once a document."""
    reg = types or registry()
    if doc.kept.get("registry") is not reg:
        doc.kept |= {"registry": reg, "types": _check(doc, reg)}
    return doc.kept["types"]


def checked(doc: Document, types: Registry | None = None) -> dict[Ref, Kind]:
    """The type of each object reached; PdfError if one doesn't fit."""
    found, _, error = check(doc, types)
    if error:
        raise error
    return found


def _check(doc: Document, reg: Registry) -> tuple[dict[Ref, Kind], bool, PdfError | None]:
    c = Checker(doc, reg)
    try:
        c.run()
    except PdfError as e:
        return c.types, c.incomplete, e
    except RecursionError:
        return c.types, c.incomplete, TypeMismatch("Invalid type : nested too deeply")
    return c.types, c.incomplete, None


def dump(types: dict[Key, Kind], n_objects: int) -> str:
    """A line per object, the total, and the histogram by falling count and rising name."""
    texts = {k: v.text() for k, v in types.items()}
    counts: dict[str, int] = {}
    for t in texts.values():
        counts[t] = counts.get(t, 0) + 1
    lines = [f"{key_text(k)} : {t}" for k, t in sorted(texts.items())]
    lines += ["", f"# of objects of known type : {len(texts)} / {n_objects}", ""]
    lines += [f"{t} : {n}" for t, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    return "\n".join(lines) + "\n"
