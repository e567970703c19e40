"""Objects of a file as Python values, their text forms and located errors.

null is None, numbers are int and Real, strings bytes, names Name, references
Ref, arrays list, dictionaries dict (never holding None), streams Stream.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any, NamedTuple

MAX_INT, MIN_INT = 2**31 - 1, -(2**31)


class Name(str):
    __slots__ = ()


class Real(str):
    """A real number, kept as its source text."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


@dataclass
class Stream:
    dict: dict[str, Any]
    raw: bytes
    data: bytes | None = None  # decoded
    error: str | None = None


TRAILER = "trailer"
Key = Any  # Ref, "trailer" or "version"


def key_text(key: Key) -> str:
    """``5``, or ``5 [2]`` with a generation."""
    if isinstance(key, tuple):
        return f"{key[0]} [{key[1]}]" if key[1] else str(key[0])
    return str(key)


def key_id(key: Key) -> str:
    if isinstance(key, tuple):
        return f"{key[0]}_{key[1]}" if key[1] else str(key[0])
    return str(key)


@dataclass
class Place:
    """Where something is: the object, the path in it, and the byte."""

    key: Key | None = None
    path: str = ""
    offset: int | None = None
    inside: Key | None = None  # the stream that ``offset`` counts in, else the file
    index: int | None = None  # place in the object stream ``inside``

    def at(self, step: str) -> Place:
        return Place(self.key, self.path + step, self.offset, self.inside, self.index)

    def __str__(self) -> str:
        out = f" in object {key_text(self.key)}" if self.key is not None else ""
        if self.path:
            out += f" at entry {self.path}"
        if self.index is not None:
            out += f" at index {self.index} in object stream {key_text(self.inside)}"
        elif self.offset is not None:
            out += f" at offset {self.offset} [0x{self.offset:x}]"
            out += f" in stream {key_text(self.inside)}" if self.inside is not None else " in file"
        return out


class PdfError(Exception):
    kind = "PDF error"

    def __init__(self, message: str, place: Place | None = None):
        super().__init__(message)
        self.message = message
        self.place = place or Place()

    def __str__(self) -> str:
        return f"{self.kind} : {self.message}{self.place} !"


class TypeMismatch(PdfError):
    kind = "Type error"


@dataclass
class Options:
    """Run parameters; the names are those of the option file, with underscores."""

    strict: bool = False
    decode_streams: bool = False
    relax_streams: bool = False
    ignore_crypt: bool = False
    no_decrypt: bool = False
    user_password: bytes = b""
    owner_password: bytes = b""
    allow_invalid_version: bool = False
    allow_dict_duplicates: bool = False
    zero_offset_as_free: bool = False
    undefined_ref_as_null: bool = False
    allow_nonascii_in_names: bool = False
    allow_overlaps: bool = False
    xref_stream_default_zero: bool = False
    allow_arbitrary_info: bool = False
    simplify_info: bool = False
    remove_ptex: bool = False
    merge_content_streams: bool = False
    reencode_streams: str | None = None
    expand_streams: bool = False
    stream_limit: int | None = None
    warnings: list[str] = field(default_factory=list, repr=False)

    @classmethod
    def read(cls, text: str) -> Options:
        """From the lines of an option file: ``flag`` or ``key=value``; blank lines are skipped."""
        out = cls()
        flags = {
            "strict", "ignore-crypt", "no-decrypt", "allow-invalid-version", "allow-dict-duplicates", "zero-offset-as-free",
            "undefined-ref-as-null", "allow-nonascii-in-names", "allow-overlaps", "xref-stream-default-zero", "allow-arbitrary-info",
        }
        for line in text.splitlines():
            name, eq, value = line.partition("=")
            if eq and name in ("user-password", "owner-password"):
                setattr(out, name.replace("-", "_"), value.encode("latin-1", "replace"))
            elif eq and name == "reencode-streams":
                out.reencode_streams = value
            elif not eq and name in flags:
                setattr(out, name.replace("-", "_"), True)
            elif line:
                raise ValueError(f"unknown option: {line}")
        return out


# --- text forms ----------------------------------------------------------------

_ESCAPES = {10: "\\n", 13: "\\r", 9: "\\t", 8: "\\b", 12: "\\f", 40: "\\(", 41: "\\)", 92: "\\\\"}


_ESCAPED = re.compile("[\n\r\t\b\f()\\\\]")


def escape_name(name: str) -> str:
    """A name as written: delimiters, ``#`` and anything but visible ASCII as ``#XX``."""
    return "".join(c if "!" <= c <= "~" and c not in "()<>[]{}/%#" else f"#{ord(c) & 255:02X}" for c in name)


def escape_string(raw: bytes) -> str:
    return _ESCAPED.sub(lambda m: _ESCAPES[ord(m[0])], raw.decode("latin-1"))


def pretty(x: Any, tab: str = "") -> str:
    """Indented text: a key a line, sorted; strings readable, or in hex if they hold other bytes."""
    if x is None:
        return "null"
    if x is True or x is False:
        return "true" if x else "false"
    if isinstance(x, Ref):
        return f"{x.num} {x.gen} R"
    if isinstance(x, Name):
        return "/" + escape_name(x)
    if isinstance(x, bytes):
        if all(b in _ESCAPES or 32 <= b < 127 for b in x):
            return f"({escape_string(x)})"
        return f"<{x.hex().upper()}>"
    if isinstance(x, list):
        return "[" + " ".join(pretty(v, tab) for v in x) + "]"
    if isinstance(x, dict):
        deeper = tab + "    "
        return "<<" + "".join(f"\n{deeper}/{escape_name(k)} {pretty(v, deeper)}" for k, v in sorted(x.items())) + f"\n{tab}>>"
    if isinstance(x, Stream):
        return pretty(x.dict, tab) + "\n" + stream_text(x)
    return str(x)


# How a terminal is told to show what follows inverted, and to stop.
INVERTED, PLAIN = "\x1b[0;7m", "\x1b[0m"


def marked(x: Any, paths: set[str], tab: str = "", path: str = "") -> str:
    """``pretty`` with the values at some paths inverted, and the keys at those with ``\\`` before the last name."""
    deeper = tab + "    "
    if isinstance(x, Stream):
        return marked(x.dict, paths, tab, path) + "\n" + stream_text(x)
    if isinstance(x, list):
        out = "[" + " ".join(marked(v, paths, tab, f"{path}[{i}]") for i, v in enumerate(x)) + "]"
    elif isinstance(x, dict):
        out = "<<"
        for k, v in sorted(x.items()):
            key = "/" + escape_name(k)
            out += f"\n{deeper}{INVERTED + key + PLAIN if f'{path}{chr(92)}{k}' in paths else key} {marked(v, paths, deeper, f'{path}/{k}')}"
        out += f"\n{tab}>>"
    else:
        out = pretty(x, tab)
    return INVERTED + out + PLAIN if path in paths and path else out


def stream_text(s: Stream, options: Options | None = None) -> str:
    data, state = (s.raw, "encoded") if s.data is None else (s.data, "decoded")
    if options and options.expand_streams and (options.stream_limit is None or len(data) <= options.stream_limit):
        return f"stream <{state} stream of length {len(data)}>\n{data.decode('latin-1')}\nendstream"
    return f"stream <{state} stream of length {len(data)}>"


def _wordy(x: Any, after: bool = False) -> bool:
    """Whether ``x`` begins (ends) with a regular character and needs a blank there."""
    if isinstance(x, Name):
        return after
    return not isinstance(x, (bytes, list, dict, Stream))


def compact(x: Any) -> str:
    """The shortest text; as latin-1 these are the bytes to write."""
    if isinstance(x, bytes):
        return f"({escape_string(x)})"
    if isinstance(x, list):
        out, last = [], None
        for i, v in enumerate(x):
            if i and _wordy(last, True) and _wordy(v):
                out.append(" ")
            out.append(compact(v))
            last = v
        return "[" + "".join(out) + "]"
    if isinstance(x, dict):
        return "<<" + "".join(f"/{escape_name(k)}{' ' if _wordy(v) else ''}{compact(v)}" for k, v in sorted(x.items())) + ">>"
    if isinstance(x, Stream):
        return compact(x.dict) + "stream\n" + x.raw.decode("latin-1") + "\nendstream"
    return pretty(x)


def walk(x: Any, path: str = ""):
    """(path, value) of every value below and at ``x``, keys sorted, in pre-order; of a stream its dictionary."""
    stack = [(path, x)]
    while stack:
        path, x = stack.pop()
        yield path, x
        if isinstance(x, Stream):
            x = x.dict
        if isinstance(x, dict):
            stack += [(f"{path}/{k}", v) for k, v in sorted(x.items(), reverse=True)]
        elif isinstance(x, list):
            stack += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(x)))]


def edit(x: Any, change) -> Any:
    """A copy of ``x`` with each leaf replaced by ``change(leaf)``; entries that become null vanish."""
    if isinstance(x, Stream):
        return Stream(edit(x.dict, change), x.raw, x.data, x.error)
    if isinstance(x, dict):
        return {k: w for k, v in x.items() if (w := edit(v, change)) is not None}
    if isinstance(x, list):
        return [edit(v, change) for v in x]
    return change(x)
