"""The scanner for objects in bytes, lenient and strict.

One compiled expression finds the next token; containers are kept on an
explicit stack, so nesting is bounded by memory only.  Errors carry the byte at
which they were found.
"""

from __future__ import annotations

import re
from typing import Any

from quire.kernels.model import MAX_INT, MIN_INT, Name, Options, PdfError, Place, Real, Ref

_BLANK = rb"\x00\t\n\x0c\r "
_DELIM = rb"()<>\[\]{}/%"
_REGULAR = rb"[^" + _BLANK + _DELIM + rb"]"

LENIENT = re.compile(
    rb"(?P<gap>(?:[" + _BLANK + rb"]+|%[^\r\n]*)+)"
    rb"|(?P<num>[+-]?[0-9]+(?![0-9.]))|(?P<real>[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+))"
    rb"|(?P<name>/" + _REGULAR + rb"*)"
    rb"|(?P<open><<)|(?P<close>>>)|(?P<lsq>\[)|(?P<rsq>\])|(?P<hex><)|(?P<lit>\()"
    rb"|(?P<word>[A-Za-z][A-Za-z0-9*'\"]*)"
)
STRICT = re.compile(LENIENT.pattern.replace(rb"(?:[" + _BLANK + rb"]+|%[^\r\n]*)+", rb"[\r\n \t]+", 1))
_STRING = re.compile(rb"[^()\\\r]+|\\(?:[0-7]{1,3}|\r\n|[^0-7])|\r\n?|[()]", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\", b"\n": b"", b"\r": b"", b"\r\n": b""}
_WORDS = {b"true": True, b"false": False, b"null": None}
_HEX_BAD = re.compile(rb"[^0-9A-Fa-f\x00\t\n\x0c\r ]")


class LexError(PdfError):
    def __init__(self, message: str, at: int):
        super().__init__(f"Lexing error : {message}", Place(offset=at))


class SyntaxFault(PdfError):
    def __init__(self, at: int, what: str = "Syntax error"):
        super().__init__(what, Place(offset=at))


class Keyword(bytes):
    """A word that is no value, such as endobj."""


def number(text: bytes, at: int) -> int:
    n = int(text)
    if not MIN_INT <= n <= MAX_INT:
        raise LexError("integer error : integer overflow", at)
    return n


class Scanner:
    def __init__(self, data: bytes, at: int = 0, options: Options | None = None, strict: bool = False, end: int | None = None):
        self.data, self.at, self.options, self.strict = data, at, options or Options(), strict
        self.end = len(data) if end is None else end
        self.match = (STRICT if strict else LENIENT).match
        self.start = at  # where the last token began

    def token(self) -> Any:
        """The next token: a value, a Keyword (also for brackets), or EOF as Keyword(b"")."""
        data = self.data
        while self.at < self.end:
            m = self.match(data, self.at, self.end)
            self.start = self.at
            if not m:
                raise LexError(f"unexpected character : 0x{data[self.at]:x}", self.at)
            kind = m.lastgroup
            self.at = m.end()
            if kind == "gap":
                continue
            text = m.group()
            if kind == "num":
                return number(text, self.start)
            if kind == "name":
                return self.name(text[1:], self.start + 1)
            if kind == "word":
                return _WORDS[text] if text in _WORDS else Keyword(text)
            if kind == "real":
                return Real(text.decode())
            if kind == "lit":
                return self.string()
            if kind == "hex":
                return self.hex()
            return Keyword(text)
        self.start = self.at
        return Keyword(b"")

    def name(self, raw: bytes, at: int) -> Name:
        if raw.isascii() and b"#" not in raw and raw.isalnum():
            return Name(raw.decode())
        out, i = [], 0
        while i < len(raw):
            c = raw[i]
            if c == 0x23:
                digits = raw[i + 1 : i + 3]
                if not re.fullmatch(rb"[0-9A-Fa-f]{2}", digits):
                    raise LexError("invalid escape sequence in name context", at + i)
                if digits == b"00":
                    raise LexError("null character in escape sequence in name context", at + i)
                out.append(chr(int(digits, 16)))
                i += 3
                continue
            if not 0x21 <= c <= 0x7E:
                if self.strict or not self.options.allow_nonascii_in_names:
                    raise LexError(f"non-ASCII character in name context : 0x{c:x}", at + i)
                self.options.warnings.append(f"non-ASCII character in name context : 0x{c:x}")
            out.append(chr(c))
            i += 1
        return Name("".join(out))

    def string(self) -> bytes:
        out, depth = [], 1
        while True:
            m = _STRING.match(self.data, self.at, self.end)
            if not m:
                raise LexError("string is not terminated at end of file", self.end)
            text, at = m.group(), self.at
            self.at = m.end()
            if text == b"(":
                depth += 1
            elif text == b")":
                depth -= 1
                if not depth:
                    return b"".join(out)
            elif text[:1] == b"\r":
                text = b"\n"
            elif text[:1] == b"\\":
                rest = text[1:]
                if rest[:1].isdigit() and rest[0] < 0x38:
                    if int(rest, 8) > 255 or (self.strict and len(rest) != 3):
                        raise LexError(f"invalid octal escape in string context ({rest.decode()})", at)
                    text = bytes([int(rest, 8)])
                elif rest in _NAMED:
                    text = _NAMED[rest]
                else:
                    raise LexError("invalid escape sequence in string context", at)
            out.append(text)

    def hex(self) -> bytes:
        stop = self.data.find(b">", self.at, self.end)
        body = self.data[self.at : stop if stop >= 0 else self.end]
        if bad := _HEX_BAD.search(body):
            raise LexError(f"unexpected character in hexadecimal string context : 0x{body[bad.start()]:x}", self.at + bad.start())
        if stop < 0:
            raise LexError("hexadecimal string is not terminated at end of file", self.end)
        digits = body.translate(None, b"\x00\t\n\x0c\r ")
        if len(digits) % 2:
            if self.strict:
                raise SyntaxFault(self.at)
            digits += b"0"
        self.at = stop + 1
        return bytes.fromhex(digits.decode())

    def dictionary(self, flat: list[Any], starts: list[int]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if len(flat) % 2:
            raise SyntaxFault(self.start)
        for i in range(0, len(flat), 2):
            k, v = flat[i], flat[i + 1]
            if not isinstance(k, Name):
                raise SyntaxFault(starts[i])
            if k in out:
                message = f"The same name appears several times in dictionary : /{k}"
                if self.strict or not self.options.allow_dict_duplicates:
                    raise PdfError(message)
                self.options.warnings.append(message)
            if v is not None:
                out[k] = v
            else:
                out.pop(k, None)
        return out

    def value(self) -> tuple[Any, Keyword]:
        """One object and the keyword after it; the object is ``...`` if there is none."""
        top: list[Any] = []
        stack: list[tuple[list[Any], list[int], bytes]] = [(top, [], b"")]
        while True:
            flat, starts, opener = stack[-1]
            t = self.token()
            at = self.start
            if not isinstance(t, Keyword):
                flat.append(t)
                starts.append(at)
                continue
            if t == b"<<" or t == b"[":
                stack.append(([], [], bytes(t)))
            elif t == b"R":
                if len(flat) < 2 or not all(type(x) is int and x >= 0 for x in flat[-2:]):
                    raise SyntaxFault(at)
                flat[-2:] = [Ref(*flat[-2:])]
                starts.pop()
            elif t == b">>" and opener == b"<<":
                stack.pop()
                stack[-1][0].append(self.dictionary(flat, starts))
                stack[-1][1].append(at)
            elif t == b"]" and opener == b"[":
                stack.pop()
                stack[-1][0].append(flat)
                stack[-1][1].append(at)
            elif opener or t in (b">>", b"]"):
                raise SyntaxFault(at)
            else:
                if len(top) > 1:
                    raise SyntaxFault(starts[1])
                return (top[0] if top else ...), t
