"""Object literals as a flat stream of nodes.

A single scan over the text with an explicit stack: no recursion, so depth is
bounded by memory only.  The scanner is lenient: containers left open at the
end are closed there and stray closers are skipped, because a damaged literal
should lose as little structure as possible.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# Fixed values of the file format: blank characters and delimiters.
BLANK = "\\x00\\t\\n\\x0c\\r "
DELIM = "()<>\\[\\]{}/%"
_GAP = f"(?:[{BLANK}]|%[^\\r\\n]*(?=[\\r\\n]|\\Z))"
_SIMPLE = r"(?:[^()\\]++|\\.)*+"
# Groups by number: names are compared far more slowly.
_NAME, _NUM, _GEN, _WORD, _OPEN, _CLOSE, _LSQ, _RSQ, _HEX, _STRING, _DEEP = range(1, 12)
_TOKEN = re.compile(
    f"/([^{BLANK}{DELIM}]*)"
    f"|([0-9]+){_GAP}+([0-9]+){_GAP}+R(?![^{BLANK}{DELIM}])"
    f"|([^{BLANK}{DELIM}]+)"
    f"|(<<)|(>>)|(\\[)|(\\])"
    f"|<([^<>]*)>?"
    f"|\\(({_SIMPLE}(?:\\({_SIMPLE}\\){_SIMPLE})*+)\\)|(\\()"
    f"|%[^\\r\\n]*",
    re.S,
)
_PAREN = re.compile(r"\\.|[()]", re.S)
_ESCAPE = re.compile("#([0-9A-Fa-f]{2})")
_INT = re.compile(r"[+-]?[0-9]+\Z")
_REAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\Z")

DICT, ARRAY, REF = "dict", "array", "ref"


def unescape(name: str) -> str:
    """A name with each ``#xx`` replaced by the character with that code."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), name) if "#" in name else name


def string_end(text: str, at: int) -> int:
    """Index after the parenthesis that closes the one before ``at``; the length if none does."""
    depth = 1
    for m in _PAREN.finditer(text, at):
        c = m.group()
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return m.end()
    return len(text)


def nodes(text: str, leaves: bool = True) -> Iterator[tuple[int, int, str, str, str, int | None, str | None, str, str | None]]:
    """(ordinal, parent ordinal, path, group path, parent group path, index, key, kind, value) in pre-order.

    The root has ordinal 0 and parent -1.  The group path has ``[]`` for every
    array index, so nodes of one repeated ancestor share it.  ``value`` is the
    text of a leaf, ``num gen`` of a reference, null of a container.  Without
    ``leaves`` only dictionaries, arrays and references are yielded; the
    ordinals still count every node.
    """
    # A frame: [ordinal, path, group, is_dict, next index, pending key or None]
    stack: list[list] = []
    count = at = 0
    while at is not None:
        begin, at = at, None
        for m in _TOKEN.finditer(text, begin):
            what = m.lastindex
            value = None
            if what == _NAME:
                value = unescape(m[_NAME])
                if stack and stack[-1][3] and stack[-1][5] is None:
                    stack[-1][5] = value
                    continue
                kind = "name"
            elif what == _WORD:
                if not leaves and stack:  # the commonest case: only its place counts
                    top = stack[-1]
                    if top[3]:
                        top[5] = None
                    else:
                        top[4] += 1
                    count += 1
                    continue
                value = m[_WORD]
                kind = _word(value)
            elif what == _GEN:
                kind, value = REF, f"{int(m[_NUM])} {int(m[_GEN])}"
            elif what == _OPEN:
                kind = DICT
            elif what == _LSQ:
                kind = ARRAY
            elif what == _CLOSE or what == _RSQ:
                want = what == _CLOSE
                if stack and stack[-1][3] is want:
                    stack.pop()
                elif any(f[3] is want for f in stack):
                    while stack.pop()[3] is not want:
                        pass
                continue
            elif what == _STRING:
                kind, value = "string", m[_STRING]
            elif what == _HEX:
                kind, value = "hex", m[_HEX]
            elif what == _DEEP:  # parentheses nested deeper than the expression follows
                at = string_end(text, m.end())
                kind, value = "string", text[m.end() : at - 1]
            else:
                continue
            index = key = None
            inner = kind is DICT or kind is ARRAY
            wanted = leaves or inner or kind is REF
            if stack:
                top = stack[-1]
                if top[3]:
                    key = top[5] or ""  # "" for a value without a key in a damaged dictionary
                    top[5] = None
                    if wanted:
                        path, group = f"{top[1]}/{key}", f"{top[2]}/{key}"
                else:
                    index = top[4]
                    top[4] = index + 1
                    if wanted:
                        path, group = f"{top[1]}[{index}]", f"{top[2]}[]"
                parent, above = top[0], top[2]
            elif not count:
                path = group = above = ""
                parent = -1
            else:
                wanted = inner = False  # only the first object of a text is its root
                count -= 1
            if wanted:
                yield count, parent, path, group, above, index, key, kind, value
            if inner:
                stack.append([count, path, group, kind is DICT, 0, None])
            count += 1
            if at is not None:
                break


def _word(value: str) -> str:
    if value == "null":
        return "null"
    if value in ("true", "false"):
        return "bool"
    return "int" if _INT.match(value) else "real" if _REAL.match(value) else "word"
