"""The page-drawing language: tokens, operators with their operands, and their legal order."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from quire.kernels.model import Name, PdfError, Place, Real, Ref
from quire.kernels.scan import Keyword, LexError, Scanner

# Fixed values of the page language: operators and operands by category, operands in
# page order: n number, N name, s string, a array of numbers, t array of strings and
# numbers, d dictionary, p name or dictionary, * anything.
OPERATORS = """
Compatibility: BX EX
GeneralGraphicsState: w(n) J(n) j(n) M(n) d(an) ri(N) i(n) gs(N)
SpecialGraphicsState: q Q cm(nnnnnn)
PathConstruction: m(nn) l(nn) c(nnnnnn) v(nnnn) y(nnnn) h re(nnnn)
PathPainting: S s f F f* B B* b b* n
ClippingPath: W W*
TextState: Tc(n) Tw(n) Tz(n) TL(n) Tf(Nn) Tr(n) Ts(n)
TextPositioning: Td(nn) TD(nn) Tm(nnnnnn) T*
TextShowing: Tj(s) '(s) "(nns) TJ(t)
Type3Font: d0(nn) d1(nnnnnn)
Color: CS(N) cs(N) SC(*) SCN(*) sc(*) scn(*) G(n) g(n) RG(nnn) rg(nnn) K(nnnn) k(nnnn)
MarkedContent: MP(N) DP(Np) BMC(N) BDC(Np) EMC
Other: BT ET sh(N) BI Do(N)
"""
CATEGORY: dict[str, str] = {}
SHAPE: dict[str, str] = {}
for _line in OPERATORS.strip().splitlines():
    _cat, _, _ops = _line.partition(": ")
    for _op in _ops.split():
        _name, _, _shape = _op.partition("(")
        CATEGORY[_name], SHAPE[_name] = _cat, _shape.rstrip(")")

_STAY = {
    "page": {"Compatibility", "GeneralGraphicsState", "SpecialGraphicsState", "Color", "TextState", "MarkedContent"},
    "text": {"Compatibility", "GeneralGraphicsState", "Color", "TextState", "TextPositioning", "TextShowing", "MarkedContent"},
    "path": {"Compatibility", "PathConstruction"},
    "clipping": {"Compatibility"},
}
_MOVE = {
    ("page", "BT"): "text", ("page", "m"): "path", ("page", "re"): "path", ("page", "sh"): "page", ("page", "BI"): "page",
    ("page", "Do"): "page", ("text", "ET"): "page", ("path", "ClippingPath"): "clipping", ("path", "PathPainting"): "page",
    ("clipping", "PathPainting"): "page",
}
_RESOURCE = {"gs": ("ExtGState", 0), "Tf": ("Font", 0), "CS": ("ColorSpace", 0), "cs": ("ColorSpace", 0), "sh": ("Shading", 0), "Do": ("XObject", 0), "DP": ("Properties", 1), "BDC": ("Properties", 1)}

_TOKEN = re.compile(
    rb"(?P<gap>[\x00\t\n\x0c\r ]+)|(?P<num>[+-]?[0-9]+(?![0-9.]))|(?P<real>[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+))"
    rb"|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<open><<)|(?P<close>>>)|(?P<lsq>\[)|(?P<rsq>\])|(?P<hex><)|(?P<lit>\()"
    rb"|(?P<word>[A-Za-z'\"][A-Za-z0-9*]*)"
)
_IMAGE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)")


class Op(NamedTuple):
    name: str
    operands: list[Any]
    offset: int


class _Scanner(Scanner):
    def __init__(self, data: bytes, options):
        super().__init__(data, 0, options)
        self.match = _TOKEN.match

    def token(self) -> Any:
        try:
            t = super().token()
        except LexError as e:
            e.message = e.message.replace("unexpected character :", "unexpected character in content stream :")
            raise
        if isinstance(t, Keyword) and t.isalnum() and t.decode() not in SHAPE and t not in (b"ID", b"EI", b"R", b"d0", b"d1"):
            raise LexError("unexpected word", self.start)
        return t


def _fits(x: Any, shape: str) -> bool:
    num = (type(x) is int) or isinstance(x, Real)
    if shape == "n":
        return num
    if shape == "N":
        return isinstance(x, Name)
    if shape == "s":
        return isinstance(x, bytes)
    if shape == "a":
        return isinstance(x, list) and all(_fits(v, "n") for v in x)
    if shape == "t":
        return isinstance(x, list) and all(_fits(v, "n") or isinstance(v, bytes) for v in x)
    return isinstance(x, (Name, dict))


def parse(data: bytes, options=None) -> list[Op]:
    """The operators of a content stream in order; PdfError at the first fault."""
    scanner = _Scanner(data, options)
    out: list[Op] = []
    operands: list[Any] = []
    while True:
        at = scanner.at
        t = scanner.token()
        if not isinstance(t, Keyword):
            operands.append(t)
            continue
        start = scanner.start
        if t in (b"[", b"<<"):
            operands.append(_container(scanner, start))
            continue
        if t == b"":
            if operands:
                raise PdfError("Syntax error in content stream", Place(offset=at))
            return out
        op = t.decode()
        if op == "BI":
            if operands:
                raise PdfError("Syntax error in content stream", Place(offset=start))
            operands = [_image(scanner, start)]
        else:
            shape = SHAPE.get(op)
            ok = shape is not None and (shape == "*" or (len(shape) == len(operands) and all(_fits(x, s) for x, s in zip(operands, shape))))
            if not ok:
                raise PdfError("Syntax error in content stream", Place(offset=start))
        out.append(Op(op, operands, start))
        operands = []


def _container(scanner: _Scanner, start: int) -> Any:
    """An array or dictionary whose opening token was just read."""
    scanner.at = start
    stack: list[tuple[list[Any], bytes]] = [([], b"")]
    while True:
        t = scanner.token()
        flat, opener = stack[-1]
        if not isinstance(t, Keyword):
            flat.append(t)
        elif t in (b"[", b"<<"):
            stack.append(([], bytes(t)))
        elif (opener, bytes(t)) in ((b"[", b"]"), (b"<<", b">>")):
            stack.pop()
            stack[-1][0].append(flat if opener == b"[" else scanner.dictionary(flat, [scanner.start] * len(flat)))
            if len(stack) == 1:
                return stack[0][0][0]
        else:
            raise PdfError("Syntax error in content stream", Place(offset=scanner.start))


def _image(scanner: _Scanner, start: int) -> dict[str, Any]:
    flat: list[Any] = []
    while (t := scanner.token()) != b"ID":
        if isinstance(t, Keyword) and t in (b"[", b"<<"):
            t = _container(scanner, scanner.start)
        if isinstance(t, Keyword):
            raise PdfError("Syntax error in content stream", Place(offset=scanner.start))
        flat.append(t)
    out = scanner.dictionary(flat, [start] * len(flat))
    m = _IMAGE_END.search(scanner.data, scanner.at)
    if not m:
        raise LexError("inline image is not terminated at end of content stream", scanner.end)
    out["data"] = scanner.data[scanner.at + 1 : m.start()]
    scanner.at = m.end()
    return out


def step(state: str, op: str) -> str | None:
    """The state after an operator, or None where it isn't allowed."""
    cat = CATEGORY[op]
    return _MOVE.get((state, op)) or _MOVE.get((state, cat)) or (state if cat in _STAY[state] else None)


def check(ops: list[Op], key: Ref | None = None, type3: bool = False) -> list[str]:
    """Warnings; PdfError where an operator is out of order or q and Q don't match."""
    warnings = []
    state, depth = "page", 0
    for i, op in enumerate(ops):
        place = Place(key, offset=op.offset, inside=key)
        if type3 and i == 0:
            if CATEGORY[op.name] != "Type3Font":
                raise PdfError("Expected d0 or d1 as first command in content stream of Type 3 font", Place(key))
            continue
        after = step(state, op.name)
        if after is None:
            raise PdfError(f'Unexpected command {op.name} in state "{state}" of content stream', Place(key))
        state = after
    if type3 and not ops:
        raise PdfError("Expected d0 or d1 as first command in content stream of Type 3 font", Place(key))
    if state != "page":
        warnings.append(f'Content stream does not finish in state "page" but in state "{state}"')
    for op in ops:
        depth += (op.name == "q") - (op.name == "Q")
        if depth < 0:
            raise PdfError("Content stream contains unbalanced q and Q operators", Place(key))
    if depth:
        warnings.append("Content stream contains useless q operator")
    return warnings


def resources(ops: list[Op]) -> dict[str, set[str]]:
    """Names of resources by category."""
    out: dict[str, set[str]] = {}
    for op in ops:
        if op.name in _RESOURCE:
            category, at = _RESOURCE[op.name]
            if isinstance(op.operands[at], Name):
                out.setdefault(category, set()).add(str(op.operands[at]))
        elif CATEGORY[op.name] == "Color" and op.operands and isinstance(op.operands[-1], Name):
            out.setdefault("Pattern", set()).add(str(op.operands[-1]))
    return out
