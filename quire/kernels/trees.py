"""Page trees, name trees and outline lists of one file: parents, order and cycles."""

from __future__ import annotations

from typing import Any

from quire.kernels.document import Document
from quire.kernels.model import Name, PdfError, Place, Ref, Stream

CYCLE = "Graph error : Cyclic tree structure"


def _dict(doc: Document, ref: Ref) -> dict[str, Any]:
    if ref not in doc.objects:
        raise PdfError(f"Reference to unknown object : {ref.num}", Place(ref))
    x = doc.objects[ref]
    x = x.dict if isinstance(x, Stream) else x
    if not isinstance(x, dict):
        raise PdfError("Graph error : Expected a dictionary", Place(ref))
    return x


def _ref(x: Any, place: Place, message: str = "Graph error : Expected a reference") -> Ref:
    if not isinstance(x, Ref):
        raise PdfError(message, place)
    return x


def check_tree(doc: Document, root: Ref, kids: str = "Kids", parent: str | None = "Parent") -> int:
    """Number of nodes of the tree; each is met once and, with ``parent``, names the node it hangs on."""
    seen, stack = {root}, [root]
    while stack:
        node = stack.pop()
        d = _dict(doc, node)
        place = Place(node, f"/{kids}")
        below = d.get(kids)
        below = doc.get(below) if isinstance(below, Ref) else below
        if below is None:
            continue
        if not isinstance(below, list) or not all(isinstance(k, Ref) for k in below):
            raise PdfError("Graph error : Expected an array of references", place)
        for kid in below:
            if kid in seen:
                raise PdfError(CYCLE, Place(kid))
            seen.add(kid)
            if parent and (up := _dict(doc, kid).get(parent)) is not None and _ref(up, Place(kid, f"/{parent}")) != node:
                raise PdfError("Graph error : Invalid parent in tree structure", Place(kid))
        stack += reversed(below)
    return len(seen)


def check_list(doc: Document, root: Ref) -> int:
    """Number of items of an outline: children hang in lists, each checked before the next item."""
    seen = {root}
    stack = [root]
    while stack:
        above = stack.pop()
        d = _dict(doc, above)
        first, last = d.get("First"), d.get("Last")
        if (first is None) != (last is None):
            have, lacks = ("First", "Last") if last is None else ("Last", "First")
            raise PdfError(f"Graph error : Node is {have.lower()} element but has no {lacks.lower()} element", Place(above))
        if first is None:
            continue
        node, before = _ref(first, Place(above, "/First")), None
        _ref(last, Place(above, "/Last"))
        found = []
        while True:
            if node in seen:
                raise PdfError(CYCLE, Place(node))
            seen.add(node)
            found.append(node)
            item = _dict(doc, node)
            if (up := item.get("Parent")) is not None and _ref(up, Place(node, "/Parent")) != above:
                raise PdfError("Graph error : Invalid parent in tree structure", Place(node))
            prev = item.get("Prev")
            if before is None and prev is not None:
                raise PdfError("Graph error : Node is first element but has previous element", Place(node))
            if before is not None and (prev is None or _ref(prev, Place(node, "/Prev")) != before):
                raise PdfError("Graph error : Invalid previous element in list structure", Place(node))
            after = item.get("Next")
            if node == last and after is not None:
                raise PdfError("Graph error : Node is last element but has next element", Place(node))
            if node == last:
                break
            if after is None:
                raise PdfError("Graph error : Node is not last element but has no next element", Place(node))
            before, node = node, _ref(after, Place(node, "/Next"))
        stack += reversed(found)
    return len(seen) - 1


def check(doc: Document) -> PdfError | None:
    """The first error of the page tree, the destinations and the outline, in this order."""
    try:
        root = _ref(doc.trailer.get("Root"), Place("trailer", "/Root"), "Catalog is mandatory and shall be indirect")
        catalog = doc.objects.get(root)
        if not isinstance(catalog, dict):
            raise PdfError("Catalog shall be a dictionary", Place(root))
        check_tree(doc, _ref(catalog.get("Pages"), Place(root, "/Pages"), "Page root is mandatory and shall be indirect"))
        names = doc.get(catalog.get("Names"))
        if names is not None:
            if not isinstance(names, dict):
                raise PdfError("Names shall be a dictionary", Place(root, "/Names"))
            if names.get("Dests") is not None:
                check_tree(doc, _ref(names["Dests"], Place(root, "/Names"), "Dest shall be indirect"), parent=None)
        if catalog.get("Outlines") is not None:
            check_list(doc, _ref(catalog["Outlines"], Place(root, "/Outlines"), "Outlines shall be indirect"))
    except PdfError as e:
        return e
    return None


def pages(doc: Document) -> list[Ref]:
    """The pages in order; stops at what isn't a tree."""
    root = doc.objects.get(doc.trailer.get("Root"))
    out, seen, stack = [], set(), [root.get("Pages")] if isinstance(root, dict) else []
    while stack:
        ref = stack.pop()
        d = doc.objects.get(ref)
        if ref in seen or not isinstance(d, dict):
            continue
        seen.add(ref)
        if d.get("Type") == Name("Pages"):
            kids = doc.get(d.get("Kids"))
            stack += reversed(kids if isinstance(kids, list) else [])
        elif d.get("Type") == Name("Page"):
            out.append(ref)
        else:
            raise PdfError("Unexpected /Type in page tree", Place(ref))
    return out
