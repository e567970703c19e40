"""The verbs on single files, without a cluster: ``python -m quire VERB [options] FILE``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from quire.kernels import codecs, document, report, schema
from quire.kernels.model import TRAILER, Name, Options, PdfError, Place, Ref, Stream, key_text, marked, pretty, stream_text


def _load(args, only=None) -> document.Document:
    path = Path(args.file)
    if not path.is_file():
        print(f'Invalid file name "{path}" : {"is a directory" if path.is_dir() else "no such file"} !', file=sys.stderr)
        raise SystemExit(2)
    o = Options.read(Path(args.options).read_text()) if getattr(args, "options", None) else Options()
    for flag in ("strict", "decode_streams", "relax_streams", "simplify_info", "remove_ptex", "merge_content_streams", "expand_streams"):
        if getattr(args, flag, False):
            setattr(o, flag, True)
    o.stream_limit = getattr(args, "stream_limit", None)
    data = path.read_bytes()
    doc = document.load(data, o, only)
    if args.verbose or args.debug:
        print(f"File has length : {len(data)} [0x{len(data):x}]", file=sys.stderr)
        if doc.version is not None:
            print(f"File version is : 1.{doc.version}", file=sys.stderr)
    if args.debug:
        for low, high, key in sorted(doc.extents, key=lambda e: e[0]):
            print(f"{key_text(key)} from {low} [0x{low:x}] to {high} [0x{high:x}]", file=sys.stderr)
    return doc


def _fail(e: Exception) -> int:
    print(e, file=sys.stderr)
    return 2


def _warn(doc: document.Document) -> None:
    for w in doc.options.warnings:
        print(f"Warning : {w}", file=sys.stderr)


def _loaded(args, only=None) -> document.Document:
    doc = _load(args, only)
    _warn(doc)
    if doc.errors:
        raise doc.errors[0]
    return doc


def _xref(args) -> int:
    doc = _load(args, document.STRUCTURE)
    print(report.xref_text(doc), end="")
    return 0 if doc.xref else _fail(doc.errors[0])


def _types(args) -> int:
    print(schema.registry().dump(), end="")
    return 0


def _stats(args) -> int:
    doc = _load(args)
    s = report.stats(doc)
    print(s.text(), end="")
    return 2 if s.error else 0


def _extract(args) -> int:
    doc = _loaded(args)
    known = schema.checked(doc) if args.types or args.dot else {}
    for path, text in (
        (args.xref, lambda: report.xref_text(doc)), (args.dump, lambda: report.dump_text(doc)), (args.dot, lambda: report.dot_text(doc, known)),
        (args.visjs, lambda: report.visjs_text(doc)), (args.loc, lambda: report.layout_text(doc)), (args.holes, lambda: report.layout_text(doc, True)),
        (args.types, lambda: schema.dump(known, len(doc.objects))),
    ):
        if path:
            Path(path).write_text(text(), encoding="latin-1")
    return 0


def _object(args) -> int:
    ref = Ref(args.num, args.gen)
    doc = _loaded(args, ref)
    if ref not in doc.objects:
        raise PdfError("Reference to unknown object", Place(ref))
    x = doc.objects[ref]
    if isinstance(x, Stream):
        if args.decoded_stream:
            x.data = document.decode_stream(x, Place(ref), doc.options)
        if args.raw_stream or args.decoded_stream:
            sys.stdout.flush()
            sys.stdout.buffer.write(x.data if args.decoded_stream else x.raw)
            return 0
        print(pretty(x.dict) + "\n" + stream_text(x, doc.options))
        return 0
    print(pretty(x))
    return 0


def _trailer(args) -> int:
    for t in _loaded(args, document.STRUCTURE).trailers:
        print(pretty(t))
    return 0


def _cleanup(args) -> int:
    Path(args.out).write_bytes(report.clean(_loaded(args)))
    return 0


def _found(doc: document.Document, hits: list, args) -> int:
    """The places by object; with --show each object once, with --highlight its places inverted."""
    if not hits:
        print("Not found")
        return 255
    places: dict = {}
    for key, path in hits:
        places.setdefault(key, []).append(path)
    for key, paths in places.items():
        for path in paths:
            print(f"Found in object {key_text(key)} at entry {path}")
        if args.show:
            print(marked(doc.trailer if key == TRAILER else doc.objects[key], set(paths) if args.highlight else set()) + "\n")
    print(f"Found {len(hits)} occurrence(s) in {len({k for k, _ in hits})} object(s).")
    return 0


def _findref(args) -> int:
    doc = _loaded(args)
    return _found(doc, report.find(doc, Ref(args.num, args.gen)), args)


def _findname(args) -> int:
    doc = _loaded(args)
    return _found(doc, report.find(doc, Name(args.name)), args)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(verb_name: str, run, /, *flags: str, file: bool = True, **typed):
        v = verbs.add_parser(verb_name)
        for f in flags:
            v.add_argument(f"--{f}", action="store_true")
        for f, (kind, default) in typed.items():
            v.add_argument(f"--{f.replace('_', '-')}", type=kind, default=default, required=default is ...)
        if file:
            v.add_argument("--verbose", action="store_true", help="length and version of the file, on the error output")
            v.add_argument("--debug", action="store_true", help="where each object was found, too; keys are always sorted, so --sort-dicts changes nothing")
            v.add_argument("--options")
            v.add_argument("file")
        v.set_defaults(run=run)

    path, num = (str, None), (int, ...)
    verb("xref", _xref)
    verb("types", _types, file=False)
    verb("stats", _stats, "strict")
    verb("extract", _extract, "strict", "sort-dicts", "expand-streams", "decode-streams", "relax-streams", stream_limit=(int, None), xref=path, dump=path, dot=path, visjs=path, loc=path, holes=path, types=path)
    verb("object", _object, "sort-dicts", "raw-stream", "decoded-stream", num=num, gen=(int, 0))
    verb("trailer", _trailer, "sort-dicts")
    verb("cleanup", _cleanup, "decode-streams", "relax-streams", "simplify-info", "remove-ptex", "merge-content-streams", out=(str, ...))
    verb("findref", _findref, "show", "highlight", "sort-dicts", num=num, gen=(int, 0))
    verb("findname", _findname, "show", "highlight", "sort-dicts", name=(str, ...))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (PdfError, codecs.CodecError) as e:
        return _fail(e)


if __name__ == "__main__":
    raise SystemExit(main())
