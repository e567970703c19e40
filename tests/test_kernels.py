import random
import zlib

import pytest
from hypothesis import given, strategies as st

from quire.kernels import codecs as C, crypt, document as D, fixtures, pagelang as P, report as R, schema as S, trees, writer as W
from quire.kernels.model import Name, Options, PdfError, Place, Real, Ref, Stream, compact, edit, escape_name, key_id, key_text, pretty, walk
from quire.kernels.scan import Scanner

N = Name


def rejects(f, *a):
    with pytest.raises((C.CodecError, PdfError)):
        f(*a)


# --- codecs ---


def test_codec_vectors():
    assert C.hex_encode(b"hello") == b"68656C6C6F>"
    assert C.hex_decode(b" 6\n8 65\t6C6c6F \x00>") == b"hello" and C.hex_decode(b">") == b"" and C.hex_decode(b"7>") == b"p"
    for x, y in ((b"\0" * 4, b"z~>"), (b"\0" * 3, b"!!!!~>"), (b"hello", b"BOu!rDZ~>"), (b"\xff" * 4, b"s8W-!~>"), (b"", b"~>")):
        assert C.a85_encode(x) == y and C.a85_decode(y) == x
    for bad in (b"!z~>", b"uuuuu~>", b's8W-"~>', b"foo", b"!~>", b"vvvvv~>"):
        rejects(C.a85_decode, bad)
    assert C.runlength_encode(b"Hello world").hex() == "0a48656c6c6f20776f726c6480" and C.runlength_decode(b"\xffa\x80") == b"aa"
    for bad in (b"", b"\x00a", b"\x80a", b"\x05ab\x80", b"\xff"):
        rejects(C.runlength_decode, bad)
    assert C.lzw_encode(b"") == b"\x80\x80" and C.lzw_decode(bytes.fromhex("800B6050220C0C8501")) == b"-----A---B"
    for bad in (b"", b"\x80\x0b", b"\x80\x80\x00", b"\x80\x81"):
        rejects(C.lzw_decode, bad)
    assert C.flate_decode(bytes.fromhex("789c030000000001")) == b"" and C.adler32(b"hello world") == 0x1A0B045D and C.adler32(b"") == 1
    good = zlib.compress(b"data")
    for bad in (good[:5], b"\x78\x9d" + good[2:], b"\x88\x1c" + good[2:], b"\x79\x9b" + good[2:], good[:-1] + bytes([good[-1] ^ 1]), good + b"x"):
        rejects(C.flate_decode, bad)
    warn = []
    assert C.decode(good + b"\n", "FlateDecode", None, warn) == b"data" and len(warn) == 1
    for f in C.OPAQUE:
        with pytest.raises(C.CodecError, match="Not implemented decoding"):
            C.decode(b"", f)
    with pytest.raises(C.CodecError, match="Invalid stream filter : Foo"):
        C.decode(b"", "Foo")


@given(st.binary(max_size=700), st.sampled_from(C.CODED))
def test_codecs_round_trip(b, f):
    assert C.decode(C.encode(b, f), f) == b


def test_long_round_trips_and_chain():
    for f in C.CODED:
        assert C.decode(C.encode(b"x" * 10_000, f), f) == b"x" * 10_000
    raw = C.encode(C.encode(b"abc" * 99, "FlateDecode"), "ASCII85Decode")
    assert C.decode_chain(raw, ["ASCII85Decode", "FlateDecode"]) == b"abc" * 99
    rejects(C.decode_chain, raw, ["ASCII85Decode", "FlateDecode"], [None])


def test_png_prediction():
    r = random.Random(1)
    for colors in (1, 3):
        rows = [[r.randrange(256) for _ in range(6 * colors)] for _ in range(10)]
        data, prev = b"", [0] * 6 * colors
        for i, row in enumerate(rows):
            tag, line = i % 5, []
            for k, x in enumerate(row):
                a = row[k - colors] if k >= colors else 0
                b, c = prev[k], prev[k - colors] if k >= colors else 0
                p = a + b - c
                line.append((x - (0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v)))[tag]) % 256)
            data += bytes([tag, *line])
            prev = row
        assert C.png_predict(data, 6, colors) == bytes(x for row in rows for x in row)
    rejects(C.png_predict, b"\x00ab", 3)
    rejects(C.png_predict, b"\x09abc", 3)


# --- decryption ---


def test_ciphers():
    assert crypt.rc4(b"Password", b"Hello world").hex() == "688a030b2d4ed15671ebc5"
    data = b"fedcba9876543210" + bytes.fromhex("3c4253a6917f754726a56a20d2064845")
    assert crypt.aes_cbc(b"0123456789abcdef", data) == b"Hello world"
    assert crypt.aes_cbc_encrypt(b"0123456789abcdef", b"Hello world", data[:16]) == data
    for n in range(0, 70, 3):
        assert crypt.aes_cbc(b"k" * 16, crypt.aes_cbc_encrypt(b"k" * 16, bytes(range(n)), b"i" * 16)) == bytes(range(n))
    for bad in (data[:-1], data[:16], data[:-1] + b"\0", b""):
        rejects(crypt.aes_cbc, b"0123456789abcdef", bad)


@pytest.mark.parametrize("revision,bits,version", [(2, 40, 1), (3, 128, 2), (4, 128, 4)])
def test_encrypted_file(revision, bits, version):
    first_id = b"0123456789abcdef"
    d = {"Filter": N("Standard"), "V": version, "R": revision, "Length": bits, "P": -44, "O": bytes(range(32)), "U": bytes(32)}
    if version == 4:
        d |= {"CF": {"StdCF": {"CFM": N("V2")}}, "StmF": N("StdCF"), "StrF": N("StdCF")}
    key = crypt._file_key(b"secret", d, first_id, bits, revision, True)
    d["U"] = crypt._user_mark(key, first_id, revision).ljust(32, b"\0")
    h = crypt.handler(d, first_id, b"secret")
    assert h.user_ok and not h.owner_ok
    rejects(crypt.handler, d, first_id, b"wrong")
    objects, trailer = fixtures.hello("text")
    sealed = {}
    for ref, x in objects.items():
        x = edit(x, lambda v: h.decrypt(ref, v, strings=True) if isinstance(v, bytes) else v)
        if isinstance(x, Stream):
            x.raw = h.decrypt(ref, x.raw)
        sealed[ref] = x
    data = W.write(sealed, trailer | {"Encrypt": d, "ID": [first_id, first_id]})
    doc = D.load(data, Options(user_password=b"secret"))
    assert doc.complete and doc.objects[Ref(6, 0)] == {"Title": b"text"} and doc.objects[Ref(4, 0)].raw == objects[Ref(4, 0)].raw
    assert "User password is valid" in R.stats(doc).text()
    assert "Invalid user and owner passwords" in str(D.load(data).errors[0]) and "Encrypted document" in str(D.load(data, Options(no_decrypt=True)).errors[0])
    assert D.load(data, Options(ignore_crypt=True)).complete


# --- scanning and text forms ---


def value(text, **o):
    return Scanner(text, 0, Options(**o)).value()[0]


def test_scanner():
    assert value(b"<</A 1 0 R/B[1 2 3 0 R (a\\(b\\051\\n\\\nx(y)) <4>]/C<</D null/E true>> /F#41 -1.5>>") == {
        "A": Ref(1, 0), "B": [1, 2, Ref(3, 0), b"a(b)\nx(y)", b"@"], "C": {"E": True}, "FA": Real("-1.5")}
    assert value(b"(a\r\nb\rc)") == b"a\nb\nc" and value(b"-2147483648") == -(2**31)
    for bad, message in ((b"2147483648", "integer overflow"), (b"(a", "string is not terminated"), (b"<4x>", "hexadecimal string context : 0x78"), (b"/a#0", "invalid escape sequence in name"), (b"/a#00", "null character"),
                         (b"(\\x)", "invalid escape sequence in string"), (b"(\\777)", "invalid octal"), (b"<</A 1/A 2>>", "The same name appears several times in dictionary : /A"), (b"[1 0 ", "Syntax error"), (b"<</A>>", "Syntax error"), (b"/\xe9", "non-ASCII")):
        with pytest.raises(PdfError, match=message.replace("(", "\\(")):
            value(bad)
    assert value(b"<</A 1/A 2>>", allow_dict_duplicates=True) == {"A": 2} and value(b"<</A null/A 2>>") == {"A": 2}
    assert value(b"[" * 5000 + b"]" * 5000) is not None


def test_text_forms():
    x = {"K": [1, Real("2.5"), N("a b"), b"p(", b"\x80", Ref(3, 1), None, True], "D": {}}
    assert pretty(x) == "<<\n    /D <<\n    >>\n    /K [1 2.5 /a#20b (p\\() <80> 3 1 R null true]\n>>"
    assert compact(x) == "<</D<<>>/K[1 2.5/a#20b(p\\()(\x80)3 1 R null true]>>" and value(compact(x).encode("latin-1")) == x
    assert key_text(Ref(5, 0)) == "5" and key_text(Ref(5, 2)) == "5 [2]" and key_id(Ref(5, 2)) == "5_2" and escape_name("a/#é") == "a#2F#23#E9"
    assert str(Place(Ref(4, 0), "/Length")) == " in object 4 at entry /Length" and str(Place(Ref(1, 0), offset=15)) == " in object 1 at offset 15 [0xf] in file"
    assert [p for p, _ in walk(x)][:3] == ["", "/D", "/K"]


def test_options():
    o = Options.read("strict\nundefined-ref-as-null\n\nuser-password=a=b\nreencode-streams=FlateDecode\n")
    assert o.strict and o.undefined_ref_as_null and o.user_password == b"a=b" and o.reencode_streams == "FlateDecode"
    with pytest.raises(ValueError):
        Options.read("no-such")


# --- files ---

CLEAN = """Version : 1.5
Incremental updates : 0
Neither updates nor object streams nor free objects nor encryption
Object count : 6
Filter : Raw -> 1 times
Objects of known type : 6
Known type rate : 1.000000
All types were fully checked
Graph has no known error
Content streams have no known error
No error found
"""


@pytest.mark.parametrize("strict", [False, True])
def test_clean_file(strict):
    assert R.stats(D.load(fixtures.hello_file("a (b) ü"), Options(strict=strict))).text() == CLEAN


def test_filter_and_types():
    doc = D.load(fixtures.hello_file("x", "ASCII85Decode"))
    assert R.filters_of(doc) == {"ASCII85Decode": 1}
    assert S.dump(S.check(doc)[0], 6).startswith('1 : c"catalog"\n2 : c"pageroot"\n3 : c"page"\n4 : s"content_stream"\n5 : c"font_type1_standard"\n6 : c"info"\n\n# of objects of known type : 6 / 6\n\nc"catalog" : 1\n')


def built(change, **o):
    objects, trailer = fixtures.hello("x")
    change(objects)
    return D.load(W.write(objects, trailer, fixtures.HEAD), Options(**o))


def test_errors_are_reported_where_they_are():
    raw = fixtures.hello_file("x")
    at = raw.index(b"/Catalog")
    bad = raw.replace(b"/Catalog", b"/Cat#log")
    assert str(D.load(bad).errors[0]) == f"PDF error : Lexing error : invalid escape sequence in name context in object 1 at offset {at + 4} [0x{at + 4:x}] in file !"
    assert "Not a PDF file" in R.stats(D.load(b"%PDX-1.5\n")).text() and "No startxref found" in R.stats(D.load(b"%PDF-1.5\nnothing")).text()
    assert D.load(b"").errors and R.stats(D.load(b"%PDF-9\n%%EOF", Options(allow_invalid_version=True))).text().startswith("Version : unknown")
    comment = raw.replace(b"1 0 obj", b"%a\n1 0 obj").replace(b"startxref\n", b"startxref\n")
    assert "unexpected character : 0x25" in str(D.load(comment, Options(strict=True)).errors[0])
    twice = raw.replace(b"<</Pages 2 0 R/Type/Catalog>>", b"<</Pages 2 0 R/Type/Pages/Type/X>>"[:29].ljust(29))
    assert D.load(twice).errors
    loop = built(lambda o: o[Ref(2, 0)].update(Kids=[Ref(3, 0), Ref(2, 0)]))
    assert R.stats(loop).error is not None and str(trees.check(loop)) == "PDF error : Graph error : Cyclic tree structure in object 2 !"
    missing = built(lambda o: o[Ref(3, 0)].update(Annots=[Ref(99, 0)]))
    assert "Reference to unknown object" in str(R.stats(missing).error)
    lenient = built(lambda o: o[Ref(3, 0)].update(Annots=[Ref(99, 0)]), undefined_ref_as_null=True)
    assert lenient.complete and lenient.objects[Ref(3, 0)]["Annots"] == [None] and lenient.options.warnings


def test_recursive_length():
    objects, trailer = fixtures.hello("x")
    objects[Ref(7, 0)] = Ref(8, 0)
    objects[Ref(8, 0)] = Ref(7, 0)
    objects[Ref(4, 0)].dict["Length"] = Ref(7, 0)
    assert "Circular definition detected" in str(D.load(W.write(objects, trailer)).errors[0])
    assert "Expected non-negative integer in object 4 at entry /Length" in str(D.load(W.write(objects, trailer), Options(strict=True)).errors[0])


def test_indirect_length_and_overlap():
    def change(o):
        o[Ref(7, 0)] = o[Ref(4, 0)].dict["Length"]
        o[Ref(4, 0)].dict["Length"] = Ref(7, 0)

    s = R.stats(built(change))
    assert (s.known, s.objects) == (6, 7) and "Known type rate : 0.857143" in s.text()
    raw = fixtures.hello_file("x")
    two = raw.index(b"2 0 obj")
    shifted = raw.replace(b"%010d 00000 n" % two, b"%010d 00000 n" % (two - 1))
    assert D.load(shifted).complete or "overlap" in str(D.load(shifted).errors[0])


def updated(raw):
    """The file with object 6 written anew and 5 deleted in an incremental update."""
    at = len(raw) + 1
    prev = int(raw.rsplit(b"startxref\n", 1)[1].split()[0])
    body = b"\n6 0 obj<</Title(new)>>endobj\n"
    table = b"xref\n5 2\n0000000000 00001 f \n%010d 00000 n \ntrailer\n<</Info 6 0 R/Root 1 0 R/Size 7/Prev %d>>\nstartxref\n%d\n%%%%EOF\n" % (at, prev, len(raw) + len(body))
    return raw + body + table


def test_incremental_update():
    doc = D.load(updated(fixtures.hello_file("x")))
    assert doc.complete and doc.updates == 1 and len(doc.trailers) == 2 and doc.has_free and doc.objects[Ref(6, 0)] == {"Title": b"new"}
    assert "*(6, 0) at" in R.xref_text(doc) and "1 shadowed object(s)" in R.xref_text(doc)


def compressed():
    """Objects 1, 2, 3, 5, 6 in an object stream, with a cross-reference stream."""
    objects, _ = fixtures.hello("x")
    inner = [r for r in sorted(objects) if r.num != 4]
    texts = [compact(objects[r]).encode("latin-1") for r in inner]
    offs = [sum(len(t) + 1 for t in texts[:i]) for i in range(len(texts))]
    head = b" ".join(b"%d %d" % (r.num, o) for r, o in zip(inner, offs)) + b" "
    raw = C.encode(head + b" ".join(texts), "FlateDecode")
    out = bytearray(fixtures.HEAD)
    where = {}
    for num, s in ((4, objects[Ref(4, 0)]), (8, Stream({"Type": N("ObjStm"), "N": len(inner), "First": len(head), "Length": len(raw), "Filter": N("FlateDecode")}, raw))):
        where[num] = len(out)
        out += b"%d 0 obj%s\nendobj\n" % (num, compact(s).encode("latin-1"))
    where[9] = len(out)
    rows = b""
    for num in range(10):
        kind, a, b = (0, 0, 255) if num in (0, 7) else (1, where[num], 0) if num in where else (2, 8, inner.index(Ref(num, 0)))
        rows += bytes([kind]) + a.to_bytes(2, "big") + bytes([b])
    x = Stream({"Type": N("XRef"), "Size": 10, "W": [1, 2, 1], "Root": Ref(1, 0), "Info": Ref(6, 0), "Length": len(rows)}, rows)
    out += b"9 0 obj%s\nendobj\nstartxref\n%d\n%%%%EOF" % (compact(x).encode("latin-1"), where[9])
    return bytes(out)


def test_object_streams():
    doc = D.load(compressed())
    assert doc.complete, [str(e) for e in doc.errors]
    assert doc.has_objstm and doc.origin[Ref(3, 0)] == "objstm" and doc.special == {Ref(8, 0): "objstm", Ref(9, 0): "xrefstm"} and "in (8, 0) [at 0]" in R.xref_text(doc)
    s = R.stats(doc)
    assert s.error is None and s.known == 8 and "Contains object stream(s)" in s.text()


@pytest.mark.parametrize("options", [{}, {"reencode_streams": "FlateDecode"}, {"reencode_streams": "ASCIIHexDecode"}, {"merge_content_streams": True}, {"decode_streams": True}, {"simplify_info": True, "remove_ptex": True}])
def test_cleanup_is_idempotent(options):
    objects, trailer = fixtures.hello("x")
    objects[Ref(6, 0)].update({"PTEX.Fullbanner": b"tex", "Other": Ref(11, 0)})
    objects[Ref(11, 0)] = b"inlined"
    objects[Ref(12, 0)] = {"Unused": True}
    objects[Ref(13, 0)] = Stream({"Length": 3}, b"q Q")
    objects[Ref(3, 0)]["Contents"] = [Ref(4, 0), Ref(13, 0)]
    once = R.clean(D.load(W.write(objects, trailer), Options(**options)))
    assert R.clean(D.load(once, Options(**options))) == once
    doc = D.load(once)
    assert doc.complete and sorted(doc.objects) == [Ref(i, 0) for i in range(1, len(doc.objects) + 1)] and doc.trailer["Size"] == len(doc.objects) + 1
    assert b"Unused" not in once and (b"PTEX" not in once) == ("remove_ptex" in options)
    if options.get("merge_content_streams"):
        assert any(isinstance(s, Stream) and D.decode_stream(s, Place(), Options()).endswith(b"ET\nq Q") for s in doc.objects.values())


def test_reading_less():
    raw = fixtures.hello_file("x")
    doc = D.load(raw, only=D.STRUCTURE)
    assert doc.complete and not doc.objects and R.xref_text(doc) == R.xref_text(D.load(raw))
    assert list(D.load(compressed(), only=Ref(5, 0)).objects) == [Ref(8, 0), Ref(5, 0)]
    assert "undeclared" in str(D.load(raw, only=Ref(50, 0)).errors[0]) and "free object" in str(D.load(raw, only=Ref(0, 65535)).errors[0])


@pytest.mark.parametrize("tail", [b"", b"\n" * 3000, b"\r\n" * 500_000])
def test_any_number_of_line_ends_behind_the_end_mark(tail):
    doc = D.load(fixtures.hello_file("startxref") + tail)
    assert doc.complete and len(doc.objects) == 6
    assert "No startxref found" in str(D.load(fixtures.hello_file("x") + tail + b" ").errors[0])


@pytest.mark.parametrize("name", fixtures.VARIANTS)
def test_files_of_every_kind_are_read_or_rejected(name):
    damaged = {"wrong_offset", "long_length", "overlap", "duplicate_key", "no_startxref", "bad_version"}
    for text in ("", "a (b) \\ \u00fc\n" * 50):
        doc = D.load(fixtures.varied(name, text, 3), Options(user_password=fixtures.PASSWORD))
        assert doc.complete == (name not in damaged), doc.errors
        if doc.complete:
            assert doc.objects[Ref(6, 0)]["Title"] == text.encode() or "update" in name
            s = doc.objects[Ref(4, 0)]
            assert D.decode_stream(s, Place(), Options()).startswith(fixtures.hello(text)[0][Ref(4, 0)].raw)


def test_command_line(tmp_path, capsys):
    from quire.cli import main

    f, bad = tmp_path / "a.pdf", tmp_path / "b.pdf"
    f.write_bytes(fixtures.hello_file("x"))
    bad.write_bytes(b"%PDF-1.4\n")
    run = lambda *a: (main([str(x) for x in a]), capsys.readouterr().out)
    assert run("stats", f) == (0, CLEAN) and run("stats", bad)[0] == 2 and run("findref", "--num", 9, f) == (255, "Not found\n")
    assert run("findref", "--num", 5, f) == (0, "Found in object 3 at entry /Resources/Font/F1\nFound 1 occurrence(s) in 1 object(s).\n")
    assert run("trailer", f)[1].startswith("<<\n    /Info 6 0 R") and run("object", "--num", 6, f)[1].startswith("<<\n    /Title (text)") and run("types")[0] == 0
    assert run("cleanup", "--out", tmp_path / "c.pdf", f)[0] == 0 and D.load((tmp_path / "c.pdf").read_bytes()).complete
    assert run("extract", "--xref", tmp_path / "x", "--dot", tmp_path / "d", "--types", tmp_path / "t", f)[0] == 0 and "7 object(s) in total" in (tmp_path / "x").read_text()
    with pytest.raises(SystemExit):
        main(["stats", str(tmp_path / "none.pdf")])


def test_found_places_are_shown_and_highlighted(tmp_path, capsys):
    from quire.cli import main

    f = tmp_path / "a.pdf"
    f.write_bytes(fixtures.hello_file("x"))
    assert main(["findref", "--num", "3", "--show", "--highlight", str(f)]) == 0
    assert capsys.readouterr().out == "Found in object 2 at entry /Kids[0]\n<<\n    /Count 1\n    /Kids [\x1b[0;7m3 0 R\x1b[0m]\n    /Type /Pages\n>>\n\nFound 1 occurrence(s) in 1 object(s).\n"
    assert main(["findname", "--name", "Font", "--show", "--highlight", str(f)]) == 0
    out = capsys.readouterr().out
    assert "        \x1b[0;7m/Font\x1b[0m <<" in out and "/Type \x1b[0;7m/Font\x1b[0m" in out and out.endswith("Found 2 occurrence(s) in 2 object(s).\n")
    assert main(["findname", "--name", "Font", "--show", str(f)]) == 0 and "\x1b" not in capsys.readouterr().out
    assert main(["xref", "--debug", str(f)]) == 0 and "File version is : 1.5" in capsys.readouterr().err


def test_search_graph_and_layout():
    doc = D.load(fixtures.hello_file("x"))
    assert R.find(doc, Ref(2, 0)) == [(Ref(1, 0), "/Pages"), (Ref(3, 0), "/Parent")] and (Ref(5, 0), "/Type") in R.find(doc, "Font") and (Ref(3, 0), "/Resources\\Font") in R.find(doc, "Font")
    assert {(a, b) for a, b, _ in R.edges(doc)} >= {(Ref(1, 0), Ref(2, 0)), ("trailer", Ref(1, 0))} and R.closure(doc, doc.trailer) == set(doc.objects)
    assert "R_1 -> R_2;" in R.dot_text(doc) and "{from: 0, to: 6}" in R.visjs_text(doc)
    coloured = R.dot_text(doc, S.checked(doc))
    assert 'R_3 [label="3", color="red"];' in coloured and 'R_4 [label="4", color="blue"];' in coloured and 'R_1 [label="1"];' in coloured
    assert "Hole" not in R.layout_text(doc) and R.layout_text(doc).startswith("[0x0 -> 0x8 = 0x9 bytes] = version\n")
    assert D.overlap([(0, 5, 1), (6, 8, 2), (9, 10, 3)]) is None and D.overlap([(5, 10, 2), (0, 5, 1)]) == ((0, 5, 1), (5, 10, 2))


# --- types and the page language ---


def test_registry_text():
    reg = S.registry()
    assert len(reg.classes) == 115 and len(reg.aliases) == 57
    text = reg.dump()
    assert 'class catalog\n' in text and '\t/Pages : c"pageroot"\n' in text and 'alias intpositive :\n\t(int >= 1)\n' in text and "\t/Kids : (c\"pagenode\" | c\"page\")[]\n" in text
    with pytest.raises(ValueError, match="Undeclared"):
        S.Registry.read("class a : b\n")


@pytest.mark.parametrize("kind,good,bad", [
    ("bool", True, 1), ("int", 1, Real("1.")), ("true", True, False), ("1..", 1, 0), ("..-1", -1, 0), ("=3", 3, 4), ("={1 3}", 3, 2), ("/A", N("A"), N("B")), ("/{A B}", N("B"), N("C")),
    ("[int]", [1, 2], [1, b""]), ("[int]?", 1, b""), ("[int]2", [1, 2], [1]), ("[int]{0 2}", [], [1]), ("{int name}[]", [1, N("a")], [1]), ("{{int name}}", [1, N("a")], [1, N("a"), 1]),
    ("(int | name)", N("x"), b""), ("<int>", {"a": 1}, {"a": b""}), ("differences", [1, N("a"), N("b"), 3, N("c")], [1, N("a"), N("b"), 2, N("c")]), ("date", b"D:", N("D")), ("null", None, 0), ("any", {}, ...),
])
def test_type_rules(kind, good, bad):
    c = S.Checker(D.Document(b"", Options()), S.registry())
    k = S._Types(kind).kind()
    c.check(good, k, Place())
    if bad is not ...:
        with pytest.raises(PdfError):
            c.check(bad, k, Place())


def test_type_notation_and_intersection():
    k = S._Types("({{c:page /{FitB Fit}* a:number}} | [int]? | {int int}[] | ={1 2} | 0..5)").kind()
    assert k.text() == '({{c"page", (/Fit, /FitB)*, a"number"}} | int[?] | {int, int}[] | (int = 1 | 2) | (int >= 0 <= 5))'
    reg = S.registry()
    t = lambda s: S._Types(s).kind()
    assert reg.intersect(t("(int | name)"), t("(name | string)"), Place()) == t("name") and reg.intersect(t("any"), t("int"), Place()) == t("int")
    assert reg.intersect(t("[int]?"), t("[int]"), Place()) == t("[int]") and reg.intersect(t("[int]?"), t("int"), Place()) == t("int")
    with pytest.raises(PdfError, match="Inconsistent type inference between int and name"):
        reg.intersect(t("int"), t("name"), Place())


def test_page_language():
    assert len(P.SHAPE) == 71 and len(set(P.CATEGORY.values())) == 13
    ops = P.parse(b"q /a gs 1 2 m 3 4 l W* n BT /F 9 Tf [(a) -5 (b)] TJ ET BI /W 1 /H [1] ID \x00\xff EI /P <</M 1>> BDC EMC .5 1 0 scn Q")
    assert [o.name for o in ops] == ["q", "gs", "m", "l", "W*", "n", "BT", "Tf", "TJ", "ET", "BI", "BDC", "EMC", "scn", "Q"] and P.check(ops) == []
    assert P.resources(ops) == {"ExtGState": {"a"}, "Font": {"F"}}
    for bad, message in ((b"Q", "unbalanced"), (b"BT q ET", 'Unexpected command q in state "text"'), (b"ET", "Unexpected command ET"), (b"1 2 m BT", "Unexpected command BT"), (b"1 w 2", "Syntax"), (b"w", "Syntax"), (b"(a) w", "Syntax"), (b"foo", "unexpected word"), (b"BI ID x", "inline image"), (b"%c", "unexpected character in content stream : 0x25"), (b"0 0 d0", "Unexpected command d0")):
        with pytest.raises(PdfError, match=message):
            P.check(P.parse(bad))
    assert len(P.check(P.parse(b"q BT"))) == 2
    assert P.check(P.parse(b"0 0 d0 q Q"), type3=True) == []
    with pytest.raises(PdfError, match="Expected d0 or d1"):
        P.check(P.parse(b"q Q"), type3=True)


def test_outline_lists():
    def outline(*items):
        def change(o):
            o[Ref(1, 0)]["Outlines"] = Ref(20, 0)
            o[Ref(20, 0)] = {"First": Ref(21, 0), "Last": Ref(20 + len(items), 0)}
            for i, d in enumerate(items, 21):
                o[Ref(i, 0)] = {"Title": b"t", "Parent": Ref(20, 0)} | d

        return trees.check(built(change))

    a, b, c = {"Next": Ref(22, 0)}, {"Prev": Ref(21, 0), "Next": Ref(23, 0)}, {"Prev": Ref(22, 0)}
    assert outline(a, b, c) is None and outline({}) is None
    assert "Invalid previous element" in str(outline(a, {"Prev": Ref(23, 0), "Next": Ref(23, 0)}, c))
    assert "Cyclic tree structure" in str(outline(a, b | {"Next": Ref(21, 0)}, c)) and "Invalid parent" in str(outline(a, b | {"Parent": Ref(5, 0)}, c))
    assert "first element" in str(outline(a | {"Prev": Ref(22, 0)}, b, c)) and "last element" in str(outline(a, b, c | {"Next": Ref(21, 0)}))
