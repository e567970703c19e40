"""Stream codecs on bytes: the five text and compression filters, PNG prediction, Adler-32."""

from __future__ import annotations

import re
import zlib
from typing import Any

import numpy as np

# Names of filters.
CODED = ("ASCIIHexDecode", "ASCII85Decode", "LZWDecode", "FlateDecode", "RunLengthDecode")
OPAQUE = ("CCITTFaxDecode", "JBIG2Decode", "DCTDecode", "JPXDecode", "Crypt")
_BLANK = bytes([0, 9, 10, 12, 13, 32])


class CodecError(ValueError):
    pass


def _need(ok: Any, why: str) -> None:
    if not ok:
        raise CodecError(why)


def hex_decode(b: bytes) -> bytes:
    b = b.translate(None, _BLANK)
    _need(b.endswith(b">"), "no end mark")
    digits = b[:-1]
    _need(re.fullmatch(rb"[0-9A-Fa-f]*", digits), "not a digit")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def hex_encode(b: bytes) -> bytes:
    return b.hex().upper().encode() + b">"


def a85_decode(b: bytes) -> bytes:
    b = b.translate(None, _BLANK)
    _need(b.endswith(b"~>"), "no end mark")
    body = b[:-2]
    if b"z" not in body and len(body) >= 5:
        whole = len(body) // 5 * 5
        return _a85_blocks(body[:whole]) + (_a85_slow(body[whole:]) if whole < len(body) else b"")
    return _a85_slow(body)


def _a85_blocks(body: bytes) -> bytes:
    digits = np.frombuffer(body, np.uint8).reshape(-1, 5).astype(np.int64) - 33
    _need(((digits >= 0) & (digits <= 84)).all(), "character out of range")
    values = digits @ np.array([85**4, 85**3, 85**2, 85, 1])
    _need((values < 1 << 32).all(), "block too large")
    return values.astype(">u4").tobytes()


def _a85_slow(body: bytes) -> bytes:
    out = bytearray()
    at = 0
    while at < len(body):
        if body[at] == 0x7A:
            out += bytes(4)
            at += 1
            continue
        block = body[at : at + 5]
        _need(len(block) > 1, "single character at the end")
        _need(all(33 <= c <= 117 for c in block), "character out of range")
        value = 0
        for c in block + b"u" * (5 - len(block)):
            value = value * 85 + c - 33
        _need(value < 1 << 32, "block too large")
        out += value.to_bytes(4, "big")[: len(block) - 1]
        at += 5
    return bytes(out)


def a85_encode(b: bytes) -> bytes:
    rest = len(b) % 4
    values = np.frombuffer(b + bytes(-len(b) % 4), ">u4").astype(np.int64)
    digits = np.stack([values // 85**k % 85 + 33 for k in (4, 3, 2, 1, 0)], axis=1).astype(np.uint8)
    whole = values[: len(b) // 4]
    tail = digits[len(whole) :].tobytes()[: rest + 1] if rest else b""
    if (whole == 0).any():
        body = b"".join(b"z" if v == 0 else d.tobytes() for v, d in zip(whole, digits))
    else:
        body = digits[: len(whole)].tobytes()
    return body + tail + b"~>"


def runlength_decode(b: bytes) -> bytes:
    out = bytearray()
    at = 0
    while True:
        _need(at < len(b), "no end mark")
        n = b[at]
        at += 1
        if n == 128:
            _need(at == len(b), "bytes after the end mark")
            return bytes(out)
        if n < 128:
            _need(at + n + 1 <= len(b), "literal run too short")
            out += b[at : at + n + 1]
            at += n + 1
        else:
            _need(at < len(b), "no byte to repeat")
            out += b[at : at + 1] * (257 - n)
            at += 1


def runlength_encode(b: bytes) -> bytes:
    """Literal runs of at most 128 bytes."""
    return b"".join(bytes([len(b[i : i + 128]) - 1]) + b[i : i + 128] for i in range(0, len(b), 128)) + b"\x80"


def _lzw_roots(b: bytes) -> bytes | None:
    """The bytes of a stream of single-byte codes that is cleared before codes grow wider than 9 bits; None if it isn't one."""
    n = len(b) * 8 // 9
    bits = np.unpackbits(np.frombuffer(b, np.uint8))
    codes = bits[: n * 9].reshape(n, 9) @ (1 << np.arange(8, -1, -1))
    ends = np.flatnonzero(codes == 257)
    if not len(ends) or len(bits) - 9 * (ends[0] + 1) > 7 or bits[9 * (ends[0] + 1) :].any():
        return None
    codes = codes[: ends[0]]
    cuts = np.flatnonzero(np.append(codes == 256, True))
    if (codes > 256).any() or (np.diff(np.append(-1, cuts)) > 254).any():
        return None
    return codes[codes < 256].astype(np.uint8).tobytes()


def lzw_decode(b: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; widths grow one code early."""
    if (plain := _lzw_roots(b)) is not None:
        return plain
    roots = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last = list(roots), 9, None
    out = bytearray()
    bits = have = at = 0
    while True:
        while have < width:
            _need(at < len(b), "no end code")
            bits = (bits << 8) | b[at]
            at += 1
            have += 8
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 257:
            _need(at == len(b) and bits == 0, "data after the end code")
            return bytes(out)
        if code == 256:
            table, width, last = list(roots), 9, None
            continue
        if last is None:
            _need(code < 256, "unknown code")
            word = table[code]
        else:
            _need(code <= len(table), "unknown code")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            _need(len(table) < 4094, "table overflow")
        out += word
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def lzw_encode(b: bytes) -> bytes:
    """One code of 9 bits per byte, cleared often enough that the width never grows."""
    codes: list[int] = []
    for i in range(0, len(b), 253):
        codes += [256, *b[i : i + 253]]
    codes.append(257)
    nine = (np.array(codes, np.uint16)[:, None] >> np.arange(8, -1, -1, dtype=np.uint16)) & 1
    return np.packbits(nine.astype(np.uint8).ravel()).tobytes()


def adler32(b: bytes) -> int:
    return zlib.adler32(b)


def flate_decode(b: bytes) -> bytes:
    """A zlib stream whose header, end and checksum are all checked."""
    _need(len(b) >= 6, "too short")
    _need((b[0] * 256 + b[1]) % 31 == 0, "header check")
    _need(b[0] & 15 == 8 and b[0] >> 4 <= 7 and not b[1] & 32, "method, window or dictionary")
    inflate = zlib.decompressobj(-15)
    try:
        out = inflate.decompress(b[2:-4]) + inflate.flush()
    except zlib.error as e:
        raise CodecError(str(e)) from None
    _need(inflate.eof and not inflate.unused_data, "no proper end")
    _need(zlib.adler32(out) == int.from_bytes(b[-4:], "big"), "checksum")
    return out


def flate_encode(b: bytes) -> bytes:
    return zlib.compress(b)


def png_predict(b: bytes, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Undo PNG row filters; each row has a filter byte before its ``columns * colors`` samples."""
    _need(bits == 8, "Not implemented filter predictor method")
    width = columns * colors
    _need(width > 0 and len(b) % (width + 1) == 0, "Invalid input size for PNG filter predictor")
    rows = np.frombuffer(b, np.uint8).reshape(-1, width + 1)
    out = np.zeros((len(rows) + 1, width), np.uint8)
    for r, row in enumerate(rows, 1):
        tag, cur, up = row[0], row[1:], out[r - 1]
        if tag == 0:
            out[r] = cur
        elif tag == 2:
            out[r] = cur + up
        elif tag == 1:
            for c in range(colors):
                out[r, c::colors] = np.cumsum(cur[c::colors], dtype=np.uint8)
        elif tag in (3, 4):
            line, above = bytearray(width), up.tolist()
            for i, x in enumerate(cur.tolist()):
                left = line[i - colors] if i >= colors else 0
                if tag == 3:
                    guess = (left + above[i]) // 2
                else:
                    corner = above[i - colors] if i >= colors else 0
                    p = left + above[i] - corner
                    guess = min((left, above[i], corner), key=lambda v: abs(p - v))
                line[i] = (x + guess) & 255
            out[r] = np.frombuffer(bytes(line), np.uint8)
        else:
            raise CodecError("Invalid PNG filter predictor method")
    return out[1:].tobytes()


def _predict(b: bytes, parms: dict[str, Any]) -> bytes:
    kind = parms.get("Predictor", 1)
    if kind == 1:
        return b
    if kind == 2:
        raise CodecError("Not implemented filter predictor method")
    _need(isinstance(kind, int) and 10 <= kind <= 15, "Invalid filter predictor method")
    sizes = [parms.get(k, d) for k, d in (("Columns", 1), ("Colors", 1), ("BitsPerComponent", 8))]
    _need(all(isinstance(x, int) and x > 0 for x in sizes), "Expected positive integer")
    return png_predict(b, *sizes)


_DECODERS = {"ASCIIHexDecode": hex_decode, "ASCII85Decode": a85_decode, "RunLengthDecode": runlength_decode, "LZWDecode": lzw_decode}
_ENCODERS = {"": bytes, "ASCIIHexDecode": hex_encode, "ASCII85Decode": a85_encode, "RunLengthDecode": runlength_encode, "LZWDecode": lzw_encode, "FlateDecode": flate_encode}
# How each filter's failure is reported.
_LABEL = {"ASCIIHexDecode": "ASCIIHex", "ASCII85Decode": "ASCII85", "RunLengthDecode": "RunLength", "LZWDecode": "LZW", "FlateDecode": "Flate/Zlib"}


def decode(b: bytes, name: str, parms: dict[str, Any] | None = None, warn: list[str] | None = None) -> bytes:
    """One filter undone; CodecError holds the message to report."""
    if name == "FlateDecode":
        try:
            out = flate_decode(b)
        except CodecError:
            try:
                _need(b.endswith(b"\n"), "")
                out = flate_decode(b[:-1])
            except CodecError:
                raise CodecError("Error in Flate/Zlib stream") from None
            if warn is not None:
                warn.append("Flate/Zlib stream with appended newline")
        return _predict(out, parms or {})
    if name in _DECODERS:
        try:
            return _DECODERS[name](b)
        except CodecError:
            raise CodecError(f"Error in {_LABEL[name]} stream") from None
    if name in OPAQUE:
        raise CodecError(f"Not implemented decoding of stream filter : {name}")
    raise CodecError(f"Invalid stream filter : {name}")


def encode(b: bytes, name: str) -> bytes:
    if name in _ENCODERS:
        return _ENCODERS[name](b)
    if name in OPAQUE:
        raise CodecError(f"Not implemented encoding of stream filter : {name}")
    raise CodecError(f"Invalid stream filter : {name}")


def decode_chain(b: bytes, filters: list[str], parms: list[dict[str, Any] | None] | None = None, warn: list[str] | None = None) -> bytes:
    """Filters undone from left to right."""
    parms = parms or [None] * len(filters)
    _need(len(parms) == len(filters), "Expected dictionary or array of dictionaries")
    for f, p in zip(filters, parms):
        b = decode(b, f, p, warn)
    return b
