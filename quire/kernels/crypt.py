"""The standard security handler: key derivation, RC4 and AES-CBC decryption."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from functools import cache
from typing import Any

import numpy as np

from quire.kernels.model import Name, PdfError, Place, Ref

# The password padding of the file format, and the suffix of AES keys.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
SALT = b"sAlT"


def rc4(key: bytes, data: bytes) -> bytes:
    box = list(range(256))
    j = 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out = bytearray()
    i = j = 0
    for c in data:
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out.append(c ^ box[(box[i] + box[j]) & 255])
    return bytes(out)


def _double(a: int) -> int:
    return ((a << 1) ^ (0x11B if a & 0x80 else 0)) & 0xFF


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = _double(a), b >> 1
    return out


def _boxes() -> tuple[bytes, bytes]:
    """The byte substitution and its inverse, from inverses in GF(256)."""
    forward = bytearray(256)
    for a in range(256):
        inv = next((b for b in range(256) if _times(a, b) == 1), 0)
        x = inv
        for k in range(1, 5):
            x ^= ((inv << k) | (inv >> (8 - k))) & 255
        forward[a] = x ^ 0x63
    backward = bytearray(256)
    for a, b in enumerate(forward):
        backward[b] = a
    return bytes(forward), bytes(backward)


_SBOX, _UNSBOX = _boxes()
_MULT = {k: np.array([_times(a, k) for a in range(256)], np.uint8) for k in (2, 3, 9, 11, 13, 14)}


def _schedule(key: bytes) -> list[bytes]:
    words = [key[i : i + 4] for i in range(0, 16, 4)]
    rcon = 1
    for i in range(4, 44):
        w = words[-1]
        if i % 4 == 0:
            w = bytes(_SBOX[b] for b in w[1:] + w[:1])
            w = bytes([w[0] ^ rcon]) + w[1:]
            rcon = _double(rcon)
        words.append(bytes(a ^ b for a, b in zip(words[i - 4], w)))
    return [b"".join(words[i : i + 4]) for i in range(0, 44, 4)]


_UNSHIFT = np.array([(4 * ((i // 4 - i % 4) % 4)) + i % 4 for i in range(16)])
_BACKWARD = np.frombuffer(_UNSBOX, np.uint8)


def _mixed(s: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    """Every column of each block times the circulant matrix of ``factors``."""
    cols = s.reshape(-1, 4, 4)
    out = np.zeros_like(cols)
    for k, f in enumerate(factors):
        out ^= _MULT[f][np.roll(cols, -k, axis=2)]
    return out.reshape(-1, 16)


def _unblocks(rounds: np.ndarray, s: np.ndarray) -> np.ndarray:
    """All blocks decrypted side by side."""
    s = s ^ rounds[10]
    for r in range(9, -1, -1):
        s = _BACKWARD[s[:, _UNSHIFT]] ^ rounds[r]
        if r:
            s = _mixed(s, (14, 11, 13, 9))
    return s


def _rounds(key: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(_schedule(key)), np.uint8).reshape(11, 16)


def aes_cbc(key: bytes, data: bytes) -> bytes:
    """AES-128 in CBC mode; the first block is the IV, the end is padded as in PKCS#5."""
    if len(data) % 16:
        raise PdfError("Expected a multiple of 16 bytes for encrypted data in AES-CBC mode")
    if len(data) < 32:
        raise PdfError("Expected at least two blocks for encrypted data in AES-CBC mode")
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    out = (_unblocks(_rounds(key), blocks[1:]) ^ blocks[:-1]).tobytes()
    pad = out[-1]
    if not 1 <= pad <= 16 or out[-pad:] != bytes([pad]) * pad:
        raise PdfError("Invalid PKCS#5 padding for encrypted data in AES-CBC mode")
    return out[:-pad]


@cache
def _columns() -> tuple[list[int], ...]:
    """For a byte in each row of a column: what substitution and mixing make of it, as a word."""
    first = [int.from_bytes((_MULT[2][x], x, x, _MULT[3][x]), "big") for x in map(int, _SBOX)]
    return first, *[[(w >> 8 * k) | (w << 32 - 8 * k) & 0xFFFFFFFF for w in first] for k in (1, 2, 3)]


def aes_cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    """The inverse of ``aes_cbc``; each block needs the one before, so words and tables are quicker here than arrays."""
    pad = 16 - len(data) % 16
    data += bytes([pad]) * pad
    t0, t1, t2, t3 = _columns()
    rounds = [struct.unpack(">4I", k) for k in _schedule(key)]
    out = [iv]
    last = struct.unpack(">4I", iv)
    for block in struct.iter_unpack(">4I", data):
        w = [x ^ y ^ k for x, y, k in zip(block, last, rounds[0])]
        for k in rounds[1:10]:
            w = [t0[w[j] >> 24] ^ t1[w[j - 3] >> 16 & 255] ^ t2[w[j - 2] >> 8 & 255] ^ t3[w[j - 1] & 255] ^ k[j] for j in range(4)]
        last = [(_SBOX[w[j] >> 24] << 24 | _SBOX[w[j - 3] >> 16 & 255] << 16 | _SBOX[w[j - 2] >> 8 & 255] << 8 | _SBOX[w[j - 1] & 255]) ^ rounds[10][j] for j in range(4)]
        out.append(struct.pack(">4I", *last))
    return b"".join(out)


@dataclass
class Handler:
    """What an /Encrypt dictionary and the passwords give."""

    version: int
    revision: int
    key: bytes
    streams: str  # "rc4", "aes" or "none"
    strings: str
    metadata: bool
    user_ok: bool
    owner_ok: bool

    def decrypt(self, ref: Ref, data: bytes, strings: bool = False) -> bytes:
        how = self.strings if strings else self.streams
        if how == "none":
            return data
        key = self._key(ref, how)
        return rc4(key, data) if how == "rc4" else aes_cbc(key, data)

    def encrypt(self, ref: Ref, data: bytes, strings: bool = False, iv: bytes = bytes(16)) -> bytes:
        how = self.strings if strings else self.streams
        return aes_cbc_encrypt(self._key(ref, how), data, iv) if how == "aes" else self.decrypt(ref, data, strings)

    def _key(self, ref: Ref, how: str) -> bytes:
        salt = ref.num.to_bytes(4, "little")[:3] + ref.gen.to_bytes(4, "little")[:2] + (SALT if how == "aes" else b"")
        return hashlib.md5(self.key + salt).digest()[: min(len(self.key) + 5, 16)]


def _padded(password: bytes) -> bytes:
    return (password + PAD)[:32]


def _file_key(password: bytes, d: dict[str, Any], first_id: bytes, bits: int, revision: int, metadata: bool) -> bytes:
    h = hashlib.md5(_padded(password) + d["O"] + (d["P"] & 0xFFFFFFFF).to_bytes(4, "little") + first_id)
    if revision >= 4 and not metadata:
        h.update(b"\xff" * 4)
    out = h.digest()
    n = bits // 8
    if revision >= 3:
        for _ in range(50):
            out = hashlib.md5(out[:n]).digest()
    return out[:n]


def _user_mark(key: bytes, first_id: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PAD)
    out = rc4(key, hashlib.md5(PAD + first_id).digest())
    for i in range(1, 20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out


def _user_of_owner(password: bytes, d: dict[str, Any], bits: int, revision: int) -> bytes:
    h = hashlib.md5(_padded(password)).digest()
    n = bits // 8
    if revision >= 3:
        for _ in range(50):
            h = hashlib.md5(h).digest()
    key, out = h[:n], d["O"]
    for i in range(19 if revision >= 3 else 0, -1, -1):
        out = rc4(bytes(b ^ i for b in key), out)
    return out


def _get(d: dict[str, Any], key: str, kind: type, message: str, default: Any = None) -> Any:
    v = d.get(key, default)
    if not isinstance(v, kind) or (kind is int and isinstance(v, bool)):
        raise PdfError(message, Place(path=f"/{key}"))
    return v


def _method(d: dict[str, Any], which: str) -> str:
    name = _get(d, which, Name, "Expected name", Name("Identity"))
    if name == "Identity":
        return "none"
    filters = _get(d, "CF", dict, "Expected dictionary")
    f = _get(filters, name, dict, "Expected dictionary")
    how = {"None": "none", "V2": "rc4", "AESV2": "aes"}.get(_get(f, "CFM", Name, "Expected name", Name("None")))
    if how is None:
        raise PdfError("Invalid encryption algorithm")
    return how


def handler(d: dict[str, Any], first_id: bytes, user: bytes = b"", owner: bytes = b"") -> Handler:
    """From a dereferenced /Encrypt dictionary; PdfError if it isn't supported or no password fits."""
    if _get(d, "Filter", Name, "Expected name") != "Standard":
        raise PdfError("Only /Standard encryption filter is supported")
    version = _get(d, "V", int, "Expected integer", 0)
    if version not in (1, 2, 4):
        raise PdfError("Only encryption algorithms 1, 2 and 4 are supported")
    bits = _get(d, "Length", int, "Expected integer", 40)
    if bits % 8 or not 40 <= bits <= 128:
        raise PdfError("Encryption key length must be a multiple of 8 in range [40, 128]")
    revision = _get(d, "R", int, "Expected integer")
    if not 2 <= revision <= 4:
        raise PdfError("Only revisions 2-4 of encryption standard security handler are supported")
    if len(_get(d, "O", bytes, "Expected string")) != 32:
        raise PdfError("Owner string must be 32 bytes")
    if len(_get(d, "U", bytes, "Expected string")) != 32:
        raise PdfError("User string must be 32 bytes")
    _get(d, "P", int, "Expected integer")
    metadata = _get(d, "EncryptMetadata", bool, "Expected boolean", True)
    streams, strings = (_method(d, "StmF"), _method(d, "StrF")) if version == 4 else ("rc4", "rc4")

    def key_of(password: bytes) -> tuple[bytes, bool]:
        key = _file_key(password, d, first_id, bits, revision, metadata)
        mark = _user_mark(key, first_id, revision)
        return key, d["U"][: len(mark)] == mark

    key, user_ok = key_of(user)
    owner_key, owner_ok = key_of(_user_of_owner(owner, d, bits, revision))
    if not user_ok and not owner_ok:
        raise PdfError("Invalid user and owner passwords for encrypted document")
    return Handler(version, revision, key if user_ok else owner_key, streams, strings, metadata, user_ok, owner_ok)
