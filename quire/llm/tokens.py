"""Token counts of whole texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from functools import cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_BLANK = 20_000
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = re.compile(f"[{_SPACE}]{{{LONG_BLANK}}}")


@cache
def _class(kind: str) -> str:
    """The characters of a Unicode major category as ranges of a character class."""
    out, start, last = [], None, None
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(chr(i))[0] == kind:
            if start is None:
                start = i
            last = i
        elif start is not None:
            out.append(f"{chr(start)}-{chr(last)}" if last > start else chr(start))
            start = None
    return "".join(out)


@cache
def splitter() -> re.Pattern[str]:
    """Pre-tokens of the vocabulary: contractions, words, numbers and other runs with the blank before them, blanks."""
    let, num = _class("L"), _class("N")
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{let}]+| ?[{num}]+| ?[^{_SPACE}{let}{num}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Counter:
    """Tokens of a text.

    The tokenizer's own expression can't cope with very long runs of blanks;
    texts that hold one are cut into pre-tokens here, with the same result.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        if len(text) >= LONG_BLANK and _BLANKS.search(text):
            return sum(len(self.piece.encode_ordinary(x)) for x in splitter().findall(text))
        return len(self.whole.encode_ordinary(text))


@cache
def counter(vocabulary: str = VOCABULARY) -> Counter:
    """One counter per worker process and vocabulary."""
    return Counter(vocabulary)
