"""Token ids of texts, by a public tokenizer file.

Where the file says that the tokenizer never joins across white space, nor across the letters, digits and signs it splits
a word into, a text is split here into these parts and every distinct part of a task is encoded once; any other file
encodes texts whole. Defined cases: null and empty texts have no ids.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

END_ID = 1
#: The parts that a task remembers: at most so many, of at most so many characters each.
CACHED, CACHED_LENGTH = 400_000, 32

# The settings of a tokenizer file for which the parts of a text may be encoded one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Texts of ASCII and of the characters in this range are split here: NFC leaves them as they are. Those whose lower case is not one character of the range are left out.
FIRST, LAST = 0xA1, 0x24F
EVEN = "".join(chr(c) for c in range(FIRST, LAST + 1) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) <= LAST)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_words(settings: dict) -> bool:
    """Does a tokenizer with these settings (its file) split text as NORMALIZERS and SPLIT say, and drop white space?"""
    normal, before = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or [{}, {}]
    first, second = steps[0], steps[-1]
    split = first.get("type") == "Split" and first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed" and first.get("invert")
    return bool(normal.get("normalizers") == NORMALIZERS and len(steps) == 2 and split and second.get("type") == "ByteLevel" and not second.get("add_prefix_space") and not second.get("use_regex"))


def _class(kind: str) -> str:
    """The characters up to LAST of a Unicode category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(33, LAST + 1) if unicodedata.category(chr(c)).startswith(kind))


def _byte_letters() -> dict[int, str]:
    """For each character from 128 to LAST the letters that stand for its UTF-8 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, LAST + 1)}


class WordEncoder(dict):
    """Encodes texts; as a dict, the ids of the parts (and of the words that are not split) seen so far."""

    plain = re.compile(f"[\t-\r -~{EVEN}]*")
    parts = re.compile(f"[{_class('L')}]+|'(?:s|t|re|ve|m|ll|d)|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")
    letters = _byte_letters()

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_words(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model

    def __missing__(self, part: str) -> bytes:
        letters = part if part.isascii() else part.translate(self.letters)
        return self.keep(part, array("I", [t.id for t in self.model.tokenize(letters)]).tobytes())

    def keep(self, part: str, ids: bytes) -> bytes:
        if len(part) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[part] = ids
        return ids

    def splits(self, text: str) -> bool:
        return bool(self.plain.fullmatch(text)) and "<|" not in text

    def word(self, word: str) -> bytes:
        if self.splits(word):
            return b"".join(map(self.__getitem__, self.parts.findall(word.lower())))
        return self.get(word) or self.keep(word, self.whole(word))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        """A text's ids as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if not self.by_word:
            return self.whole(text.encode("utf-8", "replace").decode())
        if self.splits(text):
            return b"".join(map(self.__getitem__, self.parts.findall(text.lower())))
        return b"".join([self.word(w.decode()) for w in text.encode("utf-8", "replace").split()])
