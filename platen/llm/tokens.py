"""Token ids of whole texts by a public tokenizer, word by word with a bounded memory of words."""

from __future__ import annotations

import re
import struct

import regex

#: The pre-tokenizer of the byte-level vocabularies, with white space as Unicode has it.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# The letters, digits and white space among the characters below U+0250, and the general punctuation.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = "0-9²³¹¼½¾"
_SPACE = "\t-\r \x85\xa0"
_UNCOMMON = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
# The same pattern for texts without other characters, in the faster engine.
_COMMON = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def words(text: str) -> list[str]:
    return (WORDS if _UNCOMMON.search(text) else _COMMON).findall(text)


class WordMemory(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers. Forgets all when full, so its memory is bounded."""

    def __init__(self, encode, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.encode, self.most, self.longest = encode, most, longest

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = packed
        return packed

    def ids_of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, words(text)))


def byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: itself if it is visible, else the next free one from 256 on."""
    visible = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def tokenizer_memory(path: str) -> WordMemory:
    """A memory for a byte-level tokenizer file; a word that isn't in it goes to the tokenizer's model alone."""
    from tokenizers import Tokenizer

    letters, model = byte_letters(), Tokenizer.from_file(path).model
    return WordMemory(lambda word: [t.id for t in model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))])
