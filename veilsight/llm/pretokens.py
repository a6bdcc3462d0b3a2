"""Splitting texts for the lower-casing word-end BPE tokenizer, so that each distinct piece is encoded once.

White space separates words in that tokenizer and is dropped, so a text's ids are the ids
of its white-space-free pieces in a row. A worker keeps the ids of pieces it has met.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable
from pathlib import Path

import numpy as np
import regex
import tokenizers

#: Entries of a worker's tables; when full they become the old ones, from which what is met again moves on.
KEPT_PIECES, KEPT_WORDS = 200_000, 300_000
#: White space for str.split() but not for the tokenizer.
ODD_SPACES = "[\x1c-\x1f]"
_ODD = regex.compile(ODD_SPACES)


def load(path: str) -> bytes:
    """The tokenizer file, read on the driver; a few MB, sent to the workers."""
    return Path(path).read_bytes()


class Pieces:
    """Ids of pieces, as little-endian unsigned 32-bit integers, and of whole texts."""

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], encode_text: Callable[[str], bytes], bpe: WordBpe):
        self.encode_words, self.encode_text, self.bpe, self.mark = encode_words, encode_text, bpe, bpe.mark
        self.of: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_of: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def texts(self, texts: list[str | None]) -> list[bytes]:
        cut = [None if t and (self.mark in t or _ODD.search(t)) else (t or "").split() for t in texts]
        if len(self.of) > KEPT_PIECES:
            self.of, self.old_of = {}, self.of
        if len(self.words) > KEPT_WORDS:
            self.words, self.old_words = {}, self.words
        self._learn({p for c in cut if c for p in c if p not in self.of})
        of = self.of
        return [self.encode_text(t) if c is None else b"".join([of[p] for p in c]) for t, c in zip(texts, cut, strict=True)]

    def _learn(self, pieces: set[str]) -> None:
        split: dict[str, list[str]] = {}
        odd: list[str] = []
        for piece in pieces:
            known = self.old_of.get(piece)
            if known is not None:
                self.of[piece] = known
                continue
            lower = self.bpe.normal(piece)
            if lower.isascii() or not unknown(piece) and unicodedata.is_normalized("NFC", lower):
                split[piece] = self.bpe.pattern.findall(lower)
            else:
                odd.append(piece)
        new = {w for ws in split.values() for w in ws if w not in self.words}
        again = {w for w in new if w in self.old_words}
        self.words.update((w, self.old_words[w]) for w in again)
        new = list(new - again)
        self.words.update(zip(new, self.encode_words(new), strict=True))
        words = self.words
        self.of.update((p, b"".join([words[w] for w in ws])) for p, ws in split.items())
        self.of.update((p, self.encode_text(p)) for p in odd)


def unknown(text: str) -> bool:
    """Whether a character may be of another Unicode version than Python's: unassigned here, or a mark beyond the first ones."""
    return not text.isascii() and any(c > "\u036f" and (unicodedata.combining(c) or unicodedata.category(c) == "Cn") for c in text)


class WordBpe:
    """What a tokenizer file of this kind says: vocabulary, ranked pairs, word pattern, special tokens."""

    def __init__(self, file: bytes):
        said = json.loads(file)
        self.vocabulary: dict[str, int] = dict(said["model"]["vocab"])
        self.end = said["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.tokens: list[str] = [""] * (max([*self.vocabulary.values(), *self.special.values()]) + 1)
        for token, k in [*self.vocabulary.items(), *self.special.items()]:
            self.tokens[k] = token
        self.pattern = regex.compile(said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in said["model"]["merges"]]
        self.library = tokenizers.Tokenizer.from_str(file.decode())
        self.mark = "<|" if all(t.startswith("<|") for t in self.special) else ""

    def normal(self, text: str) -> str:
        """NFC, then each character lower-cased by itself (no final sigma)."""
        if text.isascii():
            return text.lower()
        if unknown(text):
            return self.library.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, normal: str) -> list[str]:
        """Words of a normalised piece. Of characters that may be of another Unicode version the tokenizer's own engine says what they are."""
        if not unknown(normal):
            return self.pattern.findall(normal)
        return [_from_letters(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


_BYTE_OF = {c: b for b, c in enumerate(byte_letters())}


def _from_letters(word: str) -> str:
    return bytes(_BYTE_OF[c] for c in word).decode()


_BUILT: dict[tuple, Pieces] = {}


def kept(kind: str, file: bytes, build: Callable[[bytes], Pieces]) -> Pieces:
    """One instance per worker process and tokenizer."""
    key = kind, hashlib.sha256(file).digest()
    if key not in _BUILT:
        _BUILT[key] = build(file)
    return _BUILT[key]


def forget() -> None:
    """Free this worker's tables; they are built again when needed."""
    _BUILT.clear()


def ids_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")
