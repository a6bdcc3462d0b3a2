"""Byte-level BPE from a tokenizers file, run by tiktoken.

tests/llm hold its ids against the tokenizers library on every character and every token.
"""

from __future__ import annotations

import hashlib
import json

import tiktoken

from .pretokens import byte_letters

_BUILT: dict[bytes, tiktoken.Encoding] = {}


def pattern_of() -> str:
    """How byte-level pre-tokenizers split a text."""
    # fixed value: the pattern of this kind of tokenizer
    return r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(file: bytes, pattern: str) -> tiktoken.Encoding:
    """One instance per worker process and tokenizer. Tokens' ids are their ranks in such a file."""
    key = hashlib.sha256(file + pattern.encode()).digest()
    if key not in _BUILT:
        said = json.loads(file)
        if said["pre_tokenizer"].get("type") != "ByteLevel" or said["pre_tokenizer"].get("add_prefix_space") or said["normalizer"] is not None:
            raise ValueError("no plain byte-level tokenizer file")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes([byte_of[c] for c in token]): k for token, k in said["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in said["added_tokens"]}
        _BUILT[key] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _BUILT[key]
