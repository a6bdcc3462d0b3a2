"""BPE encoding with an index of pair occurrences, and decoding."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, map_rows
from .pretokens import Pieces, WordBpe, byte_letters, ids_of, kept, load


class Encoder:
    """Encodes many words at once: all of them lie in one row of symbols, cut at word ends."""

    def __init__(self, file: bytes):
        self.bpe = WordBpe(file)
        vocabulary, letters = self.bpe.vocabulary, byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.last = np.array([vocabulary[c + self.bpe.end] for c in letters], np.int64)
        self.left, self.right, self.made = ([], [], [])
        for a, b in self.bpe.pairs:
            self.left.append(vocabulary[a])
            self.right.append(vocabulary[b])
            self.made.append(vocabulary[a + b])
        codes = np.array(self.left, np.int64) << 20 | np.array(self.right, np.int64)
        self.rank = dict(zip(codes.tolist(), range(len(codes)), strict=True))
        self.by_code = np.argsort(codes)
        self.codes = codes[self.by_code]

    def occurrences(self, symbols: np.ndarray, cut: np.ndarray) -> dict[int, list[int]]:
        """The index: the rank of each pair that can merge, with all its positions in ascending order."""
        codes = symbols[:-1] << 20 | symbols[1:]
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at = np.flatnonzero((self.codes[place] == codes) & ~cut[:-1])
        ranks = self.by_code[place[at]]
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else np.array([], int)
        return {int(ranks[s]): part.tolist() for s, part in zip(starts, np.split(at, starts[1:]), strict=True)} if len(ranks) else {}

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Active ranks are applied in ascending order, each at all its positions from the left."""
        if not words:
            return []
        data = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        raw = np.frombuffer(b"".join(data), np.uint8)
        start = self.inner[raw]
        start[ends - 1] = self.last[raw[ends - 1]]
        cut = np.zeros(len(start), bool)
        cut[ends - 1] = True
        index = self.occurrences(start, cut)
        symbols = start.tolist()
        after = np.arange(1, len(start) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(start) - 1)
        before[np.r_[0, ends[:-1]]] = -1
        after, before = after.tolist(), before.tolist()
        active = list(index)
        heapq.heapify(active)
        get = self.rank.get
        while active:
            r = heapq.heappop(active)
            at = index.pop(r, None)
            if at is None:
                continue
            at.sort()
            a, b, new = self.left[r], self.right[r], self.made[r]
            for k, i in enumerate(at):
                j = after[i]
                if symbols[i] != a or j < 0 or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = new, -1
                after[i] = nxt = after[j]
                lower = False
                p = before[i]
                if p >= 0:
                    q = get(symbols[p] << 20 | new)
                    if q is not None:
                        if q in index:
                            index[q].append(p)
                        else:
                            index[q] = [p]
                            heapq.heappush(active, q)
                        lower = q < r
                if nxt >= 0:
                    before[nxt] = i
                    q = get(new << 20 | symbols[nxt])
                    if q is not None:
                        if q in index:
                            index[q].append(i)
                        else:
                            index[q] = [i]
                            heapq.heappush(active, q)
                        lower = lower or q < r
                if lower:  # a lower rank has become active and comes first
                    index[r] = at[k + 1 :]
                    heapq.heappush(active, r)
                    break
        left = np.array(symbols, np.int64)
        alive = left >= 0
        sizes = np.diff(np.r_[0, np.cumsum(alive)[ends - 1]])
        flat, stops = left[alive].astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
        return [flat[s:e] for s, e in zip([0, *stops[:-1]], stops, strict=True)]

    def text(self, text: str) -> bytes:
        """Ids of any text, special tokens in it included."""
        parts, out = [text], []
        for token in self.bpe.special:
            parts = [q for p in parts for q in (_between(p, token) if isinstance(p, str) else [p])]
            parts = [self.bpe.special[p[0]] if isinstance(p, tuple) else p for p in parts]
        for p in parts:
            out.append(np.array([p], "<u4").tobytes() if isinstance(p, int) else b"".join(self.words(self.bpe.split(self.bpe.normal(p)))))
        return b"".join(out)


def _between(text: str, token: str) -> list:
    parts: list = []
    for k, p in enumerate(text.split(token)):
        parts += [(token,), p] if k else [p]
    return parts


def _build(file: bytes) -> Pieces:
    encoder = Encoder(file)
    return Pieces(encoder.words, encoder.text, encoder.bpe)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: doc_id, ids (binary, little-endian unsigned 32-bit integers), decoded (string).

    `tokenizer` is the path of a lower-casing word-end BPE file, read on the driver. Ids are
    those of the tokenizers library without special tokens added; special tokens written in a
    text are found. decode(ids) of a file without a decoder is its tokens joined by a space.
    Null and empty texts give no ids. Repeated rows give a row each; other columns are not read.
    """
    file = docs.sparkSession.sparkContext.broadcast(load(tokenizer))

    def make(part: pa.RecordBatch) -> dict:
        pieces = kept("index", file.value, _build)
        ids = pieces.texts(part.column("text").to_pylist())
        return {"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.binary()), "decoded": [decode(i, pieces.bpe.tokens) for i in ids]}

    return map_rows(documents_of(docs), make, "doc_id long, ids binary, decoded string")


def decode(ids: bytes, tokens: list[str]) -> str:
    return " ".join([tokens[i] for i in ids_of(ids).tolist()])


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """encode() with doc_id, n_tokens, ids_sha256 and decoded_sha256 in place of ids and text."""
    out = encode(docs, tokenizer)
    return out.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

