"""Spelling variants: generated edits are looked up in Bloom filters of the vocabulary, hits are joined to it exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents_of, map_rows, ship_code, written
from .wordhash import mix

#: All letters are of one byte in Latin-1, so words are rows of bytes.
LETTERS = "A-Za-zÀ-ÿ"
LETTER, LEAST, SEEN, FACTOR, SLIP = f"[{LETTERS.replace('A-Z', '')}]", 6, 5, 5, 199
#: Words of this length and longer share one filter.
LONG = 64
#: A block of a filter has 512 bits; a word sets BITS of them, and a block is made for every 32 words.
WORDS_A_BLOCK, BITS = 32, 7
#: Blocks of a segment, which one task builds; bytes of filters that are broadcast at once.
SEGMENT, ROUND_BYTES = 1024, 64 << 20
#: Edits probed at once.
PROBES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SIGN = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def vocabulary(docs: DataFrame, least: int = LEAST, seen: int = SEEN, slip: int = SLIP) -> DataFrame:
    """(word, n): runs of letters in lower case, of at least `least` letters and `seen` occurrences.

    Where `slip` divides the crc32 of `<doc_id>:<run>`, the run has lost one letter (0: never).
    A null doc_id is written as nothing.
    """
    own = documents_of(docs)
    # a shorter run can't become long enough, and a greedy match of so many letters is a whole run
    runs = own.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"{LETTER}{{{least},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if slip:
        code = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
        lost = F.overlay("run", F.lit(""), (F.pmod(F.col("code"), F.length("run")) + 1).cast("int"), F.lit(1))
        runs = runs.withColumn("code", code)
        word = F.when(F.col("code") % slip == 0, lost).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= seen)


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _P, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length each time: which they are, and their letters as a matrix of at most PROBES bytes (or one row)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == size)
        step = max(1, PROBES // size)
        for at in range(0, len(which), step):
            some = which[at : at + step]
            yield some, np.frombuffer("".join([words[i] for i in some]).encode("latin-1"), np.uint8).reshape(len(some), size)


def hashes(letters: np.ndarray) -> np.ndarray:
    """A sum over places, so that those of edits follow from it. Not mixed yet."""
    return (_SIGN[letters] * powers(letters.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


class Layout:
    """Where the filter of each length begins in the row of all blocks. Made of the numbers of words by length."""

    def __init__(self, counts: dict[int, int]):
        self.first, at = {}, 0
        self.blocks = {}
        for size in sorted(counts):
            self.first[size], self.blocks[size] = at, -(-counts[size] // WORDS_A_BLOCK)
            at += self.blocks[size]
        self.total = at

    def block(self, h: np.ndarray, size: int) -> np.ndarray | None:
        """The block of each word of this length; none where there are no such words."""
        size = min(size, LONG)
        if size not in self.blocks:
            return None
        return ((h >> np.uint64(32)) * np.uint64(self.blocks[size]) >> np.uint64(32)).astype(np.int64) + self.first[size]

    def lengths(self, low: int, high: int) -> list[int]:
        """Lengths that have a block from `low` to before `high`."""
        return [s for s, at in self.first.items() if at < high and at + self.blocks[s] > low]


def bits(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th bit in a block."""
    return (h >> np.uint64(9 * k) & np.uint64(511)).astype(np.int64)


def second(h: np.ndarray) -> np.ndarray:
    return mix(h ^ np.uint64(0xA0761D6478BD642F))


def filters(words: DataFrame, layout: Layout) -> DataFrame:
    """(segment, bits): blocked Bloom filters of all lengths, cut into segments that one task each builds of its words."""
    def place(part: pa.RecordBatch) -> dict:
        words = part.column("word").to_pylist()
        block, own = np.empty(len(words), np.int64), np.empty(len(words), np.uint64)
        for which, letters in by_length(words):
            h = mix(hashes(letters))
            block[which], own[which] = layout.block(h, letters.shape[1]), second(h)
        return {"segment": block // SEGMENT, "block": block % SEGMENT, "h": own.view(np.int64)}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, held = None, np.zeros(SEGMENT * 8, np.uint64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            segments, blocks, h = (batch.column(n).to_numpy() for n in ("segment", "block", "h"))
            starts = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]]) if len(segments) else []
            for a, b in zip(starts, [*starts[1:], len(segments)], strict=True):
                if segments[a] != segment:
                    if segment is not None:
                        yield row()
                        held[:] = 0
                    segment = int(segments[a])
                for k in range(BITS):
                    bit = bits(h[a:b].view(np.uint64), k)
                    np.bitwise_or.at(held, blocks[a:b] * 8 + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        if segment is not None:
            yield row()

    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = map_rows(words.select("word"), place, "segment long, block long, h long", "word")
    return placed.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(build, "segment long, bits binary")


class Probe:
    """A stretch of the filters' blocks, from `low` to before `high`."""

    def __init__(self, layout: Layout, low: int, high: int, data: np.ndarray):
        self.layout, self.low, self.high, self.data = layout, low, high, data

    def hits(self, raw: np.ndarray, size: int) -> np.ndarray:
        """Which edits of a length may be words, by their hashes before mixing. One bit after another, for those that passed the last."""
        h = mix(raw)
        block = self.layout.block(h, size)
        if block is None:
            return np.empty(0, np.int64)
        at = np.flatnonzero((block >= self.low) & (block < self.high))
        block, h = (block[at] - self.low) * 8, second(h[at])
        for k in range(BITS):
            bit = bits(h, k)
            ok = self.data[block + (bit >> 6)] >> (bit & 63).astype(np.uint64) & np.uint64(1) != 0
            at, block, h = at[ok], block[ok], h[ok]
        return at


def edits(letters: np.ndarray, alphabet: np.ndarray, probe: Probe) -> Iterator[tuple[int, bytes]]:
    """Row and edited word of what may be a word: with one letter less, or one replaced by a later one.

    Words that differ by an insertion or by an earlier letter find this one. Of equal
    neighbouring letters only the first is left out, so no edit comes twice.
    """
    rows, size = letters.shape
    power = powers(size)
    value = _SIGN[letters] * power[:-1]
    before = np.cumsum(value, axis=1, dtype=np.uint64)
    whole = before[:, -1]
    first = np.ones(letters.shape, bool)
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    row, place = np.nonzero(first)
    shorter = before[row, place] - value[row, place] + (whole[row] - before[row, place]) * _PI
    for k in probe.hits(shorter, size - 1).tolist():
        word, i = letters[row[k]].tobytes(), int(place[k])
        yield int(row[k]), word[:i] + word[i + 1 :]
    for sign in alphabet.tolist():
        row, place = np.nonzero(letters < sign)
        other = whole[row] + (_SIGN[sign] - _SIGN[letters[row, place]]) * power[place]
        for k in probe.hits(other, size).tolist():
            word, i = letters[row[k]].tobytes(), int(place[k])
            yield int(row[k]), word[:i] + bytes([sign]) + word[i + 1 :]


def near_pairs(words: DataFrame) -> DataFrame:
    """words(word, n) of letters, each word once -> (a, a_n, b, b_n): all pairs that differ by one letter, once each.

    The filters take two bytes a word. ROUND_BYTES of them are broadcast at a time, and in
    such a round only words whose edits have the lengths of these filters are mapped; so
    no broadcast grows with the vocabulary. Only edits that pass are shuffled, to an exact join.
    """
    spark = words.sparkSession
    ship_code(spark)
    length = F.least(F.length("word"), F.lit(LONG))
    counts = {r.size: r.n for r in words.groupBy(length.alias("size")).agg(F.count("*").alias("n")).collect()}  # LONG rows
    alphabet = words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()  # 90 letters
    alphabet = np.array(sorted(ord(r.c) for r in alphabet if r.c), np.int64)
    layout = Layout(counts)
    built = written(filters(words, layout), "filters")
    step = max(1, ROUND_BYTES // 64 // SEGMENT) * SEGMENT
    found = []
    for low in range(0, layout.total, step):
        high = min(low + step, layout.total)
        part = built.filter(F.col("segment").between(low // SEGMENT, (high - 1) // SEGMENT)).collect()  # ROUND_BYTES
        data = np.zeros((-(-(high - low) // SEGMENT)) * SEGMENT * 8, np.uint64)
        for r in part:
            at = (r.segment * SEGMENT - low) * 8
            data[at : at + SEGMENT * 8] = np.frombuffer(r.bits, np.uint64)
        sent = spark.sparkContext.broadcast(Probe(layout, low, high, data))
        sizes = layout.lengths(low, high)
        # an edit is as long as its word, or one letter shorter
        at_hand = words.filter(length.isin(sizes) | F.least(F.length("word") - 1, F.lit(LONG)).isin(sizes))

        def probed(batch: pa.RecordBatch, sent=sent) -> dict:
            own, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            a, a_n, b = [], [], []
            for which, letters in by_length(own):
                for row, other in edits(letters, alphabet, sent.value):
                    a.append(own[which[row]])
                    a_n.append(n[which[row]])
                    b.append(other.decode("latin-1"))
            return {"a": pa.array(a, pa.string()), "a_n": pa.array(a_n, pa.int64()), "b": pa.array(b, pa.string())}

        found.append(map_rows(at_hand.select("word", "n"), probed, "a string, a_n long, b string", "word"))
    if not found:
        return words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("word").alias("b"), F.col("n").alias("b_n")).limit(0)
    maybe = found[0]
    for f in found[1:]:
        maybe = maybe.unionByName(f)
    return maybe.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame, most: int, factor: int = FACTOR, seen: int = SEEN) -> DataFrame:
    """forms(word, form) -> (word, root). A form occurs `factor` times as often as its word, so `most` bounds the steps."""
    hops = max(1, math.ceil(math.log(max(most, 2) / seen, factor)) + 1) if most > seen else 1
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(hops))):  # each round doubles the steps made
        on = out.select(F.col("word").alias("via"), F.col("root").alias("next"))
        out = written(out.join(on, out["root"] == on["via"], "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return out


def grouped(words: DataFrame, factor: int = FACTOR, seen: int = SEEN) -> DataFrame:
    """words(word, n) -> one row per word: word, form, root, n, n_near, form_n.

    Words are near if they differ by exactly one inserted, deleted or replaced letter. The
    form is the near word of largest n (of equal ones the first in code-point order) if it
    occurs `factor` times as often as the word, else null; the root is what forms lead to.
    """
    words = written(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words)
    both = written(pairs, "near")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word")))
    near = both.groupBy(F.col("a").alias("w")).agg(F.count("*").alias("n_near"), best.alias("best"), F.first("a_n").alias("own"))
    often: Column = -F.col("best.less") >= factor * F.col("own")
    near = near.select("w", "n_near", F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))
    near = written(near, "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(near.filter("form is not null").select(F.col("w").alias("word"), "form"), most, factor, seen)
    out = words.join(near, F.col("word") == F.col("w"), "left").join(ends.withColumnRenamed("word", "v"), F.col("word") == F.col("v"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The vocabulary of `docs` with the form and root of each word; see vocabulary() and grouped().

    Null and empty texts have no words. Repeated rows count each. Other columns are not read.
    A text of one very long run is one word. An empty table gives no rows.
    """
    return grouped(vocabulary(docs))
