"""Token ids in binary files: each document compressed by itself with a shared zstandard dictionary.

A token file is a table of blocks in Parquet, so that Spark's commit protocol covers lost
executors and repeated tasks. A block's bytes are

    magic b"VTOK", version u16, dictionary hash (32 bytes, SHA-256), documents u32,
    offset index: documents + 1 of u64 (from the first frame; the last is the end),
    frames: one zstandard frame for each document, of its ids as little-endian u32.

Beside it lie the documents of each block: doc_id, start and n_tokens in order, and the
dictionary. A short document is read by one frame.
"""

from __future__ import annotations

import hashlib
import os
import struct
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import documents_of, map_rows, ship_code, written
from .pretokens import ODD_SPACES, WordBpe, byte_letters, forget, kept, load, unknown

MAGIC, VERSION = b"VTOK", 1
#: Pieces a worker knows, of so many bytes at most; when they are more, those not met since the last time go.
KEPT_PIECES, KEPT_BYTES = 400_000, 100
#: Bytes of texts whose pieces are told apart at once; a longer text comes alone.
TEXT_BYTES = 6 << 20
HEADER = struct.Struct("<4sH32sI")
END_ID, LEVEL = 2, 3
#: The dictionary is trained on the ids of at most so many documents, those with the smallest hashes of their ids, of at most so many characters.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, DICTIONARY_BYTES = 1_000, 20_000, 64 << 10
#: Frames of a block; a longer frame is a block of its own. Less than what the JVM's collector takes for a huge array.
BLOCK_BYTES = 1 << 18
#: Bytes of ids that a reader decompresses at once; a longer document comes alone.
READ_BYTES = 2 << 20
#: Row groups of a file: no reader holds more than one and a task's split.
GROUP_BYTES = 2 << 20
#: Files of a table: one for so many compressed bytes, and no more than so many.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 10_000


def _in_a_row(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of `values`, one behind the other."""
    at = np.repeat(starts - np.cumsum(sizes, dtype=np.int64) + sizes, sizes)
    at += np.arange(len(at))
    return values[at]


class LibraryPieces:
    """The tokenizers library, which gets each distinct piece (a run without white space) of some texts once.

    Arrow cuts the texts and tells their pieces apart; Python sees pieces that are not known.
    Of those the words go to the library in rows of many, already normalised and in the letters
    that stand for bytes, so that it cuts at blanks alone; its ids are cut again at those that
    end a word. What is known lies in a column of pieces and one of ids.
    """

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.bpe = WordBpe(file)
        self.library, self.mark = self.bpe.library, self.bpe.mark
        self.words = tokenizers.Tokenizer(self.library.model)  # the same model, without normaliser and special tokens
        self.words.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for b, c in enumerate(byte_letters()) if b != 32}
        self.ends = np.array([t.endswith(self.bpe.end) for t in self.bpe.tokens])
        self.known, self.met = pa.array([], pa.string()), np.empty(0, bool)
        self.ids, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int32)

    def texts(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        odd = pc.or_(pc.match_substring(texts, self.mark), pc.match_substring_regex(texts, ODD_SPACES))
        cut = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = cut.values.dictionary_encode()
        of, sizes = self._ids_of(coded.dictionary)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        word = coded.indices.to_numpy()
        bounds = (np.r_[0, np.cumsum(sizes[word], dtype=np.int64)][cut.offsets.to_numpy()] * 4).tolist()
        flat = _in_a_row(of, starts[word], sizes[word]).tobytes()
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self._whole([texts[k].as_py()])[0]
        return out

    def _ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces in a row, and how many each has; new short ones are known from now on."""
        if len(self.known) > KEPT_PIECES:
            self.ids = self.ids[np.repeat(self.met, self.sizes)]
            self.known, self.sizes = self.known.filter(pa.array(self.met)), self.sizes[self.met]
            self.met = np.zeros(len(self.known), bool)
        place = pc.index_in(pieces, value_set=self.known)
        new = np.asarray(place.is_null())
        fresh = pieces.filter(pa.array(new))
        learned = self._learn(fresh.to_pylist())
        at = np.empty(len(pieces), np.int64)
        old = pc.drop_null(place).to_numpy()
        at[~new], at[new] = old, len(self.known) + np.arange(len(learned))
        self.met[old] = True
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(learned), "<u4")])
        all_sizes = np.concatenate([self.sizes, np.fromiter(map(len, learned), np.int32, len(learned)) // 4]).astype(np.int32)
        starts, sizes = (np.cumsum(all_sizes, dtype=np.int64) - all_sizes)[at], all_sizes[at]
        of = _in_a_row(ids, starts, sizes)
        short = np.asarray(pc.less_equal(pc.binary_length(fresh), KEPT_BYTES))
        keep = np.r_[np.ones(len(self.known), bool), short]
        self.ids, self.sizes = ids[np.repeat(keep, all_sizes)], all_sizes[keep]
        self.known = pa.concat_arrays([self.known, fresh.filter(pa.array(short))])
        self.met = np.r_[self.met, np.ones(int(short.sum()), bool)]
        return of, sizes

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        return list(chain.from_iterable(self._row(pieces[at : at + 2000]) for at in range(0, len(pieces), 2000)))

    def _row(self, pieces: list[str]) -> list[bytes]:
        row = " ".join(pieces)
        if unknown("".join(set(row))) or not unicodedata.is_normalized("NFC", lower := self.bpe.normal(row)):
            if len(pieces) == 1:
                return self._whole(pieces)
            strange = [not p.isascii() and (unknown(p) or not unicodedata.is_normalized("NFC", self.bpe.normal(p))) for p in pieces]
            plain = iter(self._row(some) if (some := [p for p, s in zip(pieces, strange, strict=True) if not s]) and any(strange) else self._whole(some))
            whole = iter(self._whole([p for p, s in zip(pieces, strange, strict=True) if s]))
            return [next(whole if s else plain) for s in strange]
        words = [[p] if p.isalpha() else self.bpe.pattern.findall(p) for p in lower.split(" ")]
        n = np.fromiter(map(len, words), np.int64, len(words))
        text = " ".join(chain.from_iterable(words))
        if not (text.isascii() and text.isprintable()):
            text = text.encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stops = np.r_[0, np.flatnonzero(self.ends[ids]) + 1]
        if len(n) != len(pieces) or len(stops) != n.sum() + 1:  # the library sees other words in one of them
            return self._whole(pieces)
        data, bounds = ids.tobytes(), (stops[np.r_[0, np.cumsum(n)]] * 4).tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _ids(file: bytes, texts: list[str | None] | pa.Array) -> list[bytes]:
    end = struct.pack("<I", END_ID)
    return [x + end for x in kept("library", file, LibraryPieces).texts(texts)]


def train_dictionary(docs: DataFrame, file: bytes) -> bytes:
    """Trained on serialized id arrays of a bounded sample; empty if there are too few."""
    short = documents_of(docs).filter(F.length("text") <= SAMPLE_CHARS)
    ids = short.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS).distinct()
    rows = short.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("text").collect()  # SAMPLE_DOCUMENTS short texts
    samples = _ids(file, [r.text for r in rows])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def pack(frames: list[bytes], dictionary: bytes) -> bytes:
    offsets = np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes()
    return HEADER.pack(MAGIC, VERSION, hashlib.sha256(dictionary).digest(), len(frames)) + offsets + b"".join(frames)


def index(block: bytes, dictionary: bytes) -> tuple[np.ndarray, int]:
    """Offsets of a block's frames, and where the frames begin. Another dictionary is refused."""
    magic, version, digest, n = HEADER.unpack_from(block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("no token block of this version")
    if digest != hashlib.sha256(dictionary).digest():
        raise ValueError("the block was written with another dictionary")
    return np.frombuffer(block, "<u8", n + 1, HEADER.size), HEADER.size + 8 * (n + 1)


def frame(block: bytes, at: int, dictionary: bytes) -> np.ndarray:
    """Ids of one document of a block; no other frame is touched."""
    offsets, base = index(block, dictionary)
    return np.frombuffer(decompressor(dictionary).decompress(block[base + int(offsets[at]) : base + int(offsets[at + 1])]), "<u4")


def _blocks(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Sorted documents of a shard to blocks. `start` counts from the shard's first id."""
    shard, start, rows, held, at = None, 0, [], 0, 0

    def close():
        nonlocal rows, held, at
        out = pa.RecordBatch.from_pylist(
            [{"shard": shard, "block": at, "doc_ids": [r[0] for r in rows], "starts": [r[1] for r in rows], "sizes": [r[2] for r in rows], "bytes": pack([r[3] for r in rows], dictionary)}],
            pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("bytes", pa.binary())]),
        )
        rows, held, at = [], 0, at + 1
        return out

    for batch in batches:
        for s, doc, n, data in zip(*[batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "frame")], strict=True):
            if rows and (s != shard or held + len(data) > BLOCK_BYTES):
                yield close()
            if s != shard:
                shard, start, at = s, 0, 0
            rows.append((doc, start, n, data))
            start, held = start + n, held + len(data)
    if rows:
        yield close()


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write token files of `docs` below `path`, in ascending doc_id order (null first; equal ids by their frames).

    Ids are those of the tokenizers library without special tokens added, and END_ID behind
    each document. Null and empty texts are a document of END_ID alone. Repeated rows are
    documents each; other columns are not read. An empty table gives no blocks.
    """
    spark = docs.sparkSession
    ship_code(spark)
    file = load(tokenizer)
    dictionary = train_dictionary(docs, file)
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest())], "dictionary binary, hash string").coalesce(1).write.parquet(f"{path}/dictionary")
    sent = spark.sparkContext.broadcast((file, dictionary))  # a few MB

    def make(part: pa.RecordBatch) -> dict:
        known, shared = sent.value
        ids = _ids(known, part.column("text"))
        press = compressor(shared)
        return {
            "doc_id": part.column("doc_id"), "n_tokens": np.array([len(i) // 4 for i in ids], np.int64),
            "frame": pa.array([press.compress(i) for i in ids], pa.binary()),
        }

    frames = written(map_rows(documents_of(docs), make, "doc_id long, n_tokens long, frame binary", most=TEXT_BYTES), "frames")
    size = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-size // SHARD_BYTES)), max(1, frames.count()))
    bounds = frames.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], 10 * MOST_SHARDS)).first()[0] if shards > 1 else []
    cuts = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds or []))]).cast("array<long>")
    shard = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(cuts, lambda b: b <= F.col("doc_id"))))
    dealt = frames.withColumn("shard", shard.cast("int"))
    ordered = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("shard"), F.col("doc_id").asc_nulls_first(), "frame")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(batches, sent.value[1])

    ordered.select("shard", "doc_id", "n_tokens", "frame").mapInArrow(
        blocks, "shard int, block int, doc_ids array<long>, starts array<long>, sizes array<long>, bytes binary"
    ).write.option("compression", "none").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/blocks")
    totals = dealt.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # MOST_SHARDS rows
    before, rows = 0, []
    for t in totals:
        rows.append((t.shard, before))
        before += t.n
    spark.createDataFrame(rows, "shard int, first long").coalesce(1).write.parquet(f"{path}/shards")


def reads(sizes: list[int], most: int = READ_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of documents of so many ids that are decompressed at once: `most` bytes, a document at least."""
    at = held = 0
    for k, n in enumerate(sizes):
        if k > at and held + 4 * n > most:
            yield at, k
            at, held = k, 0
        held += 4 * n
    if at < len(sizes):
        yield at, len(sizes)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the token files: doc_id, start, n_tokens, ids (binary).

    `start` is the number of ids of all documents before it.
    """
    ship_code(spark)
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    shared = spark.sparkContext.broadcast(dictionary)
    shards = spark.read.parquet(f"{path}/shards")
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(shards), "shard")  # MOST_SHARDS rows

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # what a worker knew for encoding
        press = decompressor(shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                offsets, base = index(one["bytes"], shared.value)
                for at, to in reads(one["sizes"]):
                    ids = [press.decompress(one["bytes"][base + int(a) : base + int(b)]) for a, b in zip(offsets[at:to], offsets[at + 1 : to + 1], strict=True)]
                    first = one["first"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one["doc_ids"][at:to], pa.int64()), pa.array([first + s for s in one["starts"][at:to]], pa.int64()),
                         pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return blocks.select("first", "doc_ids", "starts", "sizes", "bytes").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """Ids of one document, from its frame alone; None if there is no such document."""
    found = spark.read.parquet(f"{path}/blocks").filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).select("doc_ids", "bytes").first()
    if found is None:
        return None
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    return frame(bytes(found["bytes"]), found["doc_ids"].index(doc_id), dictionary).tolist()


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write token files to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

