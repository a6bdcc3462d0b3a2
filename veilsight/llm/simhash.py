"""Near-duplicates by SimHash: positional byte index, count filter, verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, keep_rows, map_rows, ship_code, sorted_runs, written
from .components import components

SHINGLE_WORDS, SEED, MOST_BITS, BYTES = 4, 42, 4, 8
#: Each differing bit spoils one byte at most, so linked fingerprints share at least so many bytes in their places.
LEAST_SHARED = BYTES - MOST_BITS
#: Members of one index entry that are compared directly; more are split by half bytes first.
DIRECT = 20_000
#: Shingles hashed at once.
BLOCK = 1 << 16


def fingerprint(text: str) -> int:
    """64 bits; a bit is set if it is set in over half the hashes of the word shingles (repeats included)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    size = min(SHINGLE_WORDS, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, n, counts = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, named: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. If `named`, with the text's sha256."""
    def make(part: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
        return {"doc_id": part.column("doc_id"), "fp": fps.view(np.int64)} | ({"sha256": part.column("sha256")} if named else {})

    own = documents_of(docs)
    return map_rows(own.withColumn("sha256", F.sha2("text", 256)) if named else own, make, "doc_id long, fp long" + (", sha256 string" if named else ""))


#: Byte places of an index entry: any two fingerprints that share LEAST_SHARED places meet in one.
PLACES = list(combinations(range(BYTES), LEAST_SHARED))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings: one for each choice of LEAST_SHARED positional bytes, instead of one for each byte."""
    for batch in batches:
        fps = batch.column(0).to_numpy()
        by = fps.view(np.uint8).reshape(-1, BYTES)
        for at in range(0, len(fps), 4096):
            some = by[at : at + 4096]
            keys = np.empty((len(some), len(PLACES)), np.int64)
            for k, places in enumerate(PLACES):
                keys[:, k] = np.ascontiguousarray(some[:, places]).view(np.uint32)[:, 0].astype(np.int64) | (k << 32)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fps[at : at + 4096], len(PLACES)))], names=["key", "fp"])


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Tally of positional bytes that two fingerprints share, from their XOR."""
    return (x.reshape(-1, 1).view(np.uint8) == 0).sum(axis=1)


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.bitwise_xor(a, b).view(np.uint64)
    near = np.zeros(len(x), bool)
    counted = np.flatnonzero(shared_bytes(x) >= LEAST_SHARED)
    near[counted] = np.bitwise_count(x[counted]) <= MOST_BITS
    return near


def forest(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all that is connected among distinct fingerprints; not all links.

    What is reached is taken out before the next search, so a group of near copies costs
    about its size and never makes all its pairs.
    """
    rest = fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = linked(np.full(len(rest), one), rest)
            if near.any():
                yield np.full(int(near.sum()), one), rest[near]
                front.extend(rest[near])
                rest = rest[~near]


def nibbles(fps: np.ndarray) -> np.ndarray:
    """The sixteen half bytes of each fingerprint."""
    by = fps.view(np.uint8).reshape(-1, BYTES)
    return np.stack([by & 15, by >> 4], axis=2).reshape(len(fps), 16)


def split_forest(fps: np.ndarray, direct: int = DIRECT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As forest(), for a large entry: its members are split again by four of the half bytes in which they differ.

    At most MOST_BITS of eight half bytes can differ between linked members, so the split
    loses none. Members that agree in those too differ in 16 bits: 65,536 at most.
    """
    half = nibbles(fps)
    order = np.argsort([-(len(np.unique(half[:, k])) > 1) * 1.0 for k in range(16)], kind="stable")
    free = sorted(order[:8].tolist())
    if len(fps) <= direct or all(len(np.unique(half[:, k])) <= 1 for k in free):
        yield from forest(fps)
        return
    for places in combinations(free, 4):
        code = (half[:, places].astype(np.int64) * (16 ** np.arange(4))).sum(axis=1)
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.diff(code[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                yield from forest(fps[group])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for starts, ends, columns in sorted_runs(batches, "key"):
        fps = columns["fp"]
        two = starts[ends - starts == 2]
        near = linked(fps[two], fps[two + 1])
        a, b = [fps[two[near]]], [fps[two[near] + 1]]
        more = ends - starts > 2
        for s, e in zip(starts[more], ends[more], strict=True):
            for x, y in split_forest(fps[s:e]):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def near_links(fps: DataFrame) -> DataFrame:
    """fps(fp), distinct -> links (a, b) that connect all fingerprints at MOST_BITS or fewer differing bits."""
    ship_code(fps.sparkSession)
    postings = fps.select("fp").mapInArrow(_index, "key long, fp long")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = postings.repartition(parts, "key").sortWithinPartitions("key")
    return entries.mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, shingles four words, hashes
    XXH64 with seed 42. Fingerprints link at four or fewer differing bits.

    Count filtering: linked fingerprints share at least four of their eight bytes in place.
    Single bytes would give posting lists of a 256th of all rows, so postings hold every
    choice of four bytes in place: exactly the pairs whose tally reaches four meet. The tally
    and the bits are then verified. Equal fingerprints are one member.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows
    and ids give a row each. A null doc_id is never a component's id unless all are null.
    Other columns are not read. An empty table gives no rows.
    """
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(docs: DataFrame, named: bool = False) -> DataFrame:
    """fingerprints() with component, a fingerprint, which no two components share, and component_id, which repeated ids may share."""
    fps = written(fingerprints(docs, named), "simhash")
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    comps = components(near_links(first), "simhash")
    of = first.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select(
        F.col("fp").alias("f"), "first", F.coalesce("component", "fp").alias("component")
    )
    ids = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.join(ids, "component").select("f", "component", "component_id")
    return fps.join(of, fps["fp"] == of["f"]).drop("f")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with its smallest doc_id (of those the one with the smallest fingerprint), with all columns."""
    least = grouped(docs, named=True).filter("doc_id <=> component_id").groupBy("component").agg(F.min(F.struct("fp", "doc_id", "sha256")).alias("least"))
    return keep_rows(docs, least.select(F.col("least.doc_id").alias("keep_id"), F.col("least.sha256").alias("keep_sha256")))
