"""Benchmark decontamination with a broadcast set of normalised n-grams."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, row_and, ship_code, texts_of, written
from .wordhash import covered, window_hashes, words_of

WINDOW = 13
#: Grams of one broadcast set, each with one item: about 150 bytes each. A larger benchmark is held against the documents in blocks.
MOST_GRAMS = 400_000

#: Normalised bytes: A-Z become lower case, letters, digits and bytes of other characters stay, the rest are blanks.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEPARATOR = np.array([c == 32 for c in range(256)])


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL)


def grams(benchmark: DataFrame) -> DataFrame:
    """(gram, size, item_id), distinct: the windows of each item."""
    def make(part: pa.RecordBatch) -> dict:
        out: set[tuple] = set()
        for item, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            words = normal(text).split()
            size = min(WINDOW, len(words))
            out.update((b" ".join(words[k : k + size]), size, item) for k in range(len(words) - size + 1) if size)
        rows = list(out)
        return {"gram": pa.array([r[0] for r in rows], pa.binary()), "size": pa.array([r[1] for r in rows], pa.int32()), "item_id": pa.array([r[2] for r in rows], pa.int64())}

    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    return map_rows(items, make, "gram binary, size int, item_id long").distinct()


class GramSet:
    """A block of grams. A table of 2^22 flags, by hash, passes over what is certainly none."""

    def __init__(self, rows: list[tuple[bytes, int, int | None]]):
        self.items: dict[bytes, list] = {}
        by_size: dict[int, list[bytes]] = {}
        for gram, size, item in rows:
            if gram not in self.items:
                by_size.setdefault(size, []).append(gram)
            self.items.setdefault(gram, []).append(item)
        self.sizes = {size: self._hashes(size, found) for size, found in by_size.items()}

    @staticmethod
    def _hashes(size: int, found: list[bytes]) -> np.ndarray:
        of = words_of(found, SEPARATOR)
        return np.unique(window_hashes(of.hashes, size)[of.first[:-1]])

    def scan(self, texts: list[bytes]):
        """Words of the texts, which of them are hit, and for each text the items found."""
        words = words_of(texts, SEPARATOR)
        n = len(words.starts)
        starts, sizes, items = [], [], [set() for _ in texts]
        for size, known in self.sizes.items():
            hashes = window_hashes(words.hashes, size)
            flags = np.zeros(1 << 22, bool)
            flags[known >> np.uint64(42)] = True
            may = np.flatnonzero(flags[hashes >> np.uint64(42)])
            may = may[np.isin(hashes[may], known)]
            doc = words.doc_of(may)
            ok = words.doc_of(may + size - 1) == doc
            for i, d in zip(may[ok].tolist(), doc[ok].tolist(), strict=True):
                found = self.items.get(words.window(i, size))
                if found is not None:
                    starts.append(i)
                    sizes.append(size)
                    items[d].update(x for x in found if x is not None)
        return words, covered(n, np.array(starts, np.int64), np.array(sizes, np.int64)), items


_SETS: dict[str, GramSet] = {}


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _merged(a: list, b: list) -> list:
    out: list = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SCHEMA = "n_words long, spans array<struct<s:long,e:long,from:long,to:long>>, items array<long>"
_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("from", pa.int64()), ("to", pa.int64())]))


def block_of(blocks: int) -> Column:
    """The block of a gram and item. Items count, so that a gram of very many items is spread over all blocks."""
    return F.pmod(F.xxhash64("gram", "item_id"), F.lit(blocks))


def hits(docs: DataFrame, benchmark: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """(row, n_words, spans, items): row has all columns of `docs`; a span of hit words has word and byte bounds.

    The benchmark's grams are broadcast up to `most_grams` at a time. A larger benchmark is
    held against the documents in blocks, one after another; what is found is united.
    """
    spark = docs.sparkSession
    ship_code(spark)
    found = written(grams(benchmark), "grams")
    blocks = max(1, -(-found.count() // most_grams))
    row = F.struct(*[docs[c] for c in docs.columns])
    out = docs.select(row.alias("row"))
    fields = row_and(out, _SCHEMA)
    for k in range(blocks):
        part = found if blocks == 1 else found.filter(block_of(blocks) == k)
        known = spark.sparkContext.broadcast([(bytes(g), s, i) for g, s, i in part.collect()])

        def make(batch: pa.RecordBatch, known=known, key=uuid.uuid4().hex) -> dict:
            if key not in _SETS:
                _SETS.clear()
                _SETS[key] = GramSet(known.value)
            grams_of = _SETS[key]
            texts = [normal(t) for t in texts_of(batch)]
            words, hit, items = grams_of.scan(texts)
            offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
            has = "spans" in batch.schema.names
            spans = []
            for d in range(len(texts)):
                a, b = words.first[d], words.first[d + 1]
                runs = _runs(hit[a:b]) if hit[a:b].any() else []
                if has:
                    before = batch.column("spans")[d].as_py()
                    runs = _merged(runs, [(x["s"], x["e"]) for x in before])
                    items[d].update(batch.column("items")[d].as_py())
                spans.append([{"s": s, "e": e, "from": int(words.starts[a + s] - offsets[d]), "to": int(words.ends[a + e - 1] - offsets[d])} for s, e in runs])
            return {
                "row": batch.column("row"), "n_words": np.diff(words.first).astype(np.int64),
                "spans": pa.array(spans, _SPANS), "items": pa.array([sorted(i) for i in items], pa.list_(pa.int64())),
            }

        out = map_rows(out, make, fields, "row.text")
        if k + 1 < blocks:
            out = written(out, "hits")
    return out


N_HIT = "aggregate(spans, 0L, (n, x) -> n + x.e - x.s) AS n_hit"
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def contamination(docs: DataFrame, benchmark: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A window is 13
    consecutive words of an item, or all words of an item with fewer. Words inside any
    occurrence of a window are hit; a document is contaminated if at least a 20th of its
    words are. Windows found by hash are verified on their words.

    Null and empty texts have no words and are clean; items without words have no window. An
    item without an id taints documents but isn't counted or listed. Repeated items count
    once, repeated documents give a row each. An empty benchmark leaves all documents clean.
    """
    found = hits(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), benchmark, most_grams)
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select(
        "row.doc_id", "n_words", F.expr(N_HIT), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256")
    ).withColumn("contaminated", F.expr(CONTAMINATED))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """The clean documents, with all their columns."""
    found = hits(docs, benchmark, most_grams).select("row", "n_words", F.expr(N_HIT))
    return found.filter(f"not ({CONTAMINATED})").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """(doc_id, text): the texts without the stretches of hit words, contaminated or not. Null text becomes empty."""
    found = hits(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), benchmark, most_grams)

    def make(part: pa.RecordBatch) -> dict:
        out = []
        for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
            data, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
            for s in spans:
                kept.append(data[at : s["from"]])
                at = s["to"]
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass"))
        return {"doc_id": part.column("doc_id"), "text": pa.array(out, pa.string())}

    return map_rows(found.select("row.doc_id", F.coalesce("row.text", F.lit("")).alias("text"), "spans"), make, "doc_id long, text string")

