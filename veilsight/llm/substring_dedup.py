"""Removal of repeated word passages with suffix automata.

The reference of each document is everything before it, so its automata have no size bound
and cannot be broadcast whole. They are split into shards by content instead. A window of
WINDOW words belongs to the shard of its minimizer, the word gram in it with the smallest
hash; equal windows share it. Consecutive windows with one minimizer form a segment. A shard
holds the different segments of one minimizer: an automaton of those seen so far is streamed
with the next one for matching statistics, in the order of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, map_rows, ship_code, sorted_runs, written
from .wordhash import Words, covered, mix, powers, window_hashes, words_of

WINDOW, GRAM = 20, 8
#: White space of words: blank and \t \n \v \f \r.
SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Different segments of one minimizer that go to one shard; those of a hotter one go window by window.
HOT = 1_000
#: Stands for a null doc_id: the smallest.
NO_ID = -(1 << 63)

_Q, _QI = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def stretch_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches of words."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_Q, len(hashes)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(_QI, len(hashes) + 1)[starts]
    return mix(value ^ mix((ends - starts).astype(np.uint64) + np.uint64(77)))


def segments(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, hash, text number, first word (in its text) and number of windows of each segment."""
    n = len(words.hashes)
    none = np.empty(0, np.int64)
    if n < WINDOW:
        return none, none, none, none, none
    value = window_hashes(words.hashes, GRAM)
    at = np.arange(len(value))
    reach, need = 1, WINDOW - GRAM + 1
    while reach < need:  # the smallest of a growing number of grams; the leftmost of equal ones
        step = min(reach, need - reach)
        left, right = slice(0, len(value) - step), slice(step, None)
        first = value[left] <= value[right]
        value, at = np.where(first, value[left], value[right]), np.where(first, at[left], at[right])
        reach += step
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    ok = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
    new = np.r_[True, (at[1:] != at[:-1]) | (doc[1 : n - WINDOW + 1] != doc[: n - WINDOW])]
    starts = np.flatnonzero(new)
    counts = np.add.reduceat(ok.astype(np.int64), starts)
    # windows of one segment that run over the end of a text are its last ones
    starts, counts = starts[ok[starts]], counts[ok[starts]]
    which = doc[starts]
    hashes = stretch_hashes(words.hashes, starts, starts + counts + WINDOW - 1)
    return value[starts].view(np.int64), hashes.view(np.int64), which, starts - words.first[which], counts


def _segment_rows(part: pa.RecordBatch) -> dict:
    """Rows of a slice. Of equal segments in it the first goes to its shard; the others are known to be repeats."""
    words = words_of([t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()], SPACE)
    key, ctx, which, pos, count = segments(words)
    k = part.column("k").to_numpy()[which] if len(which) else which
    order = np.lexsort((pos, k, ctx, key))
    key, ctx, k, pos, count = key[order], ctx[order], k[order], pos[order], count[order]
    again = np.r_[False, (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1])] if len(key) else np.empty(0, bool)
    again[1:] &= (k[1:] != k[:-1]) | (pos[1:] != pos[:-1])
    route = np.where(again, mix(k.view(np.uint64) + pos.astype(np.uint64)).view(np.int64), key) if len(key) else key
    return {"route": route, "key": key, "ctx": ctx, "k": k, "pos": pos.astype(np.int32), "n": count.astype(np.int32), "again": again}


_SEGMENT = "route long, key long, ctx long, k long, pos int, n int, again boolean"
_FOUND = "kind int, key long, ctx long, k long, pos int, n int"


def _found(kind: int, c: dict, rows: np.ndarray) -> pa.RecordBatch:
    kinds = np.full(int(rows.sum()) if rows.dtype == bool else len(rows), kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kinds), *[pa.array(c[x][rows]) for x in ("key", "ctx", "k", "pos", "n")]], names=["kind", "key", "ctx", "k", "pos", "n"])


def _shards(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by route, hash and place: repeats of a segment (kind 0), and segments whose minimizer has several (kind 1) or very many (2)."""
    def fresh():
        for batch in batches:
            again = batch.column("again").to_numpy(zero_copy_only=False)
            if again.any():
                seen.append(_found(0, {x: batch.column(x).to_numpy() for x in ("key", "ctx", "k", "pos", "n")}, again))
            yield batch.filter(pa.array(~again)).drop_columns(["again", "key"])

    seen: list[pa.RecordBatch] = []
    for starts, ends, c in sorted_runs(fresh(), "route"):
        yield from seen
        seen.clear()
        c["key"] = c["route"]
        inside = np.zeros(len(c["key"]) + 1, np.int64)
        inside[starts] += 1
        inside[ends] -= 1
        inside = np.cumsum(inside[:-1]) > 0
        first = np.r_[True, (c["key"][1:] != c["key"][:-1]) | (c["ctx"][1:] != c["ctx"][:-1])] if len(inside) else inside
        same = np.r_[False, (c["k"][1:] == c["k"][:-1]) & (c["pos"][1:] == c["pos"][:-1])] if len(inside) else inside
        # a place given twice (rows that share an id) is no repeat of itself
        yield _found(0, c, inside & ~first & ~(same & ~first))
        several = np.zeros(len(inside), np.int8)
        if len(starts):
            firsts = np.add.reduceat(np.r_[first, False].astype(np.int64), np.c_[starts, ends].ravel())[::2]
            for s, e, n in zip(starts[firsts > 1], ends[firsts > 1], firsts[firsts > 1], strict=True):
                several[s:e] = 2 if n > hot else 1
        yield _found(1, c, (several == 1) & first)
        yield _found(2, c, (several == 2) & first)
    yield from seen


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.to: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        to, link, size = self.to, self.link, self.size
        for w in words:
            have = to[last].get(w)
            if have is not None and size[have] == size[last] + 1:
                last = have
                continue
            if have is not None:
                last = self._clone(last, have, w)
                continue
            new = len(to)
            to.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in to[p]:
                to[p][w] = new
                p = link[p]
            if p >= 0:
                q = to[p][w]
                link[new] = q if size[q] == size[p] + 1 else self._clone(p, q, w)
            last = new

    def _clone(self, p: int, q: int, w) -> int:
        to, link, size = self.to, self.link, self.size
        copy = len(to)
        to.append(dict(to[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and to[p].get(w) == q:
            to[p][w] = copy
            p = link[p]
        return copy

    def statistics(self, words: list) -> list[int]:
        """For each word, the length of the longest stretch ending there that the automaton knows."""
        state = length = 0
        out = []
        to, link, size = self.to, self.link, self.size
        for w in words:
            while state and w not in to[state]:
                state = link[state]
                length = size[state]
            if w in to[state]:
                state = to[state][w]
                length += 1
            else:
                length = 0
            out.append(length)
        return out


def repeats(contexts: list[bytes], places: list[tuple[int, int]], window: int = WINDOW) -> list[int]:
    """Of each context, in order, a mask of the windows that an earlier one has.

    Rows that share an id may have a window at the same place. It is no repeat of itself.
    """
    ends = [p + c.count(b" ") + 2 - window for (_, p), c in zip(places, contexts, strict=True)]
    furthest: dict[int, int] = {}
    shared = False
    for (k, p), e in zip(places, ends, strict=True):
        shared = shared or furthest.get(k, p) > p
        furthest[k] = max(e, furthest.get(k, e))
    first: dict[bytes, tuple[int, int]] = {}
    if len(contexts) > 8:  # contexts without any window that occurs twice need no automaton
        of = words_of(contexts, np.array([c == 32 for c in range(256)]))
        hashes = window_hashes(of.hashes, window)
        doc = np.repeat(np.arange(len(contexts)), np.diff(of.first))
        ok = doc[: len(hashes)] == doc[window - 1 :]
        _, inverse, counts = np.unique(hashes[ok], return_inverse=True, return_counts=True)
        some = set(doc[: len(hashes)][ok][counts[inverse] > 1].tolist())
    else:
        some = set(range(len(contexts)))
    automaton, out = Automaton(), []
    for k, context in enumerate(contexts):
        mask = 0
        if k in some:
            words = context.split(b" ")
            at, (doc_id, place) = 0, places[k]
            for end, length in enumerate(automaton.statistics(words)):
                at = end - window + 1
                if shared and at >= 0:
                    own = doc_id, place + at
                    length *= first.setdefault(b" ".join(words[at : end + 1]), own) < own
                if length >= window:
                    mask |= 1 << at
            automaton.add(words)
        out.append(mask)
    return out


_CONTEXT = "key long, ctx long, k long, pos int, n int, place int, again boolean, context binary"


def _texts(part: pa.RecordBatch) -> dict:
    """Words of the asked segments of each document; rows that share an id answer for their own text only.

    Segments of a hot minimizer go window by window to shards of their own. Of equal windows
    in a slice the first goes there; the others are known to be repeats.
    """
    words = words_of([t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()], SPACE)
    rows: list[tuple] = []
    split: list[tuple] = []
    for d, (k, asked) in enumerate(zip(part.column("k").to_pylist(), part.column("asked").to_pylist(), strict=True)):
        first, size = int(words.first[d]), int(words.first[d + 1] - words.first[d])
        asked = [a for a in asked if a["pos"] + a["n"] + WINDOW - 1 <= size]
        if not asked:
            continue
        own = words.hashes[first : first + size]
        starts = np.array([a["pos"] for a in asked])
        ends = starts + np.array([a["n"] for a in asked]) + WINDOW - 1
        hashes = stretch_hashes(own, starts, ends).view(np.int64).tolist()
        for a, h, e in zip(asked, hashes, ends.tolist(), strict=True):
            if h != a["ctx"]:
                continue
            if a["kind"] == 1:
                rows.append((a["key"], a["ctx"], k, a["pos"], a["n"], a["pos"], False, words.window(first + a["pos"], e - a["pos"])))
                continue
            places = np.arange(a["pos"], a["pos"] + a["n"])
            for place, key in zip(places.tolist(), stretch_hashes(own, places, places + WINDOW).view(np.int64).tolist(), strict=True):
                split.append((k, place, key, a, words.window(first + place, WINDOW)))
    seen: dict[bytes, tuple] = {}
    for k, place, key, a, window in sorted(split, key=lambda x: x[:2]):
        again = seen.setdefault(window, (k, place)) != (k, place)
        route = hash((k, place)) if again else key
        rows.append((route, a["ctx"], k, a["pos"], a["n"], place, again, b"" if again else window))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    names = ("key", "ctx", "k", "pos", "n", "place", "again", "context")
    return {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))}


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by shard and place: the masks of windows that start earlier elsewhere."""
    known: list[pa.RecordBatch] = []

    def result(c: dict, rows, masks: list[int]) -> pa.RecordBatch:
        columns = [pa.array(c["ctx"][rows], pa.int64()), pa.array(c["k"][rows], pa.int64()), pa.array(c["pos"][rows], pa.int32()), pa.array(masks, pa.int32()), pa.array(c["n"][rows], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["ctx", "k", "pos", "mask", "n"])

    def fresh():
        for batch in batches:
            again = batch.column("again").to_numpy(zero_copy_only=False)
            if again.any():
                c = {x: batch.column(x).to_numpy()[again] for x in ("ctx", "k", "pos", "n", "place")}
                known.append(result(c, slice(None), (1 << (c["place"] - c["pos"]).astype(np.int64)).tolist()))
            yield batch.filter(pa.array(~again)).drop_columns(["again"])

    for starts, ends, c in sorted_runs(fresh(), "key"):
        yield from known
        known.clear()
        rows, masks = [], []
        for s, e in zip(starts, ends, strict=True):
            places = list(zip(c["k"][s:e].tolist(), c["place"][s:e].tolist(), strict=True))
            for i, m in zip(range(s, e), repeats(c["context"][s:e].tolist(), places), strict=True):
                if m:
                    rows.append(i)
                    masks.append(m << int(c["place"][i] - c["pos"][i]))
        yield result(c, np.array(rows, np.int64), masks)
    yield from known


def _cut(part: pa.RecordBatch) -> dict:
    """Documents without their removed words."""
    words = words_of([t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()], SPACE)
    total = len(words.starts)
    at: list[np.ndarray] = [np.empty(0, np.int64)]
    for d, asked in enumerate(part.column("found")):
        if not asked.is_valid:
            continue
        found = asked.values
        pos = found.field("pos").to_numpy().astype(np.int64)
        mask, ctx, n = found.field("mask").to_numpy().astype(np.int64), found.field("ctx").to_numpy(), found.field("n").to_numpy().astype(np.int64)
        first, size = int(words.first[d]), int(words.first[d + 1] - words.first[d])
        fit = pos + n + WINDOW - 1 <= size
        pos, mask, ctx, n = pos[fit], mask[fit], ctx[fit], n[fit]
        if len(pos):
            own = stretch_hashes(words.hashes[first : first + size], pos, pos + n + WINDOW - 1).view(np.int64) == ctx
            for j in range(WINDOW - GRAM + 1):
                at.append(first + pos[own & (mask >> j & 1 == 1)] + j)
    gone = covered(total, np.concatenate(at), WINDOW)
    kept = []
    for d in range(len(words.first) - 1):
        a, b = int(words.first[d]), int(words.first[d + 1])
        left = np.flatnonzero(~gone[a:b]) + a
        kept.append(b" ".join([words.data[s:e].tobytes() for s, e in zip(words.starts[left], words.ends[left], strict=True)]) if len(left) < b - a or a == b else b" ".join(words.data[words.starts[a] : words.ends[b - 1]].tobytes().split()))
    sums = np.r_[0, np.cumsum(gone)]
    return {
        "doc_id": part.column("doc_id"), "n_words": np.diff(words.first).astype(np.int64), "n_removed": sums[words.first[1:]] - sums[words.first[:-1]],
        "kept": pa.array(kept, pa.binary()),
    }


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (binary, the words left, joined by one blank, in UTF-8).

    Words are `[^\\x20\\x09-\\x0D]+`. A window is 20 consecutive words; each word is removed that
    lies in a window whose words also start earlier: in a smaller doc_id, or earlier in the
    same document. Windows are judged on the input.

    Null and empty texts have no words; texts of fewer than 20 words keep all. A null doc_id
    is the smallest id. Rows that share an id are judged by id and place: a window is no
    repeat of one at its own place in the other row. Other columns are not read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    ship_code(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = documents_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "doc_id", "text")
    rows = map_rows(own.select("k", "text"), _segment_rows, _SEGMENT)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _shards(batches, hot)

    found = written(rows.repartition(parts, "route").sortWithinPartitions("route", "ctx", "k", "pos").mapInArrow(shards, _FOUND), "segments")
    asked = found.filter("kind > 0").groupBy(F.col("k").alias("k1")).agg(F.collect_list(F.struct("kind", "key", "ctx", "pos", "n")).alias("asked"))
    contexts = map_rows(own.join(asked, F.col("k") == F.col("k1")).select("k", "text", "asked"), _texts, _CONTEXT)
    sorted_contexts = contexts.repartition(parts, "key").sortWithinPartitions("key", "k", "place")
    matched = sorted_contexts.mapInArrow(_matched, "ctx long, k long, pos int, mask int, n int")
    return _finish(own, found, matched)


def _finish(own: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    whole = found.filter("kind = 0").select("ctx", "k", "pos", F.expr("cast(shiftleft(1, n) - 1 as int)").alias("mask"), "n")
    gone = whole.unionByName(matched).groupBy(F.col("k").alias("k1")).agg(F.collect_list(F.struct("ctx", "pos", "mask", "n")).alias("found"))
    return map_rows(own.join(gone, F.col("k") == F.col("k1"), "left").select("doc_id", "text", "found"), _cut, "doc_id long, n_words long, n_removed long, kept binary")

