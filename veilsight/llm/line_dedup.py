"""Fuzzy line deduplication: MinHash bands over character shingles, exact Jaccard, one line kept per component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, map_rows, ship_code, sorted_runs, written
from .components import components
from .wordhash import mix

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at a similarity of 0.8 shares a band with probability 1 - (1 - 0.8^5)^12 = 0.991, at 0.85 with 0.999.
BANDS, ROWS = 12, 5
NO_ID = -(1 << 63)
#: Shingles hashed at once.
BLOCK = 1 << 16
#: Lines of a company that one task verifies; larger ones go in pairs of blocks.
MOST_MEMBERS = 20_000
#: Band rows of a key that are held at once; characters of companies that are hashed at once.
RUN, LETTERS = 1 << 20, 1 << 17
#: Sets times different elements of a company whose pairs are counted in one table.
TABLE = 1 << 21
#: Places of an index that are read at once.
SHARED = 1 << 21
#: Bits that say which lines are in no company; more companies' lines share them.
MOST_BITS, PAGE = 1 << 26, 1 << 15

_RNG = np.random.default_rng(7)
_A = (_RNG.integers(1, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_C = _RNG.integers(1, 1 << 63, ROWS, np.uint64) | np.uint64(1)


def plain(line: str) -> str:
    """What is compared of a line: its words joined by one blank. All white space but the blank is not printable."""
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
        return line
    return " ".join(line.split())


def line_id(line: str) -> int:
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of each line (repeats included) and where each line's begin. A shorter line is one shingle."""
    data = np.frombuffer("\0".join([*lines, "\0" * SHINGLE]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    short = sizes < SHINGLE
    n = np.where(short, 1, sizes - SHINGLE + 1)
    bounds = np.r_[0, np.cumsum(n)]
    all_at = len(data) - SHINGLE
    out = data[:all_at].copy()
    for k in range(1, SHINGLE):
        out *= np.uint64(0x100000001B3)
        out += data[k : k + all_at]
    stops = np.cumsum(sizes + 1) - 1
    starts = stops - sizes
    inside = np.ones(all_at, bool)  # not where a shingle would run over the end of its line
    for k in range(SHINGLE):
        inside[np.maximum(stops - k, starts)] = False
    inside[starts[short]] = True
    out = out[inside]
    out = mix(out)
    for i in np.flatnonzero(short):
        out[bounds[i]] = np.uint64(line_id(lines[i]) & (1 << 64) - 1)
    return out, bounds


def band_keys(lines: list[str]) -> np.ndarray:
    """A row for each line, a key for each band of its MinHash signature."""
    keys = np.empty((len(lines), BANDS), np.int64)
    at = 0
    sizes = np.cumsum([0, *map(len, lines)])
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BLOCK, side="right")) - 1)
        hashed, bounds = shingles(lines[at:to])
        x = (hashed >> np.uint64(32)).astype(np.uint32)
        y = np.empty_like(x)
        for band in range(BANDS):
            code = np.full(to - at, band + 1, np.uint64)
            for row in range(ROWS):
                k = band * ROWS + row
                np.multiply(x, _A[k], out=y)
                y += _B[k]
                code = code * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(y, bounds[:-1]) * _C[row]
            keys[at:to, band] = mix(code).view(np.int64)
        at = to
    return keys


def _lines(part: pa.RecordBatch) -> dict[str, int]:
    """The different lines of a slice, without blank ones."""
    found: dict[str, int] = {}
    for text in part.column("text").to_pylist():
        for line in text.split("\n"):
            if (p := plain(line)) and p not in found:
                found[p] = line_id(p)
    return found


def _band_rows(part: pa.RecordBatch) -> dict:
    found = {p: i for p, i in _lines(part).items() if len(p) >= SHINGLE}
    keys = band_keys(list(found)) if found else np.empty((0, BANDS), np.int64)
    return {"key": keys.ravel(), "id": np.repeat(np.fromiter(found.values(), np.int64, len(found)), BANDS)}


def _shared(most: int):
    """Rows sorted by key: the ids of keys with two or more, under a name of that set of ids, and whether there are over `most`.

    Near lines share several bands and mostly meet in the same company; it is verified once.
    A company too long to wait for is named by its key and comes in pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, ends, c in sorted_runs(batches, "key", RUN):
            if starts is None:
                ids = np.unique(c["id"])
                groups, large = np.repeat(mix(c["key"][:1].view(np.uint64)).view(np.int64), len(ids)), np.ones(len(ids), bool)
            else:
                own = np.repeat(np.arange(len(starts)), ends - starts)
                ids = c["id"][np.arange(len(own)) + np.repeat(starts - np.cumsum(ends - starts) + ends - starts, ends - starts)]
                order = np.lexsort((ids, own))
                ids, own = ids[order], own[order]
                new = np.ones(len(ids), bool)
                new[1:] = (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])
                ids, own = ids[new], own[new]
                n = np.bincount(own, minlength=len(starts))
                ids, own = ids[n[own] > 1], own[n[own] > 1]
                sums = np.zeros(len(starts), np.uint64)
                np.add.at(sums, own, mix(ids.view(np.uint64)))
                groups, large = mix(sums + n.astype(np.uint64)).view(np.int64)[own], n[own] > most
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (groups, ids, large)], names=["key", "id", "large"])

    return run


def companies(shared: DataFrame, most: int) -> DataFrame:
    """shared(key, id, large) -> (key, id): what is verified together. Large companies are dealt into blocks of half of `most`, and
    each two blocks are verified by themselves, so that all pairs still meet and no task holds a whole company."""
    small, large = shared.filter("not large").select("key", "id"), shared.filter("large").select("key", "id")
    if large.isEmpty():
        return small
    n = large.groupBy(F.col("key").alias("c")).agg(F.count("*").alias("n")).filter("n > 1")
    block = F.when(F.col("n") <= most, 1).otherwise(F.ceil(F.col("n") / max(1, most // 2))).cast("long")
    dealt = large.join(n, F.col("key") == F.col("c")).withColumn("blocks", block).withColumn("b", F.pmod(F.xxhash64("id"), "blocks"))
    pairs = F.expr("transform(filter(sequence(0L, blocks - 1), j -> j <> b or blocks = 1), j -> xxhash64(key, least(j, b), greatest(j, b)))")
    return small.unionByName(dealt.select(F.explode(pairs).alias("key"), "id"))


def distinct(hashed: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Of each line its different shingles, sorted. `hashed` is sorted line by line in place."""
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashed[x:y].sort()
    new = np.r_[True, hashed[1:] != hashed[:-1]]
    new[bounds[:-1]] = True
    flat, ends = hashed[new], np.r_[0, np.cumsum(new)][bounds].tolist()
    return [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def similar(sets: list[np.ndarray], least: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Links that connect all sets connected by a Jaccard similarity of `least` or more; not all of them.

    What is reached is taken out, so that copies of one line don't make all their pairs.
    """
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    table = _near_table(flat, owner, sizes, least) if len(sets) <= 512 else None
    counts = None if table is not None else _Shared(flat, owner, sizes)
    rest, left = np.ones(len(sets), bool), len(sets)
    for seed in range(len(sets)):
        if not rest[seed]:
            continue
        rest[seed] = False
        left -= 1
        front = [seed]
        while front and left:
            one = front.pop()
            if table is not None:
                near = np.flatnonzero(rest & table[one])
            else:
                live, common = counts.of(one, rest, left)
                near = live[rest[live] & (common >= least * (sizes[live] + sizes[one] - common) - 1e-9)]
            for j in near.tolist():
                yield one, j
            rest[near] = False
            left -= len(near)
            front.extend(near.tolist())


class _Shared:
    """How many elements each two sets share, from an index of the sets by element.

    An element of over half of the sets is indexed by the sets that lack it, so that near copies are told apart by what
    differs: what each set is known by is its elements of few sets and the elements of many that it lacks.
    """

    def __init__(self, flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        code = np.cumsum(np.r_[False, flat[1:] != flat[:-1]])
        many = np.bincount(code) * 2 > n
        usual = many[code]
        has = np.zeros((n, int(many.sum())), bool)  # no more than twice the elements
        has[owner[usual], (np.cumsum(many) - 1)[code[usual]]] = True
        lacking, what = np.nonzero(~has)
        code, owner = np.r_[code[~usual], np.flatnonzero(many)[what]], np.r_[owner[~usual], lacking]
        self.sizes, self.known_by = sizes, np.bincount(owner, minlength=n)
        self.elements = code[np.argsort(owner, kind="stable")]
        self.bounds = np.r_[0, np.cumsum(self.known_by)]
        self.places = owner[np.argsort(code, kind="stable")]
        self.starts = np.r_[0, np.cumsum(np.bincount(code, minlength=len(many)))]
        self.live = np.arange(n)

    def of(self, one: int, rest: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets, all of `rest` (`left` many) among them, and how many elements each shares with `one`."""
        if left * 2 < len(self.live):
            self._leave(rest)
        elements = self.elements[self.bounds[one] : self.bounds[one + 1]]
        starts = self.starts[elements]
        n = self.starts[elements + 1] - starts
        both = np.zeros(len(self.live), np.int64)
        portion = np.cumsum(n) // SHARED
        for cut in np.split(np.arange(len(n)), np.flatnonzero(portion[1:] != portion[:-1]) + 1):
            s, m = starts[cut], n[cut]
            at = np.repeat(s - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            both += np.bincount(self.places[at], minlength=len(both))
        apart = self.known_by[self.live] + self.known_by[one] - 2 * both
        return self.live, (self.sizes[self.live] + self.sizes[one] - apart) // 2

    def _leave(self, rest: np.ndarray) -> None:
        """From now on only sets of `rest`."""
        stays = rest[self.live]
        keep = stays[self.places]
        self.places = (np.cumsum(stays) - 1)[self.places[keep]]
        self.starts = np.r_[0, np.cumsum(keep)][self.starts]
        self.live = self.live[stays]


def _near_table(flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray | None:
    """Of each two sets of a company, whether they are similar; None if they have too many different elements."""
    order = np.argsort(flat)
    flat = flat[order]
    code = np.cumsum(np.r_[False, flat[1:] != flat[:-1]])
    if len(sizes) * (int(code[-1]) + 1) > TABLE:
        return None
    has = np.zeros((len(sizes), int(code[-1]) + 1), np.float32)
    has[owner[order], code] = 1
    common = has @ has.T
    return common >= least * (sizes[:, None] + sizes - common) - 1e-9


def at_once(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of companies that are hashed together: 2,000 and LETTERS characters at most, a company at least."""
    sums = np.r_[0, np.cumsum(sizes)]
    before, at = np.r_[0, np.cumsum(sums[ends] - sums[starts])], 0
    while at < len(starts):
        to = max(at + 1, min(at + 2_000, int(np.searchsorted(before, before[at] + LETTERS, side="right")) - 1))
        yield at, to
        at = to


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by key, to verified links."""
    for starts, ends, c in sorted_runs(batches, "key"):
        a, b, ids = [], [], c["id"]
        for at, to in at_once(starts, ends, np.fromiter(map(len, c["line"]), np.int64, len(ids))):
            some = list(zip(starts[at:to].tolist(), ends[at:to].tolist(), strict=True))
            rows = [i for s, e in some for i in range(s, e)]
            hashed, bounds = shingles(c["line"][rows].tolist())
            sets, k = distinct(hashed, bounds), 0
            for s, e in some:
                own = sets[k : k + e - s]
                k += e - s
                pairs = similar(own) if e - s > 2 else [(0, 1)] if _near(*own) else []
                for i, j in pairs:
                    a.append(ids[s + i])
                    b.append(ids[s + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _near(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common >= least * (len(x) + len(y) - common) - 1e-9


def marks(ids: DataFrame) -> np.ndarray:
    """A bit for the last digits of each id, 16 bits an id but MOST_BITS at most: an id whose bit is not set is none of them."""
    bits = max(PAGE, min(MOST_BITS, 1 << (16 * ids.count()).bit_length()))
    low = F.col("id").bitwiseAND(F.lit(bits - 1))
    pages = ids.groupBy(F.shiftright(low, 15).alias("page")).agg(F.bitmap_construct_agg(low.bitwiseAND(F.lit(PAGE - 1))).alias("bits")).collect()  # MOST_BITS
    out = np.zeros((bits // PAGE, PAGE // 8), np.uint8)
    for p in pages:
        out[p.page] = np.frombuffer(p.bits, np.uint8)
    return out.ravel()


def marked(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = ids & (len(bits) * 8 - 1)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def similar_lines(own: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """(node, component): ids of lines that are near to others, over all documents own(k, text)."""
    return _similar(own, most)[0]


def _similar(own: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """similar_lines(), and the place of each line that is not blank: (k, at, id)."""
    spark = own.sparkSession
    ship_code(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands = map_rows(own.select("text"), _band_rows, "key long, id long")
    shared = written(bands.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared(most), "key long, id long, large boolean").distinct(), "bands")
    bits = spark.sparkContext.broadcast(marks(shared.select("id")))  # 8 MB at most
    places = written(map_rows(own.select("k", "text"), lambda part: _places(part, bits.value), "k long, at int, id long, line string"), "line-places")
    wanted = shared.select(F.col("id").alias("w")).distinct()
    lines = places.filter("line is not null").select(F.col("id").alias("line_id"), "line")
    lines = lines.join(wanted, F.col("line_id") == F.col("w"), "left_semi").dropDuplicates(["line_id"])
    members = companies(shared, most).join(lines, F.col("id") == F.col("line_id")).select("key", "id", "line")
    links = members.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")
    return components(links, "lines"), places.select("k", "at", "id")


def _places(part: pa.RecordBatch, bits: np.ndarray) -> dict:
    """Where each line is; with it, at its first place in a slice, what is compared of it if it may be in a company."""
    ks, ats, ids, lines = [], [], [], []
    for k, text in zip(part.column("k").to_pylist(), part.column("text").to_pylist(), strict=True):
        for at, line in enumerate(text.split("\n")):
            if p := plain(line):
                ks.append(k)
                ats.append(at)
                ids.append(line_id(p))
                lines.append(p)
    ids = np.array(ids, np.int64)
    first = np.zeros(len(ids), bool)
    first[np.unique(ids, return_index=True)[1]] = True
    first &= marked(ids, bits)
    return {"k": pa.array(ks, pa.int64()), "at": pa.array(ats, pa.int32()), "id": ids, "line": pa.array([p if f else None for p, f in zip(lines, first.tolist(), strict=True)], pa.string())}


def _cut(part: pa.RecordBatch) -> dict:
    n_lines, n_removed, kept = [], [], []
    for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
        lines = text.split("\n")
        drop = {g["at"] for g in gone or () if g["at"] < len(lines) and line_id(plain(lines[g["at"]])) == g["id"]}
        n_lines.append(sum(1 for x in lines if x.strip()))
        n_removed.append(len(drop))
        kept.append("\n".join(x for k, x in enumerate(lines) if k not in drop))
    return {"doc_id": part.column("doc_id"), "n_lines": np.array(n_lines, np.int64), "n_removed": np.array(n_removed, np.int64), "kept": pa.array(kept, pa.string())}


def remove_similar_lines(docs: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """One row per document: doc_id, n_lines (not blank), n_removed, kept (the text left).

    Lines are compared by their words joined by one blank, whatever the document. Equal lines,
    and lines whose sets of five-character shingles have a Jaccard similarity of 0.8 or more,
    are linked; of each component the first line stays, by doc_id and place. Candidates share
    a band of MinHash values (recall 0.991 at 0.8, more above); all are verified exactly.
    Lines are named by 64-bit hashes. Over `most` different lines that share a band are verified
    in pairs of blocks, so that no task holds them all and no link is lost.

    Blank lines stay and aren't counted. Lines under five characters are equal or not. Null
    and empty texts have no lines. A null doc_id is the smallest. Rows that share an id and
    a line at one place keep or lose it together. Other columns are not read. An empty table
    gives no rows.
    """
    own = documents_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "doc_id", "text")
    near, at = _similar(own, most)
    first = at.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("k", "at")).alias("first"))
    grouped = first.join(near, F.col("id") == F.col("node"), "left").filter("n > 1 or node is not null").select(
        "id", "first", F.coalesce("component", "id").alias("component")
    )
    grouped = written(grouped, "line-groups")
    stays = grouped.groupBy("component").agg(F.min("first").alias("stays"))
    known = grouped.join(stays, "component").select(F.col("id").alias("g"), "stays")
    gone = at.join(known, F.col("id") == F.col("g")).filter("struct(k, at) <> stays")
    per = gone.groupBy(F.col("k").alias("k1")).agg(F.collect_list(F.struct("at", "id")).alias("gone"))
    return map_rows(own.join(per, F.col("k") == F.col("k1"), "left").select("doc_id", "text", "gone"), _cut, "doc_id long, n_lines long, n_removed long, kept string")
