"""Merkle manifest of a dataset, with a witness for each row.

Digests are appended to a tree one after another. A subtree that is still open carries a
partial witness, to which every later sibling adds itself when it is complete; leaves below
share it. Tasks do so for aligned blocks of leaves; the roots of blocks are then appended
in the same way, block by block, until one node of a group is left, and the roots of groups
make the last tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ship_code, written

FAN = 3
#: Levels that one task folds; a block is FAN ** LEVELS digests.
LEVELS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WITNESS = "array<struct<left:string,right:string>>"


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


class Node:
    """A complete subtree: its digest, its siblings so far as hex texts to its left and right, and what it is part of."""

    __slots__ = ("digest", "left", "right", "up")

    def __init__(self, value: str, left: str = ""):
        self.digest, self.left, self.right, self.up = value, left, "", None


class Appender:
    """A tree of at most FAN ** levels digests, appended in order."""

    def __init__(self, levels: int = LEVELS):
        self.open: list[list[Node]] = [[] for _ in range(levels + 1)]
        self.leaves: list[Node] = []

    def append(self, value: str) -> None:
        self.leaves.append(self._add(0, value))

    def _add(self, level: int, value: str) -> Node:
        run = self.open[level]
        node = Node(value, "".join([n.digest for n in run]))
        for n in run:  # a sibling is complete: witnesses of the open ones grow
            n.right += value
        run.append(node)
        if len(run) == FAN and level + 1 < len(self.open):
            self._complete(level)
        return node

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        up = self._add(level + 1, digest("".join([n.digest for n in run])))
        for n in run:
            n.up = up

    def close(self, alone: bool) -> str:
        """The root. `alone`: as soon as one node is left; else runs that are open are completed on every level."""
        for level in range(len(self.open) - 1):
            if alone and len(self.open[level]) == 1 and not any(self.open[level + 1 :]):
                return self.open[level][0].digest
            if self.open[level]:
                self._complete(level)
        return self.open[-1][0].digest

    def witnesses(self) -> Iterator[tuple[list[str], list[str]]]:
        """Of each leaf, level by level: the siblings to the left and to the right."""
        for node in self.leaves:
            left, right = [], []
            while node.up is not None:
                left.append(node.left)
                right.append(node.right)
                node = node.up
            yield left, right


def field(value: Column, size: Column) -> Column:
    return F.coalesce(F.concat(size.cast("string"), F.lit(":"), value), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    """SHA-256 in lowercase hex of a row: each value as `-` if null, else byte count, `:` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[field(t, F.octet_length(t)) for t in texts]), 256)


def more(df: DataFrame, ddl: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes(g, digest, `order` and others) with i, the place in its group by `order`, and total, the group's rows.

    Rows are sorted by ranges over all groups, so that a group of any size is spread. A task
    counts within its own stretch of each group; where stretches begin is a sum over (stretch,
    group), a row each. Rows equal in `order` take any order.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "row")]
    rows = written(nodes.withColumn("row", F.monotonically_increasing_id()), f"{name}-rows")
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("row").withColumn("part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g")
            starts = np.flatnonzero(np.r_[True, np.asarray(pc.not_equal(g[1:], g[:-1]), bool)])
            at = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.r_[starts, batch.num_rows]))
            head = int(starts[1]) if len(starts) > 1 else batch.num_rows
            if g[0].as_py() == group:
                at[:head] += before
            group, before = g[-1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "at"])

    placed = written(dealt.mapInArrow(count, more(dealt, "at long")), f"{name}-sorted")
    stretches = placed.groupBy(F.col("g").alias("sg"), F.col("part").alias("sp")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sg").orderBy("sp").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("sg", "sp", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy("sg")).alias("total"))
    joined = placed.join(stretches, (F.col("g") == F.col("sg")) & (F.col("part") == F.col("sp")))
    return joined.withColumn("i", F.col("first") + F.col("at")).drop("sg", "sp", "first", "at", "part")


def together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes(g, i, total, digest and others) with the witness inside its block, and `top`, the block's root, in the block's first row."""
    size = FAN**levels
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.withColumn("block", F.expr(f"i div {size}")).repartition(parts, "g", "block").sortWithinPartitions("g", "i")
    names = dealt.columns

    def close(tree: Appender, rows: list[pa.RecordBatch], total: int) -> pa.RecordBatch:
        top = tree.close(total <= size)
        pairs = [[{"left": a, "right": b} for a, b in zip(x, y, strict=True)] for x, y in tree.witnesses()]
        table = together(rows)
        tops = [top, *[None] * (len(pairs) - 1)]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.RecordBatch.from_arrays([*table.columns, pa.array(pairs, kind), pa.array(tops, pa.string())], names=[*names, "witness", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rows, key, total = Appender(levels), [], None, 0
        done: list[pa.RecordBatch] = []
        for batch in batches:
            keys = list(zip(batch.column("g").to_pylist(), batch.column("block").to_pylist(), strict=True))
            digests, totals = batch.column("digest").to_pylist(), batch.column("total").to_pylist()
            at = 0
            for k, own in enumerate(keys):
                if own != key:
                    if k > at:
                        rows.append(batch.slice(at, k - at))
                    if rows:
                        done.append(close(tree, rows, total))
                    if len(done) >= 64:
                        yield together(done)
                        done = []
                    tree, rows, key, at, total = Appender(levels), [], own, k, totals[k]
                tree.append(digests[k])
            if len(keys) > at:
                rows.append(batch.slice(at))
        if rows:
            yield together([*done, close(tree, rows, total)])

    return dealt.mapInArrow(run, more(dealt, f"witness {WITNESS}, top string")).drop("block")


def trees(nodes: DataFrame, order: list[str], name: str, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """nodes(g, digest, `order` and others) -> the rounds of blocks(), and (g, digest): the root of each group.

    Roots of blocks are the nodes of the next round, until a block is all of its group.
    """
    ship_code(nodes.sparkSession)
    size = FAN**levels
    rounds = [written(blocks(ranked(nodes, order, name), levels), f"{name}-0")]
    most = rounds[0].agg(F.max("total")).first()[0] or 0
    while most > size:
        tops = rounds[-1].filter(F.col("top").isNotNull())
        up = tops.select("g", F.expr(f"i div {size}").alias("i"), F.expr(f"(total + {size - 1}) div {size}").alias("total"), F.col("top").alias("digest"))
        rounds.append(written(blocks(up, levels), f"{name}-{len(rounds)}"))
        most = -(-most // size)
    return rounds, rounds[-1].filter("i = 0").select("g", F.col("top").alias("digest"))


def whole(rounds: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The rows of the first round with witness, all the way up, and the columns of above(g, witness and others), a row for each group.

    What is above goes down round by round. At most FAN ** levels rows meet one row of the
    round above, so no key is hot, whatever the size of a group.
    """
    size = FAN**levels
    extra = [c for c in above.columns if c not in ("g", "witness")]
    out = above.select(F.col("g").alias("ug"), F.lit(0).cast("long").alias("uk"), F.col("witness").alias("rest"), *extra)
    for k, lower in reversed(list(enumerate(rounds))):
        met = lower.join(out, (F.col("g") == F.col("ug")) & (F.expr(f"i div {size}") == F.col("uk")))
        up = F.concat("witness", "rest")
        if not k:
            return met.withColumn("witness", up).drop("ug", "uk", "rest", "top", "total")
        out = met.select(F.col("g").alias("ug"), F.col("i").alias("uk"), up.alias("rest"), *extra)
    raise ValueError("no rounds")


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give."""
    return F.aggregate(witness, leaf, lambda x, w: F.sha2(F.concat(w["left"], x, w["right"]), 256))


def siblings(witness: Column) -> Column:
    """All digests of a witness in one text, from the leaf up, left to right."""
    return F.array_join(F.transform(witness, lambda w: F.concat(w["left"], w["right"])), "")


def manifest(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of `docs`: doc_id, source, leaf, now, subroot, root, witness (up to the root).

    Leaves are digests of FIELDS. Those of a source are in the order of doc_id (null first;
    equal ids by leaf); subroots in that of source (null first, bytewise). `now` is the leaf
    with the text `changed`, an expression over `docs`, or null where that is null. The
    digest of one row is its own subroot, and that of one source the root. Null values have a
    mark of their own; other columns don't count. Repeated rows are leaves each. An empty
    table gives no rows.
    """
    own = [docs[c].cast("long") if c == "doc_id" else docs[c] for c in FIELDS]
    text = docs["text"].cast("string")
    now = F.when(changed.isNotNull(), row_digest([*own[:-1], F.coalesce(changed, text)])) if changed is not None else F.lit(None).cast("string")
    leaves = docs.select(
        # a null source comes before the empty one
        F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("")).alias("g"), own[0].alias("doc_id"), docs["source"].cast("string").alias("source"),
        row_digest([*own[:-1], text]).alias("digest"), now.alias("now"),
    )
    rounds, tops = trees(leaves, ["doc_id", "digest"], "leaves", levels)
    subroots = tops.select(F.lit("").alias("g"), F.col("g").alias("group"), "digest")
    top_rounds, root = trees(subroots, ["group"], "sources", levels)
    none = F.array().cast(WITNESS)
    sources = whole(top_rounds, root.select("g", none.alias("witness"), F.col("digest").alias("root")), levels)
    sources = written(sources.select(F.col("group").alias("g"), "witness", F.col("digest").alias("subroot"), "root"), "manifest-sources")
    return whole(rounds, sources, levels).select("doc_id", "source", F.col("digest").alias("leaf"), "now", "subroot", "root", "witness")


def audited(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """manifest() of documents, each leaf folded again: where 2 divides the crc32 of doc_id, from the text without line feeds.

    proof_sha256 is the digest of a row's siblings; verified says whether the folded root is the root.
    """
    changed = F.when(F.crc32(docs["doc_id"].cast("long").cast("string")) % 2 == 0, F.translate(docs["text"].cast("string"), "\n", ""))
    out = manifest(docs, changed, levels)
    out = out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("witness")), 256).alias("proof_sha256"),
        folded(F.coalesce("now", "leaf"), F.col("witness")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
