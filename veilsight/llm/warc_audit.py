"""WARC files and their fixity: Merkle trees over records and ordered offset ranges, compared between replicas."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_code, written

END = "\r\n\r\n"
#: Records of a WARC file; a file is hashed by one task.
FILE_RECORDS = 2_000
#: Files that one task may write.
TASK_FILES = 10_000
#: Children of a node.
FAN = 16
LEAF, NODE = b"\x00", b"\x01"


def write_warc(pages: DataFrame, path: str, as_of: str, change: Callable[[Column, Column], Column] | None = None) -> None:
    """Write pages(page_id, url, html) as gzipped WARC 1.0 resource records.

    Each split of the table gives files of FILE_RECORDS, in the order of page_id, so that
    nothing is shuffled and replicas of one table have the same files. Null html is an empty record, a null page_id or url is
    written as `-`; blanks of a url are escaped. Repeated rows are records each. `change` gets
    the page_id and a record's text and gives what is written, for replicas with known damage.
    """
    own = pages.select(
        pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"].cast("string"), F.lit("-")).alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"),
    )
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.0"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"\s", "%20")), F.lit(f"WARC-Date: {as_of}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2("html", 256)), F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length("html").cast("string")),
    )
    order = [F.col("page_id").asc_nulls_first(), F.xxhash64("url", "html")]
    records = own.sortWithinPartitions(*order)
    # the writer puts the two line breaks that end a record behind each
    record = F.concat(head, F.lit(END), F.col("html"))
    records.select((change(F.col("page_id"), record) if change else record).alias("value")).write.option("lineSep", END).option(
        "maxRecordsPerFile", FILE_RECORDS
    ).option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): WARC files, named by their place, which is the same in all replicas."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    part, more = (F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)", k).cast("long") for k in (1, 2))
    return found.select((part * TASK_FILES + more).alias("file"), "content")


def inflate(data: bytes) -> bytes:
    """Content of a file, gzipped or not; of a damaged one as far as it goes."""
    out = []
    while data[:2] == b"\x1f\x8b":
        stream, at = zlib.decompressobj(31), 0
        try:
            while at < len(data) and not stream.eof:
                out.append(stream.decompress(data[at : at + 65536]))
                at += 65536
        except zlib.error:
            return b"".join(out)
        data = stream.unused_data + data[at:]
    return b"".join(out) if out else data


def records_of(data: bytes) -> list[tuple[int, int, int, int]]:
    """Start, start of the payload, its end and the record's end, of each record. A broken record ends where the next one starts."""
    out, at = [], 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        length = None
        if data.startswith(b"WARC/", at) and head >= 0:
            for line in data[at:head].split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.lower() == b"content-length" and value.strip().isdigit():
                    length = int(value)
        if length is not None and head + 4 + length + 4 <= len(data) and data[head + 4 + length : head + 8 + length] == b"\r\n\r\n":
            end = head + 8 + length
            out.append((at, head + 4, head + 4 + length, end))
        else:
            nxt = data.find(b"\r\n\r\nWARC/", at)
            end = nxt + 4 if nxt >= 0 else len(data)
            out.append((at, end, end, end))
        at = end
    return out


def header(data: bytes, name: bytes) -> str:
    for line in data.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.lower() == name:
            return value.strip().decode("utf-8", "replace")
    return ""


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, offset, length, record_id, payload_length, payload_sha256) of a replica that is taken as it should be."""
    ship_code(spark)

    def parse(batches):
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                data = inflate(data.as_py())
                rows = [
                    {"file": file, "at": k, "offset": s, "length": e - s, "record_id": header(data[s:p], b"warc-record-id"), "payload_length": q - p,
                     "payload_sha256": hashlib.sha256(data[p:q]).hexdigest()}
                    for k, (s, p, q, e) in enumerate(records_of(data))
                ]
                yield pa.RecordBatch.from_pylist(rows, _CATALOGUE)

    return _files(spark, path).mapInArrow(parse, "file long, at long, offset long, length long, record_id string, payload_length long, payload_sha256 string")


_CATALOGUE = pa.schema(
    [(n, pa.int64()) for n in ("file", "at", "offset", "length")] + [("record_id", pa.string()), ("payload_length", pa.int64()), ("payload_sha256", pa.string())]
)
_TREE = pa.schema([("file", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("first", pa.int64()), ("end", pa.int64()), ("hash", pa.binary())])
TREE = "file long, level int, at long, first long, end long, hash binary"


def tree_of(data: bytes, ranges: list[tuple[int, int]]) -> list[list[tuple[int, int, bytes]]]:
    """Levels of a file's tree from the leaves up: first and end offset and hash of each node.

    A leaf hashes its bounds and its bytes, as many as there are; one more leaf holds what
    lies behind the last range.
    """
    end = ranges[-1][1] if ranges else 0
    leaf = lambda a, b: (a, b, hashlib.sha256(LEAF + struct.pack("<QQ", a, b) + data[a:b]).digest())
    levels = [[leaf(a, b) for a, b in ranges] + [(end, end, hashlib.sha256(LEAF + struct.pack("<QQ", end, end) + data[end:]).digest())]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([(g[0][0], g[-1][1], hashlib.sha256(NODE + b"".join(x[2] for x in g)).digest()) for g in (below[k : k + FAN] for k in range(0, len(below), FAN))])
    return levels


def trees(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """(file, level, at, first, end, hash): all nodes of the trees of a replica's files, by the offset ranges of the catalogue.

    A missing file has no nodes. The root of a file is its only node on its highest level.
    """
    ship_code(spark)
    listed = ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("ranges"))  # records of one file
    joined = listed.join(_files(spark, path), "file")

    def build(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                file, data = one.column("file")[0].as_py(), inflate(one.column("content")[0].as_py())
                bounds = [(r["offset"], r["offset"] + r["length"]) for r in one.column("ranges")[0].as_py()]
                rows = [
                    {"file": file, "level": level, "at": at, "first": a, "end": b, "hash": h}
                    for level, nodes in enumerate(tree_of(data, bounds)) for at, (a, b, h) in enumerate(nodes)
                ]
                yield pa.RecordBatch.from_pylist(rows, _TREE)

    return joined.select("file", "ranges", "content").mapInArrow(build, TREE)


def forest(roots: DataFrame) -> list[DataFrame]:
    """Levels (at, hash) over all files, from the files' roots up to the replica's root; a missing file counts as an empty hash."""
    levels = [roots.select(F.col("file").alias("at"), F.col("hash"))]
    most = (roots.agg(F.max("file")).first()[0] or 0) + 1
    while most > 1:
        children = F.array_sort(F.collect_list(F.struct("at", "hash")))  # FAN at most
        level = levels[-1].groupBy(F.floor(F.col("at") / FAN).alias("at")).agg(children.alias("c"))
        levels.append(written(level.select("at", F.unhex(F.sha2(F.concat(F.lit(bytearray(NODE)), F.concat(*[F.coalesce(F.get("c.hash", F.lit(k)), F.lit(bytearray())) for k in range(FAN)])), 256)).alias("hash")), "forest"))
        most = -(-most // FAN)
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    other = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("hash").alias("_hash"))
    match = [F.col(k) == F.col(f"_{k}") for k in keys]
    return a.join(other, match, "left").filter(~F.col("hash").eqNullSafe(F.col("_hash"))).select(*keys)


def audit(spark: SparkSession, good: str, other: str) -> DataFrame:
    """The catalogue of replica `good`, with `intact`: whether `other` has the same bytes in that range.

    Roots are compared first; from there only children of differing nodes are read, through
    the levels over files and then those within files. A file that `other` lacks differs in
    all its records. Bytes behind the last record have no record; damaged_ranges() has them.
    """
    listed = written(catalogue(spark, good), "catalogue")
    bad = damaged_ranges(spark, good, other, listed).select(F.col("file").alias("f"), F.col("first").alias("o"), F.lit(True).alias("bad"))
    return listed.join(bad, (F.col("file") == F.col("f")) & (F.col("offset") == F.col("o")), "left").select(
        *listed.columns, F.col("bad").isNull().alias("intact")
    )


def damaged_ranges(spark: SparkSession, good: str, other: str, listed: DataFrame) -> DataFrame:
    """(file, first, end) of the leaves that differ. Equal bounds, `first` = `end`: bytes behind the last record."""
    a, b = (written(trees(spark, p, listed), "tree") for p in (good, other))
    top = a.groupBy("file").agg(F.max("level").alias("top")).select(F.col("file").alias("f"), "top")
    roots = [written(t.join(top, (t["file"] == F.col("f")) & (t["level"] == F.col("top"))).select("file", "hash", "top"), "roots") for t in (a, b)]
    up, side = (forest(r) for r in roots)
    while len(side) < len(up):
        side.append(side[-1])
    differing = _differing(up[-1], side[-1], ["at"])
    for level in range(len(up) - 2, -1, -1):
        below = up[level].join(differing.select(F.col("at").alias("p")), F.floor(F.col("at") / FAN) == F.col("p"), "left_semi")
        differing = _differing(below, side[level], ["at"])
    nodes = roots[0].join(differing, F.col("file") == F.col("at"), "left_semi").select("file", F.col("top").alias("level"), F.lit(0).cast("long").alias("at"))
    deepest = top.agg(F.max("top")).first()[0] or 0
    nodes = written(nodes, "differing")
    for level in range(deepest - 1, -1, -1):
        parents = nodes.filter(F.col("level") == level + 1).select(F.col("file").alias("pf"), F.col("at").alias("pa"))
        below = a.filter(F.col("level") == level).join(parents, (F.col("file") == F.col("pf")) & (F.floor(F.col("at") / FAN) == F.col("pa")), "left_semi")
        found = _differing(below, b.filter(F.col("level") == level), ["file", "at"]).withColumn("level", F.lit(level)).select("file", "level", "at")
        nodes = written(nodes.filter(F.col("level") <= level).unionByName(found), "differing")
    leaves = nodes.filter("level = 0").select(F.col("file").alias("nf"), F.col("at").alias("na"))
    return a.filter("level = 0").join(leaves, (F.col("file") == F.col("nf")) & (F.col("at") == F.col("na")), "left_semi").select("file", "first", "end")
