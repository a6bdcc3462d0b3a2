"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_code, written

__all__ = ["ascii_lower", "documents_of", "keep_rows", "map_rows", "read", "sorted_runs", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of one Arrow batch that are handled at once; a row is never split, so long texts go one by one.
BATCH_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_and(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of the row that goes along, whatever its columns are called, and of new columns."""
    return T.StructType([df.schema["row"], *T.StructType.fromDDL(ddl).fields])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def documents_of(docs: DataFrame) -> DataFrame:
    """doc_id long and text string (null text becomes empty), whatever other columns there are."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or with `row.` a field of the row that goes along."""
    if name.startswith("row."):
        row = batch.column("row")
        return pc.struct_field(row, name[4:])
    return batch.column(name)


def texts_of(batch: pa.RecordBatch, name: str = "row.text") -> list[str]:
    """Texts; null is empty."""
    return [t or "" for t in column_of(batch, name).cast(pa.string()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about `most` bytes in one column, a row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column_of(batch, column).cast(pa.string())), 0)).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.array([], int)
    for a, b in zip(starts, np.r_[starts[1:], len(part)], strict=True):
        yield batch.slice(int(a), int(b - a))


def map_rows(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str | T.StructType, text: str = "text", most: int = BATCH_BYTES) -> DataFrame:
    """`make` turns a few rows into columns of `schema`, in Arrow batches bounded by bytes of `text`."""
    ship_code(df.sparkSession)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, most):
                columns = make(part)
                yield pa.RecordBatch.from_arrays([as_array(columns[n]) for n in names], names=names)
            del batch
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def as_array(values) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values if isinstance(values, pa.Array) else pa.array(values)


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[tuple[np.ndarray | None, np.ndarray | None, dict[str, np.ndarray]]]:
    """Of rows sorted by a long key: starts and ends of whole runs with two rows or more, and the columns.

    Rows of a key that goes on in the next batch wait for it. A run of which over `most` rows
    wait comes in pieces instead, without starts and ends.
    """
    cut = None
    rest: dict[str, np.ndarray] | None = None
    waiting: list[dict[str, np.ndarray]] = []

    def whole(columns):
        keys = columns[key]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        many = ends - starts > 1
        return starts[many], ends[many], columns

    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if cut is not None:
            head = int(np.searchsorted(now[key], cut, side="right"))
            if head:
                yield None, None, {n: v[:head] for n, v in now.items()}
            now = {n: v[head:] for n, v in now.items()}
            if not len(now[key]):
                continue
            cut = None
        if waiting and now[key][-1] == waiting[0][key][0]:
            waiting.append(now)
            if most is not None and sum(len(w[key]) for w in waiting) > most:
                cut = waiting[0][key][0]
                yield None, None, {n: np.concatenate([w[n] for w in waiting]) for n in now}
                waiting = []
            continue
        if waiting:
            now = {n: np.concatenate([*(w[n] for w in waiting), now[n]]) for n in now}
        last = int(np.searchsorted(now[key], now[key][-1], side="left"))
        rest, waiting = {n: v[:last] for n, v in now.items()}, [{n: v[last:] for n, v in now.items()}]
        if last:
            yield whole(rest)
    if waiting:
        yield whole({n: np.concatenate([w[n] for w in waiting]) for n in waiting[0]})


def keep_rows(docs: DataFrame, kept: DataFrame, norm: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """The rows of `docs` named by kept(keep_id, keep_sha256), one row for each, with the columns of `docs`.

    keep_sha256 is that of norm(text), a null text being empty. Ids are compared null-safely.
    Of rows that share a kept id and such a text, one stays.
    """
    text = norm(F.coalesce(docs["text"].cast("string"), F.lit("")))
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.sha2(text, 256).alias("h"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    ids = kept.select(F.col("keep_id").alias("k"), F.col("keep_sha256").alias("kh")).distinct()
    found = rows.join(ids, (rows["h"] == ids["kh"]) & rows["id"].eqNullSafe(ids["k"]), "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "h").orderBy("h"))
    return found.withColumn("n", first).filter("n = 1").select("row.*")
