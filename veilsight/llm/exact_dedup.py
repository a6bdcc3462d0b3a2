"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents_of, keep_rows, written

#: A chunk ends after white space that follows one of these letters, at 256 characters or more; at 2,048 at the latest.
LEAST_CHUNK, MOST_CHUNK, CUT_AFTER = 256, 2048, "dkmst."


def chunks(text):
    """The text cut where its content says so, so that an edit changes the chunks near it only. Joined they are the text."""
    cut = rf"(?s).{{{LEAST_CHUNK},{MOST_CHUNK}}}?(?<=[{CUT_AFTER}])\s|.{{1,{MOST_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(cut), 0)


def _keys(chunk):
    return F.struct(F.xxhash64(chunk).alias("h"), F.xxhash64(F.lit("second"), chunk).alias("h2"))


def recipes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, doc_id, text_sha256, keys), written once without texts; and all chunks (h, h2, chunk)."""
    norm = documents_of(docs).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    base = written(
        norm.select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", F.sha2("norm", 256).alias("text_sha256"),
            F.transform(chunks(F.col("norm")), _keys).alias("keys"),
        ),
        "recipes",
    )
    return base, norm.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk")


def unverified(parts: DataFrame) -> DataFrame:
    """Hashes that stand for two chunks or more. Whole chunks are compared; each moves once per task that has it."""
    different = parts.groupBy("h", "chunk").agg(F.count("*").alias("n"))
    return different.groupBy("h").agg(F.count("*").alias("contents")).filter("contents > 1").select("h")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Chunks are deduplicated to
    identifiers: a chunk's hash, once all chunks with that hash have been compared and are
    the same; else both of its hashes. Documents are equal when their ordered identifier
    lists are, and their SHA-256. The texts move as distinct chunks only; the lists are
    compared without them.

    Null text counts as empty; empty texts are equal to each other (an empty list). Of equal
    texts the row with the largest doc_id stays, a null doc_id being smallest; of rows that
    also share the doc_id, exactly one. Other columns of `docs` are not read. An empty table
    gives no rows.
    """
    base, parts = recipes(docs)
    bad = unverified(parts)
    elements = base.select("row_id", F.posexplode("keys").alias("at", "key")).select("row_id", "at", "key.h", "key.h2")
    clashing = elements.join(bad, "h", "left_semi").select("row_id").distinct().withColumn("clash", F.lit(True))
    listed = base.join(clashing, "row_id", "left").select(
        "row_id", "doc_id", "text_sha256",
        F.transform("keys", lambda k: k["h"]).alias("recipe"),
        F.when(F.col("clash"), F.transform("keys", lambda k: k["h2"])).otherwise(F.array().cast("array<bigint>")).alias("more"),
    )
    same = ["recipe", "more", "text_sha256"]
    groups = listed.groupBy(*same).agg(
        F.count("*").alias("group_size"), F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row_id")).alias("last")
    )
    found = listed.join(groups.select(*[F.col(c).alias(f"g_{c}") for c in same], "group_size", "last"), [F.col(c) == F.col(f"g_{c}") for c in same])
    return found.select(
        "row_id", "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("last.row_id")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    return keep_rows(docs, exact_duplicates(docs).filter("kept").select("keep_id", F.col("text_sha256").alias("keep_sha256")), ascii_lower)
