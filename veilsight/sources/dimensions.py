"""Dimension tables from stored pages and JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.arrays import evaluated_once
from ..operators.reference import normalize_whitelist
from .pages import TABLE_TAGS, flatten


def _tables(pages: DataFrame) -> DataFrame:
    return flatten(pages, keep=TABLE_TAGS, boilerplate=(), areas=())


def _text(node: Column) -> Column:
    """Text of an element, each piece stripped."""
    pieces = F.slice(F.col("texts"), node["t0"] + 1, node["t1"] - node["t0"])
    return F.array_join(F.transform(pieces, lambda t: t["text"]), "")


def _inside(node: Column, outer: Column) -> Column:
    return (node["id"] > outer["id"]) & (node["id"] <= outer["last"])


def table_rows(pages: DataFrame, min_cells: int) -> DataFrame:
    """(page_id, seq, row, cells, nodes, texts) of the first table body of each page."""
    nodes = F.col("nodes")
    body = F.get(F.filter(nodes, lambda n: n["tag"] == "tbody"), F.lit(0))
    flat = evaluated_once(_tables(pages), "body", body).filter(F.col("body").isNotNull())
    in_body = F.filter(nodes, lambda n: (n["tag"] == "tr") & _inside(n, F.col("body")))
    rows = flat.select(
        "page_id", "nodes", "texts", F.posexplode_outer(in_body).alias("seq", "row")
    ).filter(F.col("row").isNotNull())
    cells = F.filter(nodes, lambda n: (n["tag"] == "td") & _inside(n, F.col("row")))
    return evaluated_once(rows, "cells", cells).filter(F.size("cells") >= min_cells)


def tlds_from_page(pages: DataFrame) -> DataFrame:
    """(tld) of the spans of class domain in the table tld-table."""
    nodes = F.col("nodes")
    table = F.get(F.filter(nodes, lambda n: (n["tag"] == "table") & (n["elem_id"] == "tld-table")), F.lit(0))
    flat = evaluated_once(_tables(pages), "table", table).filter(F.col("table").isNotNull())
    spans = F.filter(
        nodes,
        lambda n: (n["tag"] == "span") & F.array_contains(n["classes"], "domain") & _inside(n, F.col("table")),
    )
    one = flat.select("texts", F.explode_outer(spans).alias("n")).filter(F.col("n").isNotNull())
    return one.select(F.lower(F.regexp_replace(_text(F.col("n")), r"^\.+", "")).alias("tld")).distinct()


def tlds_from_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("tlds array<string>").option("multiLine", True).json(path)
    return raw.select(F.explode("tlds").alias("tld")).select(F.lower("tld").alias("tld")).distinct()


def countries_from_page(pages: DataFrame, with_seq: bool = False) -> DataFrame:
    """(name, continent_code, iso2_code, iso3_code, tld), and seq, the row of the page, if asked for."""
    rows = table_rows(pages, 8)
    cells = F.col("cells")
    shown = F.get(
        F.filter(
            F.col("nodes"),
            lambda n: (n["tag"] == "span") & (n["style"] == "display:table") & _inside(n, cells[2]),
        ),
        F.lit(0),
    )
    raw = F.when(shown.isNotNull(), _text(shown)).otherwise(_text(cells[2]))
    return rows.select(
        S.country_name(raw).alias("name"),
        _text(cells[0]).alias("continent_code"),
        _text(cells[3]).alias("iso2_code"),
        _text(cells[4]).alias("iso3_code"),
        _text(cells[7]).alias("tld"),
        *([F.col("seq").cast("long").alias("seq")] if with_seq else []),
    )


def actors_from_page(pages: DataFrame) -> DataFrame:
    """(mitre_id, name, aliases, description, seq)."""
    rows = table_rows(pages, 4)
    cells = F.col("cells")
    return rows.select(
        _text(cells[0]).alias("mitre_id"),
        _text(cells[1]).alias("name"),
        S.alias_list(_text(cells[2])).alias("aliases"),
        _text(cells[3]).alias("description"),
        F.col("seq").cast("long").alias("seq"),
    )


_SECTIONS = ("domains", "ips", "files", "emails", "md5", "sha1", "sha256")


def whitelist_from_json(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{s} array<string>" for s in _SECTIONS)
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    entries = F.array(*[F.struct(F.lit(s).alias("kind"), F.col(s).alias("vs")) for s in _SECTIONS])
    rows = raw.select(F.explode(entries).alias("e")).select("e.kind", F.explode("e.vs").alias("value"))
    return normalize_whitelist(rows)


def list_from_json(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(value) of a list in a settings file, such as phrases, keywords or sources."""
    raw = spark.read.schema(f"{field} array<string>").option("multiLine", True).json(path)
    return raw.select(F.explode(field).alias("value"))
