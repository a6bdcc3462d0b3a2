"""Article text of flattened pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    ARTICLE_CONTAINERS,
    CONTAINER_KEYWORDS,
    KEYWORD_CONTAINER_TAGS,
    MIN_ARTICLE_CHARS,
    SEMANTIC_CONTAINERS,
    TEXT_BLOCKS,
)
from ..functions.arrays import let
from ..functions.textmatch import SPACE, strip


def _first(nodes: Column, condition) -> Column:
    return F.get(F.filter(nodes, condition), F.lit(0))


def _is(selector: str):
    """Condition of a selector of the form tag.class or tag#id."""
    sign = "#" if "#" in selector else "."
    tag, name = selector.split(sign)
    if sign == "#":
        return lambda n: (n["tag"] == tag) & (n["elem_id"] == name)
    return lambda n: (n["tag"] == tag) & F.array_contains(n["classes"], name)


def known_container(nodes: Column) -> Column:
    """First selector in list order that hits, first hit in page order."""
    return F.coalesce(*[_first(nodes, _is(s)) for s in ARTICLE_CONTAINERS])


def semantic_container(nodes: Column) -> Column:
    return F.coalesce(*[_first(nodes, _has_tag(t)) for t in SEMANTIC_CONTAINERS])


def _has_tag(tag: str):
    return lambda n: n["tag"] == tag


def keyword_container(nodes: Column) -> Column:
    """The element with most text whose id or classes sound like content."""

    def sounds_right(n):
        words = F.lower(F.concat(F.coalesce(n["elem_id"], F.lit("")), F.lit(" "), F.array_join(n["classes"], " ")))
        return n["tag"].isin(*KEYWORD_CONTAINER_TAGS) & words.rlike("|".join(CONTAINER_KEYWORDS))

    ranked = F.transform(
        F.filter(nodes, sounds_right),
        lambda n: F.struct(n["chars"].alias("chars"), (-n["id"]).alias("early"), n.alias("node")),
    )
    return F.array_max(ranked)["node"]


def _texts_in(texts: Column, node: Column) -> Column:
    return F.slice(texts, node["t0"] + 1, node["t1"] - node["t0"])


def block_text(nodes: Column, texts: Column, container: Column, dedupe_nested: bool = False) -> Column:
    """Text blocks of a container without boilerplate, one per line.

    A block inside a block repeats its text unless ``dedupe_nested``.
    """
    inside = F.filter(
        nodes,
        lambda n: n["tag"].isin(*TEXT_BLOCKS)
        & (n["id"] > container["id"])
        & (n["id"] <= container["last"])
        & (n["boiler"] <= container["id"]),
    )
    if dedupe_nested:
        # In page order a block is nested when an earlier one has not ended.
        state = F.struct(F.lit(-1).alias("end"), F.slice(inside, 1, 0).alias("kept"))
        inside = F.aggregate(
            inside,
            state,
            lambda acc, n: F.when(n["id"] <= acc["end"], acc).otherwise(
                F.struct(n["last"].alias("end"), F.concat(acc["kept"], F.array(n)).alias("kept"))
            ),
        )["kept"]

    def text_of(n):
        own = F.filter(_texts_in(texts, n), lambda t: t["boiler"] <= container["id"])
        return F.array_join(F.transform(own, lambda t: t["text"]), " ")

    return F.array_join(F.filter(F.transform(inside, text_of), lambda b: b != ""), "\n")


def body_text(nodes: Column, texts: Column) -> Column:
    def text_of(body):
        return F.array_join(F.transform(_texts_in(texts, body), lambda t: t["text"]), "\n")

    return F.coalesce(let(_first(nodes, _has_tag("body")), text_of), F.lit(""))


def tidy(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"[{SPACE}]{{2,}}", " "))


def article_text(flat: DataFrame, min_chars: int = MIN_ARTICLE_CHARS, dedupe_nested: bool = False) -> DataFrame:
    """Pages with ``text`` (null when there is none worth keeping) and ``status``."""
    nodes, texts = F.col("nodes"), F.col("texts")
    container = F.coalesce(known_container(nodes), semantic_container(nodes), keyword_container(nodes))
    raw = let(
        container,
        lambda c: F.when(c.isNull(), body_text(nodes, texts)).otherwise(
            block_text(nodes, texts, c, dedupe_nested)
        ),
    )
    cleaned = flat.withColumn("_text", let(raw, tidy)).drop("nodes", "texts")
    long_enough = F.length("_text") > min_chars
    return cleaned.select(
        *[c for c in cleaned.columns if c != "_text"],
        F.when(long_enough, F.col("_text")).alias("text"),
        F.when(long_enough, "ok").when(F.col("_text") == "", "no_text").otherwise("too_short").alias("status"),
    )


def article_batch(urls: DataFrame, texts: DataFrame) -> DataFrame:
    """All wanted addresses with their text; failed ones stay with a null text."""
    return urls.select("article_idx", "url").join(texts.select("url", "text"), "url", "left").select(
        "article_idx", "url", "text"
    )
