"""Article links of pages and the choice of what to scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_LINK_KEYWORDS, LINK_BLACKLIST, MIN_LINK_SCORE, RESCAN_DAYS
from ..functions import scalars as S
from ..functions import urls as U
from ..functions.arrays import evaluated_once
from ..functions.textmatch import strip


def page_anchors(flat: DataFrame, all_anchors: bool = False) -> DataFrame:
    """(page_id, source_url, href, link_text) of the link areas, else of the whole page."""

    def is_link(n):
        return (n["tag"] == "a") & n["href"].isNotNull()

    nodes, texts = F.col("nodes"), F.col("texts")
    every = F.filter(nodes, is_link)
    in_area = F.filter(nodes, lambda n: is_link(n) & (n["area"] >= 0))
    chosen = every if all_anchors else F.when(F.exists(nodes, lambda n: n["is_area"]), in_area).otherwise(every)
    links = F.transform(
        chosen,
        lambda n: F.struct(
            n["href"].alias("href"),
            F.array_join(
                F.transform(F.slice(texts, n["t0"] + 1, n["t1"] - n["t0"]), lambda t: t["text"]), ""
            ).alias("link_text"),
        ),
    )
    out = flat.select("page_id", F.col("url").alias("source_url"), F.explode_outer(links).alias("l"))
    return out.filter(F.col("l").isNotNull()).select("page_id", "source_url", "l.*")


def same_site(anchors: DataFrame) -> DataFrame:
    """Resolved links to the own host that name no fragment, with their ``path``."""
    href = F.col("href")
    worth = anchors.filter((href != "") & ~strip(href).isin("#", "/"))
    resolved = evaluated_once(worth, "url", U.resolve(F.col("source_url"), href))
    return resolved.filter(
        (U.authority(F.col("url")) == U.authority(F.col("source_url"))) & (U.fragment(F.col("url")) == "")
    ).withColumn("path", U.path(F.col("url")))


def wanted_paths(links: DataFrame, keywords=DEFAULT_LINK_KEYWORDS) -> DataFrame:
    """Links with a path and a text whose path hits no blacklist pattern."""
    pattern = "(?iu)" + "|".join(f"(?:{k})" for k in (*LINK_BLACKLIST, *keywords))
    path = F.col("path")
    return links.filter((path != "") & (F.col("link_text") != "") & ~path.rlike(pattern))


def link_score(text: Column, path: Column) -> Column:
    words = S.word_count(text)
    points = [
        F.when(words >= 4, 2).when(words >= 3, 1).otherwise(0),
        F.when(S.char_count(path, "/") >= 3, 1).otherwise(0),
        F.when(path.rlike(r"/\p{Nd}{4}/\p{Nd}{2}/") | path.endswith(".html") | path.endswith(".htm"), 1).otherwise(0),
        F.when(~path.endswith("/"), 1).otherwise(0),
    ]
    return reduce(lambda a, b: a + b, points)


def scored_links(flat: DataFrame, keywords=DEFAULT_LINK_KEYWORDS, all_anchors: bool = False) -> DataFrame:
    links = wanted_paths(same_site(page_anchors(flat, all_anchors)), keywords)
    return evaluated_once(links, "score", link_score(F.col("link_text"), F.col("path")))


def article_links(flat: DataFrame, keywords=DEFAULT_LINK_KEYWORDS, min_score: int = MIN_LINK_SCORE,
                  all_anchors: bool = False) -> DataFrame:
    """Distinct (source_url, url) of links that look like articles."""
    scored = scored_links(flat, keywords, all_anchors)
    return scored.filter(F.col("score") >= min_score).select("source_url", "url").distinct()


def links_of_sources(feed_links: DataFrame, html_links: DataFrame) -> DataFrame:
    """All distinct links; a source with feed links does not use its page."""
    from_pages = html_links.join(feed_links.select("source_url").distinct(), "source_url", "left_anti")
    return feed_links.select("url").unionByName(from_pages.select("url")).distinct()


def due_links(links: DataFrame, history: DataFrame, as_of: Column | str, days: int = RESCAN_DAYS) -> DataFrame:
    """Links never scanned or last scanned more than ``days`` ago.

    An address with an unknown scan time is left out.
    """
    known = history.select("url", "last_scanned", F.lit(True).alias("_known"))
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days")
    return (
        links.join(known, "url", "left")
        .filter(F.col("_known").isNull() | (F.col("last_scanned") < limit))
        .select(*links.columns)
    )


def split_known(urls: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Addresses in the history and addresses that are not."""
    known = history.select("url")
    return urls.join(known, "url", "left_semi"), urls.join(known, "url", "left_anti")
