"""Stored feed documents as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FEED = (
    "channel struct<item: array<struct<link: string>>>, "
    "item array<struct<link: string>>, "
    "entry array<struct<link: array<struct<_href: string, _rel: string>>>>"
)


def feed_links(feeds: DataFrame) -> DataFrame:
    """(source_url, url) of feeds(source_url, body): RSS, RDF items and Atom entries.

    Feed links are taken as they are; a body that is no feed gives none.
    """
    parsed = feeds.select(
        "source_url", F.from_xml(F.col("body"), _FEED, {"mode": "PERMISSIVE"}).alias("f")
    )

    def atom(entry):
        page = F.filter(entry["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        return F.coalesce(F.get(page, F.lit(0))["_href"], F.get(entry["link"], F.lit(0))["_href"])

    none = F.array().cast("array<string>")
    links = F.concat(
        F.coalesce(F.transform(F.col("f.channel.item"), lambda i: i["link"]), none),
        F.coalesce(F.transform(F.col("f.item"), lambda i: i["link"]), none),
        F.coalesce(F.transform(F.col("f.entry"), atom), none),
    )
    exploded = parsed.select("source_url", F.explode_outer(links).alias("url"))
    return exploded.withColumn("url", F.trim("url")).filter(F.col("url") != "")
