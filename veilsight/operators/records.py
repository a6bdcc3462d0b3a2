"""Structured indicators nested for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CSV_COLUMNS
from ..functions import scalars as S
from .enrichment import Structured

_KEY = ["ioc_value", "ioc_type"]
MAX_ITEMS = 10_000


def _parts(batch: Structured, max_items: int) -> DataFrame:
    """Indicators whose lists are too long for one record, and into how many they go."""
    sizes = batch.sources.groupBy(*_KEY).agg(F.count("*").alias("n")).unionByName(
        batch.mentions.groupBy(*_KEY).agg(F.count("*").alias("n"))
    )
    return (
        sizes.filter(F.col("n") > max_items)
        .groupBy(*_KEY)
        .agg(F.ceil(F.max("n") / max_items).cast("long").alias("_parts"))
    )


def records(batch: Structured, as_of: Column | str, max_items: int = MAX_ITEMS) -> DataFrame:
    """One record per indicator, with sorted addresses and mentions as first seen.

    An indicator with more than ``max_items`` addresses or mentions becomes several records
    that share its key and differ in ``part``, from 0 on: nothing is dropped, and no list
    grows with the data. All parts repeat what is said of the whole indicator, its count too.
    """
    parts = _parts(batch, max_items)

    def split(df, item):
        spread = F.pmod(F.xxhash64(*item), F.coalesce("_parts", F.lit(1)))
        return df.join(parts, _KEY, "left").withColumn("part", spread.cast("int"))

    urls = (
        split(batch.sources, ["url"])
        .groupBy(*_KEY, "part")
        .agg(F.sort_array(F.collect_list("url")).alias("source_article_urls"))
    )
    mention = F.struct(
        "seen", "mention_type", "value", "normalized_value", "iso2_code", "description", "context_snippet"
    )
    linked = (
        split(batch.mentions, ["mention_type", "value"])
        .groupBy(*_KEY, "part")
        .agg(F.sort_array(F.collect_list(mention)).alias("_m"))
    )

    def of(kind, *fields):
        chosen = F.transform(
            F.filter("_m", lambda m: m["mention_type"] == kind),
            lambda m: F.struct(*[m[f].alias(f) for f in fields]),
        )
        return F.when(F.size(chosen) > 0, chosen)

    # By the indicator, as both lie by it: the lists themselves are not shuffled to meet by part. An
    # expression of both sides is compared in the join's rows and is no key to shuffle by.
    u, m = urls.withColumnRenamed("part", "_u"), linked.withColumnRenamed("part", "_l")
    same_part = F.col("_u") - F.col("_l") == 0
    both = u.alias("u").join(m.alias("m"), (F.col("u.ioc_value") == F.col("m.ioc_value")) & (F.col("u.ioc_type") == F.col("m.ioc_type")) & same_part, "full_outer")
    nested = both.select(
        *[F.coalesce(f"u.{k}", f"m.{k}").alias(k) for k in _KEY], F.coalesce("_u", "_l").alias("part"), "source_article_urls", "_m"
    )
    return (
        nested.join(batch.iocs, _KEY)
        .select(
            *_KEY,
            S.whole_second(F.lit(as_of).cast("timestamp")).alias("discovery_timestamp"),
            "occurrence_count",
            F.coalesce("source_article_urls", F.array().cast("array<string>")).alias("source_article_urls"),
            "first_seen_context_snippet",
            of("cve", "value", "context_snippet").alias("associated_cves"),
            of("country_mention", "value", "iso2_code", "context_snippet").alias("associated_countries"),
            of("apt_group_mention", "value", "normalized_value", "description", "context_snippet").alias(
                "associated_apts"
            ),
            "part",
        )
    )


def json_records(nested: DataFrame) -> DataFrame:
    """Records with the name their file would have, one for each part; absent lists are left out on writing."""
    key = F.concat_ws("_", F.col("ioc_type"), S.file_name(F.col("ioc_value")))
    part = F.when(F.col("part") > 0, F.concat(F.lit(".part"), F.col("part").cast("string"))).otherwise("")
    return nested.withColumn("file_key", F.concat(key, part, F.lit(".json")))


def csv_records(nested: DataFrame) -> DataFrame:
    """The flat columns, in order, all as text but the count, and the part of the indicator's lists."""

    def joined(items, field):
        return F.coalesce(F.array_join(F.transform(F.col(items), field), ";"), F.lit(""))

    values = {
        "discovery_timestamp": F.date_format("discovery_timestamp", "yyyy-MM-dd HH:mm:ssXXX"),
        "source_article_urls": S.join_list(F.col("source_article_urls"), "|"),
        "first_seen_context_snippet": S.one_line(F.coalesce("first_seen_context_snippet", F.lit(""))),
        "associated_cves": joined("associated_cves", lambda m: m["value"]),
        "associated_countries": joined("associated_countries", lambda m: m["value"]),
        "associated_apts": joined("associated_apts", lambda m: m["value"]),
        "normalized_apts": joined(
            "associated_apts", lambda m: F.coalesce(m["normalized_value"], m["value"])
        ),
    }
    return nested.select(*[values.get(c, F.col(c if c in nested.columns else "ioc_value")).alias(c) for c in CSV_COLUMNS], "part")
