"""Aggregates, search and history views over indicators and sightings.

Counts aggregate partially before the shuffle; only the ordered, limited tops are sorted,
and ties are broken by name so that results are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import urls as U
from ..functions.arrays import evaluated_once

ALL = "Alle"


def _by_month(sightings: DataFrame, *counts: Column) -> DataFrame:
    """Counts per month; the month is formatted once per group, not once per row."""
    grouped = sightings.groupBy(F.date_trunc("month", "sighting_timestamp").alias("_month")).agg(*counts)
    return grouped.select(
        S.month_key(F.col("_month")).alias("month"), *[c for c in grouped.columns if c != "_month"]
    )


def monthly_iocs(sightings: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return _by_month(sightings, count("ioc_id").alias("ioc_count"))


def monthly_sightings(sightings: DataFrame) -> DataFrame:
    return _by_month(sightings, F.count("*").alias("sighting_count"))


def monthly_series(sightings: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """The last ``months`` months up to ``as_of``, oldest first, with zeros in gaps."""
    spark = sightings.sparkSession
    this = F.trunc(F.lit(as_of).cast("date"), "MM")
    calendar = spark.range(1).select(
        F.explode(
            F.sequence(F.add_months(this, -(months - 1)), this, F.expr("interval 1 month"))
        ).alias("first_day")
    )
    # The series is a dozen rows; months outside it are filtered before counting.
    start = F.add_months(this, -(months - 1))
    recent = sightings.filter(
        (F.col("sighting_timestamp") >= start) & (F.col("sighting_timestamp") < F.add_months(this, 1))
    )
    counts = _by_month(
        recent, F.countDistinct("ioc_id").alias("ioc_count"), F.count("*").alias("sighting_count")
    )
    return (
        calendar.withColumn("month", S.month_key(F.col("first_day")))
        .join(counts, "month", "left")
        .select(
            "month",
            S.month_label(F.col("first_day")).alias("label"),
            F.coalesce("ioc_count", F.lit(0)).alias("ioc_count"),
            F.coalesce("sighting_count", F.lit(0)).alias("sighting_count"),
        )
        .orderBy("month")
    )


def _top(counted: DataFrame, name: str, count: str, limit: int) -> DataFrame:
    return counted.orderBy(F.desc(count), F.asc(name)).limit(limit)


def top_ioc_types(iocs: DataFrame, limit: int = 7) -> DataFrame:
    return _top(iocs.groupBy("type").agg(F.count("*").alias("ioc_count")), "type", "ioc_count", limit)


def top_linked(links: DataFrame, dimension: DataFrame, link: str, name: str, limit: int = 5) -> DataFrame:
    """Most sighted actors or countries, from links (one row per sighting and entry).

    Links are counted before names are joined, so the join sees one row per actor or
    country instead of one per sighting; a link exists only with its sighting.
    """
    counted = links.groupBy(link).agg(F.count("*").alias("_n"))
    named = counted.join(dimension.select(link, name), link).groupBy(name).agg(
        F.sum("_n").alias("sighting_count")
    )
    return _top(named, name, "sighting_count", limit)


def top_sources(sightings: DataFrame, limit: int = 5) -> DataFrame:
    hosts = evaluated_once(
        sightings.select("source_article_url"), "domain", U.authority(F.col("source_article_url"))
    )
    counted = hosts.filter(F.col("domain") != "").groupBy("domain").agg(F.count("*").alias("sighting_count"))
    return _top(counted, "domain", "sighting_count", limit)


def scanned_domains(history: DataFrame) -> DataFrame:
    """Distinct hosts of scanned addresses, sorted, behind the entry for all."""
    hosts = history.filter(F.coalesce("url", F.lit("")) != "").select(
        U.authority(F.col("url")).alias("domain")
    ).distinct()
    every = history.sparkSession.range(1).select(F.lit(ALL).alias("domain"), F.lit(0).alias("_rank"))
    return (
        every.unionByName(hosts.withColumn("_rank", F.lit(1)))
        .orderBy("_rank", "domain")
        .select("domain")
    )


def last_sightings(sightings: DataFrame, prefix: str = "") -> DataFrame:
    """Latest sighting per address under a prefix."""
    chosen = sightings.filter(S.starts_ignoring_case(F.col("source_article_url"), prefix))
    return chosen.groupBy("source_article_url").agg(
        F.max("sighting_timestamp").alias("last_sighting")
    )


def history_under(history: DataFrame, prefix: str = "") -> DataFrame:
    if not prefix:
        return history.select("url", "last_scanned")
    return history.filter(S.starts_ignoring_case(F.col("url"), prefix)).select("url", "last_scanned")


def search_iocs(iocs: DataFrame, sightings: DataFrame, kind: str | None = None,
                value: str | None = None, literal: bool = False) -> DataFrame:
    """Indicators of a type whose value contains a text, with their sightings counted.

    Sightings of other indicators are dropped before they are counted, so a selective search
    shuffles little. Indicators without sightings are kept.
    """
    chosen = iocs
    if kind and kind != ALL:
        chosen = chosen.filter(F.col("type") == kind.lower())
    if value:
        chosen = chosen.filter(S.contains_ignoring_case(F.col("value"), value, literal))
    seen = sightings
    if chosen is not iocs:
        seen = sightings.join(chosen.select("ioc_id"), "ioc_id", "left_semi")
    counted = seen.groupBy("ioc_id").agg(
        F.count("*").alias("sources"), F.max("sighting_timestamp").alias("last_sighting")
    )
    return chosen.join(counted, "ioc_id", "left").withColumn(
        "sources", F.coalesce("sources", F.lit(0))
    )


_SORT_KEYS = {"ioc_value": "value", "type": "type", "sources": "sources", "last_sighting": "last_sighting"}


def sort_search(found: DataFrame, by: str | None = None, descending: bool = False,
                newest: str = "first_seen_timestamp") -> DataFrame:
    """By a column, or newest first; indicators never seen sort below all dates."""
    tie = [F.desc(newest), F.asc("ioc_id")]
    if by is None:
        return found.orderBy(*tie)
    key = F.col(_SORT_KEYS.get(by, "ioc_id"))
    return found.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), *tie)


def search_display(found: DataFrame) -> DataFrame:
    return found.select("value", "type", "sources", S.day_or_na(F.col("last_sighting")).alias("last_sighting"))


def ioc_details(ioc_id, iocs, sightings, actors=None, countries=None, cves=None) -> DataFrame:
    """Sightings of one indicator with the names linked to each.

    The id filter is applied to every input before the joins. The lists are per sighting,
    bounded by what one record mentions.
    """
    wanted = iocs.filter(F.col("ioc_id") == ioc_id).select("ioc_id", "value", "type")
    seen = sightings.filter(F.col("ioc_id") == ioc_id)
    out = wanted.join(seen, "ioc_id", "left")
    for name, link in (("actors", actors), ("countries", countries), ("cves", cves)):
        if link is None:
            continue
        of_ioc = link.join(seen.select("sighting_id"), "sighting_id", "left_semi")
        listed = of_ioc.groupBy("sighting_id").agg(
            F.array_join(F.sort_array(F.collect_set("name")), ", ").alias(name)
        )
        out = out.join(listed, "sighting_id", "left")
    return out


def search_history(history: DataFrame, domain: str | None = None, keyword: str | None = None) -> DataFrame:
    chosen = history
    if domain and domain != ALL:
        chosen = chosen.filter(S.contains_ignoring_case(F.col("url"), domain))
    if keyword:
        chosen = chosen.filter(S.contains_ignoring_case(F.col("url"), keyword))
    return sort_history(chosen)


def sort_history(history: DataFrame, by: str | None = None, descending: bool = False) -> DataFrame:
    """By url ignoring case or by scan time; otherwise the latest scan first."""
    if by is None:
        return history.orderBy(F.desc("last_scanned"), F.asc("url"))
    key: Column = F.lower("url") if by == "url" else F.col("last_scanned")
    return history.orderBy(key.desc() if descending else key.asc(), F.asc("url"))


def history_display(history: DataFrame) -> DataFrame:
    return history.select("url", S.second_text(F.col("last_scanned")).alias("last_scanned"))
