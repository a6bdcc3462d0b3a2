"""Tables kept between runs, as snapshots: each operator gives the new state of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import urls as U
from .enrichment import Structured, resolve_actors


def ioc_key(value: Column, kind: Column) -> Column:
    """Stable id of an indicator; no central sequence is needed."""
    return F.sha2(F.concat_ws("\x1f", kind, value), 256)


def sighting_key(ioc_id: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", ioc_id, url), 256)


def insert_if_absent(existing: DataFrame, new: DataFrame, *keys: str, first_by=None) -> DataFrame:
    """Existing rows untouched, plus the first new row of every unknown key."""
    unknown = new.join(existing.select(*keys), list(keys), "left_anti")
    others = [c for c in new.columns if c not in keys]
    if not others:
        return existing.unionByName(unknown.distinct(), allowMissingColumns=True)
    order = F.struct(*(first_by or others))
    picked = unknown.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_row"))
    rows = picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])
    return existing.unionByName(rows.select(new.columns), allowMissingColumns=True)


def upsert(existing: DataFrame, new: DataFrame, key: str, last_by: str | None = None) -> DataFrame:
    """New rows replace those with the same key, column by column; others stay.

    Of several new rows with a key the last counts, by ``last_by`` or else by all columns.
    """
    others = [c for c in new.columns if c != key]
    if others:
        order = F.struct(last_by) if last_by else F.struct(*others)
        one = new.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row"))
        new = one.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])
    else:
        new = new.distinct()
    changed = [c for c in new.columns if c != key]
    e, n = existing.alias("e"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = e.join(n, F.col(f"e.{key}") == F.col(f"n.{key}"), "full_outer")
    picked = []
    for c in existing.columns:
        if c == key:
            picked.append(F.coalesce(F.col(f"n.{key}"), F.col(f"e.{key}")).alias(key))
        elif c in changed:
            picked.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c))
        else:
            picked.append(F.col(f"e.{c}").alias(c))
    return joined.select(*picked)


def update_history(history: DataFrame, urls: DataFrame, as_of: Column | str) -> DataFrame:
    """Scanned addresses get ``as_of``; unknown ones are added."""
    scanned = urls.select("url", F.lit(as_of).cast("timestamp").alias("last_scanned"))
    merged = history.select("url", "last_scanned", F.lit(0).alias("run")).unionByName(
        scanned.select("url", "last_scanned", F.lit(1).alias("run"))
    )
    return merged.groupBy("url").agg(F.max_by("last_scanned", "run").alias("last_scanned"))


def latest_scans(history: DataFrame) -> DataFrame:
    """One row per address: the latest known scan, or null when none is known."""
    return history.groupBy("url").agg(F.max("last_scanned").alias("last_scanned"))


def new_iocs(batch: Structured, iocs: DataFrame, as_of: Column | str) -> DataFrame:
    return (
        batch.iocs.select(
            ioc_key(F.col("ioc_value"), F.col("ioc_type")).alias("ioc_id"),
            F.col("ioc_value").alias("value"),
            F.col("ioc_type").alias("type"),
            F.lit(as_of).cast("timestamp").alias("first_seen_timestamp"),
        )
        .join(iocs.select("ioc_id"), "ioc_id", "left_anti")
    )


def new_sightings(batch: Structured, sightings: DataFrame, as_of: Column | str) -> DataFrame:
    """One sighting per indicator and address that is not known yet."""
    ioc_id = ioc_key(F.col("ioc_value"), F.col("ioc_type"))
    sources = batch.sources.select(ioc_id.alias("ioc_id"), F.col("url").alias("source_article_url"), F.lit(False).alias("_known"))
    known = sightings.select("ioc_id", "source_article_url", F.lit(True).alias("_known")).filter(
        F.col("ioc_id").isNotNull() & F.col("source_article_url").isNotNull()
    )
    # By the indicator alone, which is what all that follows is joined by: one shuffle, its rows in a row.
    fresh = (
        sources.unionByName(known)
        .repartition("ioc_id")
        .groupBy("ioc_id", "source_article_url")
        .agg(F.max("_known").alias("_known"))
        .filter(~F.col("_known"))
    )
    snippets = batch.iocs.select(
        ioc_id.alias("ioc_id"), F.col("first_seen_context_snippet").alias("context_snippet")
    )
    return fresh.join(snippets, "ioc_id").select(
        sighting_key(F.col("ioc_id"), F.col("source_article_url")).alias("sighting_id"),
        "ioc_id", "source_article_url", "context_snippet",
        F.lit(as_of).cast("timestamp").alias("sighting_timestamp"),
    )


def bridges(batch: Structured, fresh: DataFrame, actors: DataFrame, countries: DataFrame) -> dict:
    """Links of new sightings to actors, countries and CVEs, and the actors to add.

    All mentions of an indicator attach to each of its new sightings. The links of one
    indicator are joined, never gathered; both sides are distinct, so links are too.
    """
    mentions = batch.mentions.withColumn("ioc_id", ioc_key(F.col("ioc_value"), F.col("ioc_type")))
    ids = fresh.select("ioc_id", "sighting_id")
    of = lambda kind: mentions.filter(F.col("mention_type") == kind)
    resolved, added = resolve_actors(of("apt_group_mention"), actors)
    known_names = (
        countries.groupBy(F.lower("name").alias("_lower")).agg(F.min("iso2_code").alias("country_iso2"))
    )
    country = of("country_mention").join(known_names, F.lower("value") == F.col("_lower"))
    # Shuffled once by the indicator, for the distinct and for the join.
    linked = lambda df, name: ids.join(df.select("ioc_id", name).repartition("ioc_id").distinct(), "ioc_id").select("sighting_id", name)
    return {
        "actors": linked(resolved, "actor_name"),
        "countries": linked(country, "country_iso2"),
        "cves": linked(of("cve").withColumnRenamed("value", "cve"), "cve"),
        "added_actors": added,
    }


def delete_ioc(ioc_ids: DataFrame, tables: dict) -> dict:
    """State without the given indicators, their sightings and the links of those."""
    gone = ioc_ids.select("ioc_id").distinct()
    sightings = tables["sightings"]
    gone_sightings = sightings.join(gone, "ioc_id", "left_semi").select("sighting_id")
    out = dict(tables)
    out["iocs"] = tables["iocs"].join(gone, "ioc_id", "left_anti")
    out["sightings"] = sightings.join(gone, "ioc_id", "left_anti")
    for name in ("sighting_actors", "sighting_countries", "sighting_cves"):
        if name in tables:
            out[name] = tables[name].join(gone_sightings, "sighting_id", "left_anti")
    return out


def was_deleted(ioc_ids: DataFrame, iocs: DataFrame) -> DataFrame:
    """(ioc_id, deleted): false where there was nothing to delete."""
    present = iocs.select("ioc_id", F.lit(True).alias("_present")).distinct()
    return ioc_ids.select("ioc_id").distinct().join(present, "ioc_id", "left").select(
        "ioc_id", F.coalesce("_present", F.lit(False)).alias("deleted")
    )


def whitelist_additions(reported: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Whitelist with reported (value, type), unless present in any case.

    An address goes in with its host, which is what addresses are checked by.
    """
    value = F.when(F.col("type") == "url", U.authority(F.col("value"))).otherwise(F.col("value"))
    fresh = (
        reported.select(S.whitelist_kind(F.col("type")).alias("kind"), value.alias("value"))
        .filter(F.col("kind").isNotNull())
        .withColumn("_lower", F.lower("value"))
    )
    known = whitelist.select("kind", F.lower("value").alias("_lower")).distinct()
    added = (
        fresh.join(known, ["kind", "_lower"], "left_anti")
        .groupBy("kind", "_lower")
        .agg(F.min("value").alias("value"))
    )
    return whitelist.select("kind", "value").unionByName(added.select("kind", "value"))


def report_false_positives(reported: DataFrame, whitelist: DataFrame, tables: dict) -> tuple:
    """Reported (value, type) go to the whitelist and out of the tables."""
    ids = reported.select(ioc_key(F.col("value"), F.col("type")).alias("ioc_id"))
    return whitelist_additions(reported, whitelist), delete_ioc(ids, tables)
