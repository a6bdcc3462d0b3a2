"""Whole runs: pages to tables and exports, and the refresh of dimensions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_LINK_KEYWORDS, MIN_LINK_SCORE, PRIMARY_TYPES, REFRESH_DAYS
from ..operators import articles as A
from ..operators import links as L
from ..operators import store as T
from ..operators.enrichment import Structured, nearby, structure_hits, with_places
from ..operators.extraction import annotate, hit_rows
from ..operators.reference import Reference
from ..session import written
from ..sources import dimensions as D
from ..sources.feeds import feed_links
from ..sources.pages import flatten
from ..sources.sinks import FORMATS, export


@dataclass(frozen=True)
class Run:
    """What a run found, and the rows it adds to each table.

    All tables but the history only ever gain rows, so a run writes what is new instead of
    whole tables; the latest scan of an address is what counts in the history.
    """

    batch: Structured
    delta: dict
    metrics: DataFrame

    def applied(self, tables: dict) -> dict:
        """The tables after the run."""
        out = dict(tables)
        for name, rows in self.delta.items():
            if name == "history":
                out[name] = T.latest_scans(tables[name].unionByName(rows))
            else:
                out[name] = tables[name].unionByName(rows, allowMissingColumns=True)
        return out


def select_links(listings: DataFrame, feeds: DataFrame | None, history: DataFrame, as_of: Column | str,
                 keywords=DEFAULT_LINK_KEYWORDS, min_score: int = MIN_LINK_SCORE) -> DataFrame:
    """(url) to scan, from listing pages and feeds of the sources."""
    from_pages = L.article_links(flatten(listings), keywords, min_score)
    if feeds is None:
        found = from_pages.select("url").distinct()
    else:
        found = L.links_of_sources(feed_links(feeds), from_pages)
    return L.due_links(found, history, as_of)


def articles_of(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(article_idx, url, text, status) of the stored pages of the links, of each address the page with the largest id.

    The index is a hash of the address: it is the same on every run and needs no global
    order.
    """
    stored = pages.join(links.select("url"), "url", "left_semi").select("page_id", "url", "html")
    newest = stored.groupBy("url").agg(F.max("page_id").alias("page_id"))
    stored = stored.join(newest, ["url", "page_id"], "left_semi").select("page_id", "url", "html")
    return A.article_text(flatten(stored), dedupe_nested=True).select(
        F.xxhash64("url").alias("article_idx"), "url", "text", "status"
    ).dropDuplicates(["url"])


def run_articles(articles: DataFrame, links: DataFrame, tables: dict, as_of: Column | str, ref: Reference,
                 primary_types=PRIMARY_TYPES, keep_history_if_empty: bool = True) -> Run:
    """Articles to the rows they add to all tables.

    ``tables`` has iocs, sightings, actors, countries, history and the three bridges. With
    ``keep_history_if_empty`` a batch without any indicator leaves the history as it was,
    so that its pages are tried again.
    """
    # Written once: text, hits and places are read by every branch below.
    done = written(with_places(annotate(articles, ref), primary_types).drop("text"), "annotated")
    hits = hit_rows(done, ref.actors)
    batch = structure_hits(hits, nearby(done), tables["actors"], tables["countries"], primary_types)
    iocs = written(batch.iocs, "iocs")
    mentions = written(batch.mentions, "mentions")
    batch = Structured(iocs, batch.sources, mentions)

    fresh = written(T.new_sightings(batch, tables["sightings"], as_of), "sightings")
    linked = T.bridges(batch, fresh, tables["actors"], tables["countries"])
    # A batch without any indicator does not count as scanned.
    scanned = links
    if keep_history_if_empty:
        some = done.select(F.max(F.size("_hits") > 0).alias("some")).filter("some")
        scanned = links.join(F.broadcast(some), how="left_semi")  # one row at most
    delta = {
        "iocs": T.new_iocs(batch, tables["iocs"], as_of),
        "sightings": fresh,
        "sighting_actors": linked["actors"],
        "sighting_countries": linked["countries"],
        "sighting_cves": linked["cves"],
        "actors": linked["added_actors"],
        "history": scanned.select("url", F.lit(as_of).cast("timestamp").alias("last_scanned")),
    }
    metrics = (
        links.agg(F.count("*").alias("n")).select(F.lit("links").alias("metric"), "n")
        .unionByName(done.agg(F.count("*").alias("n")).select(F.lit("texts").alias("metric"), "n"))
        .unionByName(hits.agg(F.count("*").alias("n")).select(F.lit("annotated").alias("metric"), "n"))
        .unionByName(iocs.agg(F.count("*").alias("n")).select(F.lit("structured").alias("metric"), "n"))
        .unionByName(fresh.agg(F.count("*").alias("n")).select(F.lit("sightings").alias("metric"), "n"))
    )
    return Run(batch, delta, metrics)


def run(listings: DataFrame, feeds: DataFrame | None, pages: DataFrame, tables: dict, as_of: Column | str,
        ref: Reference, export_to: str | None = None, formats=FORMATS) -> Run:
    """Links, texts, indicators, enrichment, tables, scan history, and exports below `export_to` in the chosen formats."""
    links = written(select_links(listings, feeds, tables["history"], as_of), "links")
    out = run_articles(articles_of(links, pages), links, tables, as_of, ref)
    if export_to is None:
        return out
    counts = export(out.batch, export_to, as_of, formats)
    rows = links.sparkSession.createDataFrame([(f"exported {k}", n) for k, n in sorted(counts.items())], "metric string, n long")
    return replace(out, metrics=out.metrics.unionByName(rows))


TABLES = {
    "iocs": "ioc_id string, value string, type string, first_seen_timestamp timestamp",
    "sightings": (
        "sighting_id string, ioc_id string, source_article_url string, context_snippet string, "
        "sighting_timestamp timestamp"
    ),
    "actors": "mitre_id string, name string, aliases array<string>, description string, seq long",
    "countries": "name string, continent_code string, iso2_code string, iso3_code string, tld string",
    "history": "url string, last_scanned timestamp",
    "sighting_actors": "sighting_id string, actor_name string",
    "sighting_countries": "sighting_id string, country_iso2 string",
    "sighting_cves": "sighting_id string, cve string",
}


def empty_tables(spark) -> dict:
    return {name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()}


def refresh(tables: dict, pages: dict, only: str | None = None) -> dict:
    """New state of the dimensions for which a page is given: tlds, countries, apts."""
    out = dict(tables)
    chosen = {only.lower()} if only else set(pages)
    if "tlds" in chosen and "tlds" in pages:
        out["tlds"] = D.tlds_from_page(pages["tlds"])
    if "countries" in chosen and "countries" in pages:
        out["countries"] = T.insert_if_absent(
            tables["countries"], D.countries_from_page(pages["countries"], with_seq=True), "iso2_code", first_by=["seq"]
        ).select(tables["countries"].columns)
    if "apts" in chosen and "apts" in pages:
        out["actors"] = T.upsert(tables["actors"], D.actors_from_page(pages["apts"]), "mitre_id", last_by="seq")
    return out


def needs_refresh(log: DataFrame, as_of: Column | str, days: int = REFRESH_DAYS) -> DataFrame:
    """(name, stale) of refresh_log(name, last_run as text): never, unreadable or too old."""
    last = F.col("last_run").try_cast("timestamp")
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days")
    return log.select("name", F.coalesce(last < limit, F.lit(True)).alias("stale"))
