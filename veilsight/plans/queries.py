"""The engine's operators as queries over the star-schema and text tables.

There are no indicator tables to read, so the star schema stands in for them: parts are
indicators, line items their sightings, suppliers actors, nations countries, customers a
second dimension load, and pages with events the scan history. Documents are articles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import ALL_PRIMARY_TYPES
from ..functions import patterns as P
from ..functions import scalars as S
from ..functions import urls as U
from ..functions.arrays import let
from ..functions.windows import text_chunks, window_text
from ..operators import articles as A
from ..operators import dashboards as B
from ..operators import enrichment as E
from ..operators import extraction as X
from ..operators import links as L
from ..operators import records as R
from ..operators import stix
from ..operators import store as T
from ..operators.mentions import occurrences_by_join
from ..operators.reference import Reference, actor_lexicon, whitelist_frame
from ..session import checkpoint_dir, written, written_by
from ..sources import dimensions as D
from ..sources.feeds import feed_links
from ..sources.pages import flatten, read_pages
from ..streaming.incremental import load_state, run_incremental

AS_OF = "2024-01-31 00:00:00"
SERIES_END = "2001-11-15"
TLDS = ("com", "org", "net", "io", "de", "fr", "es")
MENTIONED = ("that", "from", "with")
ACTOR_WORDS = ("the", "for")
#: Line items of a bucket; an item is in about 25 edges, whose ids a task holds.
ITEMS_A_BUCKET = 50_000


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """An input of fewer splits than the session has cores, as a single file that cannot be split, is dealt to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _articles(spark, sf_dir) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/post/"), F.col("doc_id").cast("string"))
    return _dealt(docs.select(F.col("doc_id").alias("article_idx"), url.alias("url"), "text"), "article_idx")


def _reference(spark) -> Reference:
    return Reference(tlds=spark.createDataFrame([(t,) for t in TLDS], "tld string"), whitelist=whitelist_frame(spark))


def _reference_with_mentions(spark) -> Reference:
    base = _reference(spark)
    return Reference(
        tlds=base.tlds,
        whitelist=base.whitelist,
        countries=spark.createDataFrame([(w,) for w in MENTIONED], "name string"),
        actors=spark.createDataFrame([(w, w.upper()) for w in ACTOR_WORDS], "name string, canonical string"),
    )


# --- stand-ins ------------------------------------------------------------------


def _iocs(spark, sf_dir) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("ioc_id"),
        F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("value"),
        F.lower("p_type").alias("type"),
        F.col("p_partkey").alias("loaded"),
    )


def _source_url(supplier: Column) -> Column:
    return F.concat(F.lit("https://s"), supplier.cast("string"), F.lit(".example.com/feed"))


def _sightings(spark, sf_dir) -> DataFrame:
    item = _read(spark, sf_dir, "lineitem")
    return item.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sighting_id"),
        F.col("l_partkey").alias("ioc_id"),
        F.col("l_suppkey").alias("s_suppkey"),
        _source_url(F.col("l_suppkey")).alias("source_article_url"),
        F.col("l_shipdate").alias("sighting_timestamp"),
    )


def _history(spark, sf_dir) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    events = _read(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), F.col("ts").alias("last_scanned"))
    return pages.join(events, "page_id", "left").groupBy("url").agg(F.max("last_scanned").cast("timestamp").alias("last_scanned"))


def _stand_in_batch(spark, sf_dir) -> E.Structured:
    """Structured indicators: parts with the suppliers, nations and line numbers of their items."""
    part = _read(spark, sf_dir, "part")
    item = _dealt(
        _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey"),
        "l_partkey",
    )
    supplier = _read(spark, sf_dir, "supplier")
    nation = _read(spark, sf_dir, "nation")
    kinds = F.array(*[F.lit(k) for k in ("ipv4", "domain", "md5", "sha256", "file", "email")])
    kind = F.element_at(kinds, (F.pmod(F.length("p_type") + F.col("p_size"), F.lit(6)) + 1).cast("int"))
    named = part.select(
        F.col("p_partkey"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("ioc_value"), kind.alias("ioc_type")
    )
    key = ("ioc_value", "ioc_type")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), item.count() // ITEMS_A_BUCKET)
    # Shuffled once as numbers and once with the names, rows of a part in a row; all below lies in the same buckets.
    item_of = written_by(
        item.join(named, item.l_partkey == named.p_partkey).select(
            *key, "p_partkey", "l_suppkey", "l_linenumber", "l_orderkey"
        ),
        "items", *key, buckets=buckets,
    )
    iocs = item_of.groupBy("ioc_value", "ioc_type").agg(
        F.count("*").alias("occurrence_count"),
        F.concat(F.lit("first order\n"), F.min("l_orderkey").cast("string")).alias("first_seen_context_snippet"),
        F.struct(F.min("p_partkey").alias("article_idx"), F.lit(0).alias("pos")).alias("first_at"),
    )
    sources = item_of.select("ioc_value", "ioc_type", _source_url(F.col("l_suppkey")).alias("url")).distinct()
    sold = item_of.join(supplier, item_of.l_suppkey == supplier.s_suppkey)
    placed = sold.join(nation, sold.s_nationkey == nation.n_nationkey)
    of = lambda kind, value, iso2: F.struct(
        F.lit(kind).alias("mention_type"), value.alias("value"), iso2.alias("iso2_code")
    )
    none = F.lit(None).cast("string")
    three = F.array(
        of("apt_group_mention", F.col("s_name"), none),
        of("country_mention", F.col("n_name"), F.col("n_nationkey").cast("string")),
        of("cve", F.concat(F.lit("cve-2024-000"), F.col("l_linenumber").cast("string")), none),
    )
    mentions = (
        placed.select("ioc_value", "ioc_type", "l_orderkey", F.explode(three).alias("m"))
        .groupBy("ioc_value", "ioc_type", "m.mention_type", "m.value", "m.iso2_code")
        .agg(F.struct(F.min("l_orderkey").alias("article_idx")).alias("seen"))
        .withColumn("normalized_value", F.when(F.col("mention_type") == "apt_group_mention", F.upper("value")))
        .withColumn("context_snippet", F.lit("..."))
        .withColumn("description", none)
    )
    # Read several times by what follows.
    return E.Structured(*[
        written_by(df, name, *key, buckets=buckets, dealt=True) for df, name in ((iocs, "iocs"), (sources, "sources"), (mentions, "mentions"))
    ])


# --- extraction -------------------------------------------------------------------


def _found(spark, sf_dir, pattern: str, hint: str, name: str, kind) -> DataFrame:
    """Matches of one pattern with the text around, cut while the text is at hand."""
    docs = _articles(spark, sf_dir).select(
        "article_idx", X.normalize_text(F.col("text")).alias("t")
    )
    t = F.col("t")

    def cut(chunks):
        def one(h):
            around = window_text(chunks, F.greatest(h["s"] - 50, F.lit(0)), h["e"] + 50)
            return F.struct(h["s"].alias("s"), h["raw"].alias("raw"), around.alias("around"))

        return F.transform(X.hits(t, pattern), one)

    rows = docs.select(
        "article_idx", F.explode_outer(F.when(t.rlike(hint), let(text_chunks(t), cut))).alias("h")
    ).filter(F.col("h").isNotNull())
    raw = F.col("h.raw")
    return rows.select(
        "article_idx", F.col("h.s").alias("pos"), S.refang(raw, F.lit(name)).alias("ioc_value"),
        kind(raw).alias("ioc_type"), F.col("h.around").alias("snippet"),
    )


def extract_ipv4(spark, sf_dir):
    out = _found(spark, sf_dir, P.IPV4, P.IPV4_HINT, "ipv4", lambda r: F.lit("ipv4"))
    return out.withColumn("routable", S.is_routable(F.col("ioc_value")))


def extract_email(spark, sf_dir):
    return _found(spark, sf_dir, P.EMAIL, "@", "email", lambda r: F.lit("email"))


def extract_hash(spark, sf_dir):
    def kind(r):
        return F.when(F.length(r) == 32, "md5").when(F.length(r) == 40, "sha1").otherwise("sha256")

    return _found(spark, sf_dir, P.HASH, P.HASH_HINT, "md5", kind)


def extract_resolved(spark, sf_dir):
    hits = X.extract(_articles(spark, sf_dir), _reference(spark))
    return hits.select("article_idx", "pos", "end_pos", "ioc_value", "ioc_type", "context_snippet")


def indicator_mix(spark, sf_dir):
    """Texts made of customers: each has every kind of indicator, written plainly and defanged, and some that every filter drops."""
    n = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    k = F.col("c_custkey")
    octets = F.concat_ws(".", (k % 256).cast("string"), (F.floor(k / 256) % 256).cast("string"), F.lit("7"))
    gap = F.lit(" , " + "between " * 9)
    parts = [
        F.concat(F.lit("host."), n, F.lit(".com")), F.concat(F.lit("cdn[.]"), n, F.lit("[.]org")), F.concat(F.lit("https://"), n, F.lit(".net/a/"), k.cast("string")),
        F.concat(F.lit("hxxp://"), n, F.lit("[.]net/b")), F.concat(n, F.lit(".exe")), F.concat(n, F.lit("@mail.example.org")),
        F.concat(F.lit("CVE-2021-"), (10000 + k).cast("string")), F.md5(n), F.sha1(n), F.upper(F.sha2(n, 256)), F.concat(F.lit("11."), octets),
        F.concat(F.lit("10."), octets), F.lit("google.com"), F.lit("https://google.com/search"), F.concat(F.lit("for example 12."), octets), F.concat(n, F.lit(".nosuchtld")),
    ]
    texts = _read(spark, sf_dir, "customer").select(
        k.alias("article_idx"), F.concat(F.lit("https://e.example.com/"), k.cast("string")).alias("url"),
        F.concat_ws(" ", *[x for p in parts for x in (p, gap)]).alias("text"),
    )
    return X.extract(_dealt(texts, "article_idx"), _reference(spark)).select("article_idx", "ioc_type", "ioc_value")


def ioc_dedup(spark, sf_dir):
    hits = X.extract(_articles(spark, sf_dir), _reference(spark))
    return E.deduplicate(hits, ALL_PRIMARY_TYPES).select(
        "ioc_value", "ioc_type", "occurrence_count", "first_seen_context_snippet"
    )


def ioc_sources(spark, sf_dir):
    hits = X.extract(_articles(spark, sf_dir), _reference(spark))
    return E.sources_of(hits, ALL_PRIMARY_TYPES)


def ioc_types_in_text(spark, sf_dir):
    hits = X.extract(_articles(spark, sf_dir), _reference(spark))
    return B.top_ioc_types(hits.select(F.col("ioc_type").alias("type")))


def mention_proximity(spark, sf_dir):
    done = E.structure(_articles(spark, sf_dir), _reference_with_mentions(spark), primary_types=ALL_PRIMARY_TYPES)
    return done.mentions.select("ioc_value", "ioc_type", "mention_type", "value", "normalized_value")


def mentions_of_large_lexicon(spark, sf_dir):
    """Openings of documents looked up in all documents; the lexicon grows with the data."""
    docs = _articles(spark, sf_dir).select("article_idx", X.normalize_text(F.col("text")).alias("_text"))
    opening = F.regexp_extract(F.col("_text"), r"^([A-Za-z]{4,})", 1)
    lexicon = written(docs.select(F.lower(opening).alias("name")).filter(F.col("name") != "").distinct(), "lexicon")
    found = occurrences_by_join(docs, lexicon)
    return found.groupBy(F.lower("raw").alias("name")).agg(
        F.count("*").alias("mentions"), F.countDistinct("article_idx").alias("articles")
    )


# --- scalar functions --------------------------------------------------------------


def refang_cases(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("url", "domain", "email", "ipv4", "file")])
    kind = F.element_at(kinds, (F.col("page_id") % 5 + 1).cast("int"))
    masked = F.replace(F.replace(F.col("url"), F.lit("."), F.lit("[.]")), F.lit("http"), F.lit("hxxp"))
    masked = F.concat(F.replace(masked, F.lit("://"), F.lit("[:]//")), F.lit("[@]x y."))
    pages = _read(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), masked.alias("masked"))
    return pages.select("page_id", "kind", S.refang(F.col("masked"), F.col("kind")).alias("refanged"))


def name_normalize(spark, sf_dir):
    names = _read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("- ", "c_name", "c_mktsegment").alias("name"))
    return names.select(
        "c_custkey", S.normalize_name(F.col("name")).alias("name_key"),
        S.spaced_variation(F.regexp_replace("name", "#", "")).alias("variation"),
        S.title_case(F.col("name")).alias("title"),
    )


def filename_sanitize(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", S.file_name(F.col("url"), 40).alias("file_name"))


def url_host(spark, sf_dir):
    url = F.col("url")
    return _read(spark, sf_dir, "pages").select(
        "page_id", U.authority(url).alias("host"), U.path(url).alias("path"), U.fragment(url).alias("fragment"),
        U.resolve(url, F.lit("../a/./b.html?q=1")).alias("resolved"),
    )


def country_name_cases(spark, sf_dir):
    raws = F.array(
        *[F.lit(r) for r in (
            "Congo, The Democratic Republic of the", "Congo, Republic of the", "Korea, Republic of",
            "Korea, Democratic People's Republic of", "The Virgin Islands, British", "Virgin Islands, U.S.",
        )],
        F.concat("c_name", F.lit(", Republic of")), F.col("c_name"),
    )
    rows = _read(spark, sf_dir, "customer").select(
        "c_custkey", F.element_at(raws, (F.col("c_custkey") % 8 + 1).cast("int")).alias("raw")
    )
    return rows.select("c_custkey", S.country_name(F.col("raw")).alias("country_name"))


# --- actors and countries ------------------------------------------------------------


def _supplier_actors(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.array(F.concat(F.lit("SUP-"), F.col("s_suppkey").cast("string")), F.lit("Any Supplier")).alias("aliases"),
        F.lit("d").alias("description"),
        F.col("s_suppkey").alias("seq"),
    )


def actor_alias_match(spark, sf_dir):
    item = _read(spark, sf_dir, "lineitem")
    spelled = F.array(
        F.concat(F.lit("sup "), F.col("l_suppkey").cast("string")),
        F.concat(F.lit("New-Group "), F.col("l_returnflag"), F.col("l_linenumber").cast("string")),
        F.lit("any-supplier"),
    )
    mentions = (
        item.select("l_orderkey", F.explode(spelled).alias("value"))
        .groupBy("value")
        .agg(F.struct(F.min("l_orderkey").alias("first"), F.min("value").alias("v")).alias("seen"))
        .withColumn("normalized_value", F.col("value"))
    )
    resolved, added = E.resolve_actors(mentions, _supplier_actors(spark, sf_dir))
    made = added.select(F.lit("added").alias("outcome"), F.col("aliases")[0].alias("value"), F.col("name").alias("actor_name"))
    return resolved.select(F.lit("resolved").alias("outcome"), "value", "actor_name").unionByName(made)


def actor_lexicon_keys(spark, sf_dir):
    return actor_lexicon(_supplier_actors(spark, sf_dir))


def country_match(spark, sf_dir):
    mentions = _read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("ioc_value"), F.lit("email").alias("ioc_type"), F.lit("country_mention").alias("mention_type"),
        F.concat(F.lit("nation_"), (F.col("c_nationkey") + F.length("c_mktsegment") - 8).cast("string")).alias("value"),
    )
    countries = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("iso2_code"))
    return E.add_countries(mentions, countries).select("ioc_value", "value", "iso2_code")


# --- links and history ----------------------------------------------------------------


def rescan_filter(spark, sf_dir):
    links = _read(spark, sf_dir, "pages").select("url").distinct()
    return L.due_links(links, _history(spark, sf_dir), "2024-01-06 09:00:00")


def scan_history_upsert(spark, sf_dir):
    scanned = _read(spark, sf_dir, "documents").select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang").alias("url")
    ).distinct()
    known = _history(spark, sf_dir).unionByName(
        scanned.filter(F.col("url").endswith("/en")).withColumn("last_scanned", F.lit("2024-01-02").cast("timestamp"))
    )
    out = T.update_history(known, scanned, AS_OF)
    return out.select("url", S.second_text(F.col("last_scanned")).alias("last_scanned"))


def scan_history_search(spark, sf_dir):
    return B.history_display(B.search_history(_history(spark, sf_dir), "EXAMPLE.com", "/en/"))


def scan_history_sorted(spark, sf_dir):
    return B.history_display(B.sort_history(_history(spark, sf_dir), "url"))


def scan_history_prefix(spark, sf_dir):
    return B.history_display(B.history_under(_history(spark, sf_dir), "HTTPS://blog."))


def scanned_domains(spark, sf_dir):
    return B.scanned_domains(_history(spark, sf_dir))


def known_and_new_urls(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("url").distinct()
    history = _history(spark, sf_dir).filter(F.col("last_scanned") < F.lit("2024-01-01 09:00:00").cast("timestamp"))
    known, new = L.split_known(pages, history)
    return known.withColumn("state", F.lit("known")).unionByName(new.withColumn("state", F.lit("new")))


def _flat_pages(spark, sf_dir):
    return flatten(read_pages(spark, f"{sf_dir}/pages.parquet"))


def link_filter(spark, sf_dir):
    return L.scored_links(_flat_pages(spark, sf_dir), all_anchors=True).select("page_id", "url", "link_text", "score")


def link_score(spark, sf_dir):
    return L.article_links(_flat_pages(spark, sf_dir), min_score=1, all_anchors=True)


def link_areas(spark, sf_dir):
    """Pages whose navigation is marked up as an article, so that anchors lie inside an area."""
    inside = F.replace(F.replace("html", F.lit("article>"), F.lit("section>")), F.lit("nav>"), F.lit("article>"))
    return L.page_anchors(flatten(read_pages(spark, f"{sf_dir}/pages.parquet").withColumn("html", inside)))


def feed_or_page_links(spark, sf_dir):
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    safe = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = lambda u: F.concat(F.lit("<item><title>t</title><link>"), u, F.lit("</link></item>"))
    body = F.concat(
        F.lit("<rss><channel>"), item(safe), item(F.concat(safe, F.lit("/2"))), F.lit("<item/></channel></rss>")
    )
    # Pages without TLS have no feed and fall back to their anchors.
    feeds = pages.filter(F.col("url").startswith("https:")).select(F.col("url").alias("source_url"), body.alias("body"))
    from_pages = L.article_links(flatten(pages), min_score=1, all_anchors=True)
    return L.links_of_sources(feed_links(feeds), from_pages)


def article_text(spark, sf_dir):
    return A.article_text(_flat_pages(spark, sf_dir))


def article_text_once(spark, sf_dir):
    return A.article_text(_flat_pages(spark, sf_dir), dedupe_nested=True)


def article_batch(spark, sf_dir):
    """All addresses of pages and documents with their text; of an address the page with the largest id counts. Documents have no stored page."""
    pages = _read(spark, sf_dir, "pages").select(F.xxhash64("url").alias("article_idx"), "url").distinct()
    docs = _articles(spark, sf_dir)
    newest = F.max(F.struct("page_id", "text"))["text"]
    found = A.article_text(_flat_pages(spark, sf_dir)).groupBy("url").agg(newest.alias("text"))
    wanted = pages.unionByName(docs.select("article_idx", "url"))
    return A.article_batch(wanted, found)


# --- dashboards and search ---------------------------------------------------------------


def monthly_iocs(spark, sf_dir):
    return B.monthly_iocs(_sightings(spark, sf_dir))


def monthly_sightings(spark, sf_dir):
    return B.monthly_sightings(_sightings(spark, sf_dir))


def monthly_series(spark, sf_dir):
    return B.monthly_series(_sightings(spark, sf_dir), SERIES_END, 24)


def ioc_top_types(spark, sf_dir):
    return B.top_ioc_types(_iocs(spark, sf_dir))


def top_actors(spark, sf_dir):
    supplier = _read(spark, sf_dir, "supplier")
    return B.top_linked(_sightings(spark, sf_dir), supplier, "s_suppkey", "s_name")


def top_countries(spark, sf_dir):
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = _read(spark, sf_dir, "nation")
    countries = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    return B.top_linked(_sightings(spark, sf_dir), countries, "s_suppkey", "n_name")


def top_sources(spark, sf_dir):
    return B.top_sources(_sightings(spark, sf_dir))


def last_sighting_by_url(spark, sf_dir):
    out = B.last_sightings(_sightings(spark, sf_dir), "HTTPS://s1")
    return out.select("source_article_url", S.second_text(F.col("last_sighting")).alias("last_sighting"))


def ioc_search(spark, sf_dir):
    found = B.search_iocs(_iocs(spark, sf_dir), _sightings(spark, sf_dir), "ECONOMY", "Ring")
    return B.search_display(B.sort_search(found, newest="loaded"))


def ioc_search_sorted(spark, sf_dir):
    found = B.search_iocs(_iocs(spark, sf_dir), _sightings(spark, sf_dir), B.ALL)
    return B.search_display(B.sort_search(found, "last_sighting", True, newest="loaded"))


def ioc_detail(spark, sf_dir):
    sightings = _sightings(spark, sf_dir).drop("s_suppkey")
    linked = _sightings(spark, sf_dir).select("sighting_id", "s_suppkey", "ioc_id").distinct()
    supplier = _read(spark, sf_dir, "supplier")
    nation = _read(spark, sf_dir, "nation")
    actors = linked.join(supplier, "s_suppkey").select("sighting_id", "s_nationkey", F.col("s_name").alias("name"))
    countries = actors.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "sighting_id", F.col("n_name").alias("name")
    )
    out = B.ioc_details(7, _iocs(spark, sf_dir), sightings, actors.select("sighting_id", "name"), countries)
    return out.select(
        "value", "type", "source_article_url", S.second_text(F.col("sighting_timestamp")).alias("seen"), "actors", "countries"
    )


# --- tables kept between runs ----------------------------------------------------------------


def insert_if_absent(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation").filter(F.col("n_regionkey") < 2).select(F.col("n_nationkey").alias("iso2_code"), F.col("n_name").alias("name"))
    new = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("iso2_code"), F.col("c_name").alias("name"))
    return T.insert_if_absent(nation, new, "iso2_code")


def dim_upsert(spark, sf_dir):
    supplier = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mitre_id"), F.col("s_name").alias("name"), "s_acctbal")
    customer = _read(spark, sf_dir, "customer").select((F.col("c_custkey") + 50).alias("mitre_id"), F.col("c_name").alias("name"))
    return T.upsert(supplier, customer, "mitre_id")


def _known_state(spark, sf_dir, batch):
    """A store that already has the indicators of short lists."""
    key = T.ioc_key(F.col("ioc_value"), F.col("ioc_type"))
    old = batch.iocs.filter(F.col("occurrence_count") < 30)
    iocs = old.select(key.alias("ioc_id"))
    sightings = batch.sources.join(old.select("ioc_value", "ioc_type"), ["ioc_value", "ioc_type"]).select(
        key.alias("ioc_id"), F.col("url").alias("source_article_url")
    ).filter(F.col("source_article_url") < "https://s5")
    return iocs, sightings


def ioc_load(spark, sf_dir):
    batch = _stand_in_batch(spark, sf_dir)
    iocs, sightings = _known_state(spark, sf_dir, batch)
    added = T.new_iocs(batch, iocs, AS_OF).select(F.lit("ioc").alias("kind"), F.col("value").alias("item"), F.lit(1).alias("n"))
    seen = T.new_sightings(batch, sightings, AS_OF).groupBy("source_article_url").agg(F.count("*").cast("int").alias("n"))
    return added.unionByName(seen.select(F.lit("sighting").alias("kind"), F.col("source_article_url").alias("item"), "n"))


def sighting_bridge(spark, sf_dir):
    batch = _stand_in_batch(spark, sf_dir)
    _, sightings = _known_state(spark, sf_dir, batch)
    fresh = T.new_sightings(batch, sightings, AS_OF)
    countries = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("iso2_code"))
    linked = T.bridges(batch, fresh, _supplier_actors(spark, sf_dir), countries)
    parts = [("actor", "actors", "actor_name"), ("country", "countries", "country_iso2"), ("cve", "cves", "cve")]
    out = None
    for kind, name, column in parts:
        one = linked[name].groupBy(F.col(column).alias("item")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def false_positive_removal(spark, sf_dir):
    iocs, sightings = _iocs(spark, sf_dir), _sightings(spark, sf_dir)
    gone = _read(spark, sf_dir, "part").filter(F.col("p_size") <= 10).select(F.col("p_partkey").alias("ioc_id"))
    links = sightings.select("sighting_id", "s_suppkey").distinct()
    left = T.delete_ioc(gone, {"iocs": iocs, "sightings": sightings, "sighting_actors": links})
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
    return count(left["iocs"], "iocs").unionByName(count(left["sightings"], "sightings")).unionByName(
        count(left["sighting_actors"], "sighting_actors")
    )


def whitelist_feedback(spark, sf_dir):
    known = _read(spark, sf_dir, "pages").filter(F.col("url").startswith("https://www.")).select(
        F.lit("domains").alias("kind"), F.upper(U.authority(F.col("url"))).alias("value")
    ).distinct()
    reported = _read(spark, sf_dir, "pages").select(F.col("url").alias("value"), F.lit("url").alias("type")).unionByName(
        _read(spark, sf_dir, "customer").select(F.col("c_name").alias("value"), F.lit("file").alias("type"))
    )
    return T.whitelist_additions(reported, known)


# --- dimension pages ---------------------------------------------------------------------------


def _td(*cells) -> Column:
    parts = [F.concat(F.lit("<td> "), c, F.lit(" </td>")) for c in cells]
    return F.concat(F.lit("<html><body><table id='tld-table'><tbody><tr>"), *parts, F.lit("</tr></tbody></table></body></html>"))


def actor_table_page(spark, sf_dir):
    supplier = _dealt(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    key = F.col("s_suppkey").cast("string")
    html = _td(F.concat(F.lit("<a href='#'>G"), key, F.lit("</a>")), F.col("s_name"), F.concat(F.lit("x"), key, F.lit(", , y &amp; z ")), F.lit("about"))
    pages = supplier.select(F.col("s_suppkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    return D.actors_from_page(pages).select("mitre_id", "name", F.array_join("aliases", "|").alias("aliases"), "description")


def country_table_page(spark, sf_dir):
    customer = _dealt(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    key = F.col("c_custkey").cast("string")
    blank = F.lit("")
    name = F.concat(F.lit("<span>no</span><span style='display:table'>"), F.col("c_name"), F.lit(", Republic of</span>"))
    html = _td(F.lit("EU"), blank, name, key, F.concat(F.lit("I"), key), blank, blank, F.lit(".tld"))
    pages = customer.select(F.col("c_custkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    return D.countries_from_page(pages)


def tld_table_page(spark, sf_dir):
    customer = _dealt(_read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    html = _td(F.concat(F.lit("<span class='domain tld'><a>."), F.upper("c_mktsegment"), F.lit("</a></span><span>no</span>")))
    pages = customer.select(F.col("c_custkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    return D.tlds_from_page(pages)


# --- exports -----------------------------------------------------------------------------------


def csv_flat(spark, sf_dir):
    out = R.csv_records(R.records(_stand_in_batch(spark, sf_dir), AS_OF))
    return out.drop("discovery_timestamp")


def json_flat(spark, sf_dir):
    nested = R.json_records(R.records(_stand_in_batch(spark, sf_dir), AS_OF))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return nested.select(
        "file_key", "occurrence_count", F.size("source_article_urls").alias("urls"),
        F.when(F.col("associated_apts").isNull(), 0).otherwise(size("associated_apts")).alias("apts"),
        F.when(F.col("associated_cves").isNull(), 0).otherwise(size("associated_cves")).alias("cves"),
    )


def stix_objects(spark, sf_dir):
    batch = _stand_in_batch(spark, sf_dir)
    sco = stix.observables(batch.iocs).select(F.col("object_type").alias("type"), F.col("contributing").alias("label"))
    actors = stix.intrusion_sets(batch).select(F.lit("intrusion-set").alias("type"), "name", "alias").select("type", F.concat_ws("/", "name", "alias").alias("label"))
    cves = stix.vulnerabilities(batch).select(F.lit("vulnerability").alias("type"), F.col("name").alias("label"))
    places = stix.locations(batch).select(F.lit("location").alias("type"), F.concat_ws("/", "iso2_code", "name").alias("label"))
    return sco.unionByName(actors).unionByName(cves).unionByName(places)


def stix_edges(spark, sf_dir):
    edges = stix.relationships(_stand_in_batch(spark, sf_dir))
    return edges.groupBy("relationship_type", "ioc_type").agg(
        F.count("*").alias("edges"), F.countDistinct("source_ref").alias("sources"), F.countDistinct("target_ref").alias("targets")
    )


def stix_reports(spark, sf_dir):
    out = stix.reports(_stand_in_batch(spark, sf_dir), AS_OF)
    return out.select("url", "name", "description", S.second_text(F.col("published")).alias("published"), F.size("object_refs").alias("refs"))


def stix_bundle_lines(spark, sf_dir):
    return stix.count_objects(stix.bundle_parts(_stand_in_batch(spark, sf_dir), AS_OF))


# --- incremental runs ------------------------------------------------------------------------------


def stream_incremental(spark, sf_dir):
    """All documents through the file stream; gives the rows of the tables it filled."""
    import uuid

    root = f"{checkpoint_dir(spark)}/veilsight-stream-{uuid.uuid4().hex}"
    docs = spark.readStream.schema(
        "doc_id long, text string, lang string, source string, n_chars long"
    ).parquet(f"{sf_dir}/documents.parquet*")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/post/"), F.col("doc_id").cast("string"))
    stream = docs.select(F.col("doc_id").alias("article_idx"), url.alias("url"), "text")
    run_incremental(spark, stream, f"{root}/state", f"{root}/checkpoint", AS_OF, _reference_with_mentions(spark))
    state = load_state(spark, f"{root}/state")
    out = None
    for name in ("iocs", "sightings", "sighting_actors", "history"):
        one = state[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        extract_ipv4, extract_email, extract_hash, extract_resolved, ioc_dedup, ioc_sources, ioc_types_in_text, indicator_mix,
        mention_proximity, mentions_of_large_lexicon, refang_cases, name_normalize, filename_sanitize, url_host,
        country_name_cases, actor_alias_match, actor_lexicon_keys, country_match, rescan_filter, scan_history_upsert,
        scan_history_search, scan_history_sorted, scan_history_prefix, scanned_domains, known_and_new_urls, link_filter,
        link_score, link_areas, feed_or_page_links, article_text, article_text_once, article_batch, monthly_iocs,
        monthly_sightings, monthly_series, ioc_top_types, top_actors, top_countries, top_sources, last_sighting_by_url,
        ioc_search, ioc_search_sorted, ioc_detail, insert_if_absent, dim_upsert, ioc_load, sighting_bridge,
        false_positive_removal, whitelist_feedback, actor_table_page, country_table_page, tld_table_page, csv_flat,
        json_flat, stix_objects, stix_edges, stix_reports, stix_bundle_lines, stream_incremental,
    )
}
