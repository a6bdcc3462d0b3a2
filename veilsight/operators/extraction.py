"""Indicators from article text.

One narrow stage: candidates, their positions, validation and overlap resolution are
expressions over one row, so text is never shuffled. Reference tables that are too large
for literals turn the validation into joins on the (small) candidate rows instead.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SNIPPET_CHARS, TYPE_ORDER, WHITELIST_KIND
from ..functions import patterns as P
from ..functions import scalars as S
from ..functions import urls as U
from ..functions.arrays import empty_array, let, running
from ..functions.textmatch import any_phrase, lexicon_pattern, single_blanks
from ..functions.windows import text_chunks, window_text
from .mentions import occurrences_by_join
from .reference import Reference, one_of

_HIT = "s int, e int, raw string"
_CANDIDATE = "s int, e int, prio int, raw string, type string, snippet string"


def normalize_text(text: Column) -> Column:
    """Straight quotes, single blanks, no blanks at the ends."""
    return single_blanks(F.coalesce(text, F.lit("")), "“”‘’", "\"\"''")


def _marked(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Text cut at the matches: a leading gap, then pieces "match CR gap".

    Line breaks cannot occur in normalised text, so they are free to serve as marks. One
    pass of a compiled pattern gives matches and gaps, hence exact positions.
    """
    pieces = F.split(F.regexp_replace(text, pattern, "\n$0\r"), "\n", -1)
    return pieces if guard is None else F.when(guard, pieces).otherwise(F.array(F.lit("")))


def _hits(pieces: Column) -> Column:
    """Positions of the matches in pieces, in characters."""

    def step(at, piece):
        raw = F.substring_index(piece, "\r", 1)
        hit = F.struct(at.alias("s"), (at + F.length(raw)).alias("e"), raw.alias("raw"))
        return at + F.length(piece) - 1, F.array(hit)

    def walk(p):
        found = running(F.slice(p, F.lit(2), F.size(p) - 1), F.length(p[0]), f"struct<{_HIT}>", step)
        return F.when(F.size(p) > 1, found).otherwise(empty_array(f"struct<{_HIT}>"))

    return let(pieces, walk)


def hits(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """All matches of a pattern in normalised text, with start and end."""
    return _hits(_marked(text, pattern, guard))


def _long_scans(text: Column, actors, countries) -> list:
    """(type, pattern, guard) of the types whose matches may reach across words of any kind."""
    listed = [("url", P.URL, F.contains(text, F.lit("://")))]
    if actors:
        listed.append(("apt_group_mention", lexicon_pattern(actors), None))
    if countries:
        listed.append(("country_mention", lexicon_pattern(countries), None))
    return listed


def _short_scans(text: Column) -> list:
    """(type, pattern, guard) of the types that never match in dull words."""
    has = lambda part: F.contains(text, F.lit(part))
    return [
        ("email", P.EMAIL, has("@")),
        ("file", P.FILE, text.rlike(P.FILE_HINT)),
        ("domain", P.DOMAIN, text.rlike(P.DOMAIN_HINT)),
        ("cve", P.CVE, text.rlike(P.CVE_HINT)),
        ("ipv4", P.IPV4, text.rlike(P.IPV4_HINT)),
        ("hash", P.HASH, text.rlike(P.HASH_HINT)),
    ]


def scans(text: Column, actors, countries) -> list:
    """(type, pattern, guard) for every type; the guards only skip work."""
    return _long_scans(text, actors, countries) + _short_scans(text)


def stretches(text: Column) -> Column:
    """(s, t): what is left of a normalised text between runs of dull words, and where it starts.

    A run of dull words starts and ends where a word does, so in front of a stretch there was a
    blank, and a stretch ends with one or with the text: patterns see the same edges as before.
    """

    def step(at, piece):
        dull = F.substring_index(piece, "\r", 1)
        size = F.length(dull)
        rest = F.substr(piece, size + 2)
        kept = F.array(F.struct((at + size).alias("s"), rest.alias("t")))
        none = empty_array("struct<s:int,t:string>")
        return at + F.length(piece) - 1, F.when(rest != "", kept).otherwise(none)

    def walk(p):
        lead = F.filter(F.array(F.struct(F.lit(0).alias("s"), p[0].alias("t"))), lambda x: x["t"] != "")
        inner = running(F.slice(p, F.lit(2), F.size(p) - 1), F.length(p[0]), "struct<s:int,t:string>", step)
        return F.when(F.size(p) > 1, F.concat(lead, inner)).otherwise(lead)

    return let(_marked(text, P.DULL), walk)


def _typed(scan: Column, hit: Column) -> Column:
    """A hit of one scan as a candidate; hashes are told apart by their length."""
    size = F.length(hit["raw"])
    prio = F.coalesce(
        scan["prio"],
        F.when(size == 32, TYPE_ORDER.index("md5"))
        .when(size == 40, TYPE_ORDER.index("sha1"))
        .otherwise(TYPE_ORDER.index("sha256")),
    )
    kinds = F.array(*[F.lit(t) for t in TYPE_ORDER])
    return F.struct(
        (scan["shift"] + hit["s"]).alias("s"), (scan["shift"] + hit["e"]).alias("e"), prio.alias("prio"), hit["raw"].alias("raw"),
        kinds[prio].alias("type"),
    )


def _with_snippets(text: Column, found: Column) -> Column:
    def attach(chunks):
        def one(c):
            # Counting the characters of the text again for each hit would be quadratic; a
            # window past its end is simply shorter.
            low = F.greatest(c["s"] - SNIPPET_CHARS, F.lit(0))
            high = c["e"] + SNIPPET_CHARS
            return F.struct(
                *[c[n].alias(n) for n in ("s", "e", "prio", "raw", "type")],
                window_text(chunks, low, high).alias("snippet"),
            )

        return F.transform(found, one)

    cut = let(text_chunks(text), attach)
    return F.when(F.size(found) > 0, cut).otherwise(empty_array(f"struct<{_CANDIDATE}>"))


def candidates(text: Column, actors=(), countries=()) -> Column:
    """Every candidate of a normalised text, unvalidated."""

    def typed(scanned, listed, shift):
        each = F.array(
            *[
                F.struct(
                    F.lit(None if name == "hash" else TYPE_ORDER.index(name)).cast("int").alias("prio"),
                    shift.alias("shift"), _marked(scanned, pattern, guard).alias("pieces"),
                )
                for name, pattern, guard in listed
            ]
        )
        return F.flatten(F.transform(
            F.filter(each, lambda x: F.size(x["pieces"]) > 1),
            lambda x: F.transform(_hits(x["pieces"]), partial(_typed, x)),
        ))

    long = typed(text, _long_scans(text, actors, countries), F.lit(0))
    short = F.flatten(F.transform(stretches(text), lambda x: typed(x["t"], _short_scans(x["t"]), x["s"])))
    return let(F.concat(long, short), lambda all_found: _with_snippets(text, all_found))


def classify(raw: Column, kind: Column, known_tld) -> Column:
    """Struct (type, value) after the order url, domain, file; null type when none fits.

    ``known_tld`` maps a lower-case top-level part to a boolean column.
    """
    domain = S.refang(raw, F.lit("domain"))
    tld = F.lower(F.substring_index(domain, ".", -1))
    is_domain = raw.rlike(P.DOMAIN_ONLY) & known_tld(tld)
    named = (
        F.when(~kind.isin("url", "domain", "file"), kind)
        .when((kind == "url") | raw.rlike(P.URL_ONLY), F.lit("url"))
        .when(is_domain, F.lit("domain"))
        .when(raw.rlike(P.FILE_ONLY), F.lit("file"))
    )
    return let(named, lambda t: F.struct(t.alias("type"), S.refang(raw, t).alias("value")))


def whitelist_key(kind: Column, value: Column) -> Column:
    """What is looked up in the whitelist section of a type."""
    return (
        F.when(kind == "url", F.lower(U.authority(value)))
        .when(kind == "ipv4", value)
        .otherwise(F.lower(value))
    )


def _plausible(kind: Column, value: Column, snippet: Column, phrases) -> Column:
    """Checks that need no reference table."""
    routable = (kind != "ipv4") | S.is_routable(value)
    in_context = kind.isin("url", "domain", "file", "ipv4", "email")
    return kind.isNotNull() & routable & ~(in_context & snippet.rlike(any_phrase(phrases)))


def resolve_overlaps(found: Column, ddl: str) -> Column:
    """Earliest first, longest first, then type order; later overlaps are dropped."""
    ordered = F.array_sort(
        found,
        lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"])
        .when(a["e"] != b["e"], b["e"] - a["e"])
        .otherwise(a["prio"] - b["prio"]),
    )

    def step(last_end, c):
        free = c["s"] >= last_end
        return F.when(free, c["e"]).otherwise(last_end), F.when(free, F.array(c)).otherwise(
            empty_array(f"struct<{ddl}>")
        )

    kept = running(ordered, F.lit(0), f"struct<{ddl}>", step)
    return F.when(F.size(found) > 1, kept).otherwise(found)


_VALID = "s int, e int, prio int, raw string, type string, value string, snippet string"


def _validated(c: Column, known_tld) -> Column:
    return let(
        classify(c["raw"], c["type"], known_tld),
        lambda v: F.struct(
            *[c[n].alias(n) for n in ("s", "e", "prio", "raw")],
            v["type"].alias("type"), v["value"].alias("value"), c["snippet"].alias("snippet"),
        ),
    )


def _in_row(df: DataFrame, text: Column, ref: Reference, actors, countries, tlds, listed) -> DataFrame:
    by_kind: dict = {}
    for row in listed:
        by_kind.setdefault(row["kind"], []).append(row["value"])

    def keep(v):
        key = whitelist_key(v["type"], v["value"])
        white = reduce(
            lambda a, b: a | b,
            [
                v["type"].isin(*[t for t, k in WHITELIST_KIND.items() if k == kind])
                & one_of(key, values)
                for kind, values in by_kind.items()
                if kind in WHITELIST_KIND.values()
            ],
            F.lit(False),
        )
        return _plausible(v["type"], v["value"], v["snippet"], ref.phrases) & ~white

    known = lambda t: one_of(t, tlds)
    checked = F.filter(
        F.transform(candidates(text, actors, countries), lambda c: _validated(c, known)), keep
    )
    return df.withColumn("_hits", let(checked, lambda f: resolve_overlaps(f, _VALID)))


def _by_joins(df, text, ref: Reference, actors, countries, tlds, listed) -> DataFrame:
    """Same result when some reference table is joined."""
    keys = ["article_idx"]
    found = F.explode_outer(candidates(text, actors or (), countries or ())).alias("c")
    rows = df.select(*keys, found).filter(F.col("c").isNotNull()).select(*keys, "c.*")
    for table, name in (("actors", "apt_group_mention"), ("countries", "country_mention")):
        if ref.literals(table, "name") is None:
            found = occurrences_by_join(df, getattr(ref, table))
            mention = found.select(
                "article_idx", "s", "e", F.lit(TYPE_ORDER.index(name)).alias("prio"), "raw",
                F.lit(name).alias("type"), "snippet",
            )
            rows = rows.unionByName(mention)

    if tlds is None:
        tld = F.lower(F.substring_index(S.refang(F.col("raw"), F.lit("domain")), ".", -1))
        known_tlds = ref.tlds.select(F.col("tld").alias("_known")).distinct()
        rows = rows.withColumn("_tld", F.when(F.col("type").isin("url", "domain", "file"), tld))
        rows = rows.join(known_tlds, F.col("_tld") == F.col("_known"), "left")
        known = lambda t: F.col("_known").isNotNull()
    else:
        known = lambda t: one_of(t, tlds)
    rows = rows.withColumn("_v", classify(F.col("raw"), F.col("type"), known))
    rows = rows.select(*keys, "s", "e", "prio", "raw", "_v.type", "_v.value", "snippet")
    rows = rows.filter(_plausible(F.col("type"), F.col("value"), F.col("snippet"), ref.phrases))
    if ref.whitelist is not None:
        wl = ref.whitelist.select(F.col("kind").alias("_kind"), F.col("value").alias("_key"))
        match = (F.col("_kind") == S.whitelist_kind(F.col("type"))) & (
            F.col("_key") == whitelist_key(F.col("type"), F.col("value"))
        )
        rows = rows.join(wl, match, "left_anti")
    # The hits of one article, bounded by its text.
    hit = F.struct("s", "e", "prio", "raw", "type", "value", "snippet")
    return (
        rows.groupBy(*keys)
        .agg(F.collect_list(hit).alias("_found"))
        .select(*keys, resolve_overlaps(F.col("_found"), _VALID).alias("_hits"))
    )


def annotate(articles: DataFrame, ref: Reference | None = None, keep_text: bool = True) -> DataFrame:
    """``articles(article_idx, text, ...)`` with the array ``_hits`` of its indicators.

    The text stays in the row, so what needs both runs in the same narrow stage; without
    ``keep_text`` it is dropped before anything is joined.
    """
    ref = ref or Reference()
    actors = ref.literals("actors", "name")
    countries = ref.literals("countries", "name")
    tlds = ref.literals("tlds", "tld")
    listed = ref.literals("whitelist", "kind", "value")
    small = None not in (actors, countries, tlds, listed)

    names = lambda rows, col: None if rows is None else [r[col] for r in rows if r[col]]
    args = (names(actors, "name"), names(countries, "name"), names(tlds, "tld"), listed)
    df = articles.filter(F.col("text") != "")
    if small:
        done = _in_row(
            df.withColumn("_text", normalize_text(F.col("text"))), F.col("_text"), ref, *args
        ).drop("_text")
        return done if keep_text else done.drop("text")
    # Only the key travels with the candidates; the article comes back at the end.
    slim = df.select("article_idx", normalize_text(F.col("text")).alias("_text"))
    found = _by_joins(slim, F.col("_text"), ref, *args)
    # Articles without hits stay, as in the other branch.
    out = (df if keep_text else df.drop("text")).join(found, "article_idx", "left")
    return out.withColumn("_hits", F.coalesce("_hits", empty_array(f"struct<{_VALID}>")))


def hit_rows(annotated: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """One row per indicator of annotated articles, without the text."""
    keys = [c for c in annotated.columns if c not in ("text", "_hits", "_facts")]
    h = F.col("h")
    # explode() would add a filter on the array, which repeats the whole extraction.
    out = annotated.select(*keys, F.explode_outer("_hits").alias("h")).filter(h.isNotNull()).select(
        *keys,
        h["s"].alias("pos"),
        h["e"].alias("end_pos"),
        h["value"].alias("ioc_value"),
        h["type"].alias("ioc_type"),
        F.concat(F.lit("..."), h["snippet"], F.lit("...")).alias("context_snippet"),
        h["raw"].alias("_raw"),
    )
    return canonical_actors(out, lexicon).drop("_raw")


def extract(articles: DataFrame, ref: Reference | None = None) -> DataFrame:
    """Annotated indicators of ``articles(article_idx, text, ...)``.

    Other article columns are passed on. Result: article_idx, ..., pos, end_pos,
    ioc_value, ioc_type, context_snippet, normalized_value.
    """
    return hit_rows(annotate(articles, ref, keep_text=False), ref.actors if ref else None)


def canonical_actors(hits_df: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """Main name of an actor mention; the text itself when the lexicon has none."""
    is_actor = F.col("ioc_type") == "apt_group_mention"
    if lexicon is None:
        return hits_df.withColumn("normalized_value", F.when(is_actor, F.col("_raw")))
    # Rows that are no actor mention get a key of their own that matches nothing, so that a
    # shuffle of this join has no hot null key.
    own = F.concat(F.lit("\0"), F.xxhash64("article_idx", "pos").cast("string"))
    keyed = hits_df.withColumn("_key", F.when(is_actor, F.lower("ioc_value")).otherwise(own))
    lex = lexicon.select(F.col("name").alias("_key"), "canonical")
    value = F.when(is_actor, F.coalesce("canonical", "_raw"))
    return keyed.join(lex, "_key", "left").withColumn("normalized_value", value).drop("_key", "canonical")
