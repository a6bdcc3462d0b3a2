"""URL parts and reference resolution as column expressions.

``try_parse_url`` follows java.net.URI and gives null for many addresses that occur in
articles (blanks, pipes, braces), so the parts are cut out with anchored patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import empty_array, let

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_HOST = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_RELATIVE = ("", "http", "https", "ftp")


def _clean(url: Column) -> Column:
    bare = F.translate(F.coalesce(url, F.lit("")), "\t\r\n", "")
    return F.regexp_replace(bare, r"^[\x00-\x20]+", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), _PARTS, 1))


def authority(url: Column) -> Column:
    """Host with port and user info; empty when there is none. Null for a null."""
    return F.regexp_extract(F.translate(url, "\t\r\n", ""), _HOST, 1)


def raw_path(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _PARTS, 3)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_extract(raw_path(url), r"(?s)^((?:.*/)?[^/;]*)", 1)


def _parameters(url: Column) -> Column:
    return F.substring(raw_path(url), F.length(path(url)) + 2, F.length(raw_path(url)))


def query(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _PARTS, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _PARTS, 5)


def _without_dots(segments: Column) -> Column:
    kept = F.aggregate(
        segments,
        empty_array("string"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(closed, "/")


def _merge_paths(base: Column, rel: Column) -> Column:
    """Path of a reference with a non-empty path, against the path of its base."""

    def against(base_parts):
        directory = F.slice(base_parts, F.lit(1), F.size(base_parts) - 1)
        n = F.size(base_parts)
        kept = F.when(F.element_at(base_parts, -1) == "", base_parts).otherwise(directory)
        joined = F.concat(F.when(n > 0, kept).otherwise(empty_array("string")), F.split(rel, "/"))

        def tidy(parts):
            inner = F.filter(
                F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: s != ""
            )
            head = F.slice(parts, 1, 1)
            tail = F.when(F.size(parts) > 1, F.slice(parts, -1, 1)).otherwise(empty_array("string"))
            return F.concat(head, inner, tail)

        return let(joined, tidy)

    segments = F.when(rel.startswith("/"), F.split(rel, "/")).otherwise(
        let(F.split(base, "/"), against)
    )
    return let(
        let(segments, _without_dots), lambda resolved: F.when(resolved == "", "/").otherwise(resolved)
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute address of ``href`` found on the page ``base``; an empty fragment is dropped."""

    def parts(u):
        cleaned = _clean(u)
        return F.struct(
            *[F.regexp_extract(cleaned, _PARTS, i).alias(n) for i, n in
              ((1, "scheme"), (2, "host"), (4, "query"), (5, "fragment"))],
            path(u).alias("path"),
            _parameters(u).alias("params"),
        )

    def build(r):
        lead = F.when((r["host"] != "") & (r["path"] != "") & ~r["path"].startswith("/"), "/").otherwise("")
        return F.concat(
            F.when(r["scheme"] != "", F.concat(F.lower(r["scheme"]), F.lit(":"))).otherwise(""),
            F.when(r["host"] != "", F.concat(F.lit("//"), r["host"])).otherwise(""),
            lead,
            r["path"],
            F.when(r["params"] != "", F.concat(F.lit(";"), r["params"])).otherwise(""),
            F.when(r["query"] != "", F.concat(F.lit("?"), r["query"])).otherwise(""),
            F.when(r["fragment"] != "", F.concat(F.lit("#"), r["fragment"])).otherwise(""),
        )

    def join(pair):
        b, h = pair["base"], pair["href"]
        own_host = h["host"] != ""
        own_path = own_host | (h["path"] != "") | (h["params"] != "")
        same = F.struct(
            b["scheme"].alias("scheme"),
            F.when(own_host, h["host"]).otherwise(b["host"]).alias("host"),
            F.when(own_host, h["path"])
            .when(own_path, _merge_paths(b["path"], h["path"]))
            .otherwise(b["path"]).alias("path"),
            F.when(own_path, h["params"]).otherwise(b["params"]).alias("params"),
            F.when(own_path | (h["query"] != ""), h["query"]).otherwise(b["query"]).alias("query"),
            h["fragment"].alias("fragment"),
        )
        foreign = (h["scheme"] != "") & (F.lower(h["scheme"]) != F.lower(b["scheme"]))
        return F.when(foreign | ~F.lower(b["scheme"]).isin(*_RELATIVE), _clean(href)).otherwise(let(same, build))

    joined = let(F.struct(parts(base).alias("base"), parts(href).alias("href")), join)
    return F.when(_clean(href) == "", base).otherwise(joined)
