"""Scalar column functions on indicator values, names and timestamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    COUNTRY_CONTAINS,
    COUNTRY_EXACT,
    FILENAME_CHARS,
    FILENAME_DEFAULT,
    FILENAME_WORDS,
    NON_ROUTABLE,
    NON_ROUTABLE_EXCEPT,
    WHITELIST_KIND,
)
from .arrays import let
from .textmatch import SPACE, WORD, strip


def _swap(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def refang(value: Column, kind: Column) -> Column:
    """Undo defanging such as ``1[.]2[.]3[.]4`` or ``hxxp://``; null becomes empty."""
    plain = _swap(value, (("[.]", "."), ("(.)", "."), ("[:]", ":")))
    plain = F.when(kind == "email", F.replace(plain, F.lit("[@]"), F.lit("@"))).otherwise(plain)
    web = F.regexp_replace(plain, r"(?iu)^(?:hxxp|h__p)", "http")
    web = F.regexp_replace(web, r"(?s)(?<!\.)\.\z", "")
    fixed = (
        F.when(kind.isin("domain", "url", "email"), web)
        .when(kind == "ipv4", F.replace(plain, F.lit(" "), F.lit(".")))
        .otherwise(plain)
    )
    return F.coalesce(strip(fixed), F.lit(""))


def normalize_value(value: Column, kind: Column) -> Column:
    return F.when(kind.isin("domain", "email"), F.lower(value)).otherwise(value)


def normalize_name(name: Column) -> Column:
    """Match key of an actor name: lower case without hyphens and blanks."""
    return F.translate(F.lower(F.coalesce(name, F.lit(""))), "- ", "")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM yy")


def day_or_na(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("N/A"))


def second_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def whole_second(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def _like_pattern(text: str, literal: bool) -> str:
    if literal:
        for special in ("\\", "%", "_"):
            text = text.replace(special, "\\" + special)
    return text


def contains_ignoring_case(value: Column, text: str, literal: bool = False) -> Column:
    """``%`` and ``_`` in ``text`` are wildcards unless ``literal``."""
    return value.ilike("%" + _like_pattern(text, literal) + "%")


def starts_ignoring_case(value: Column, text: str, literal: bool = False) -> Column:
    return value.ilike(_like_pattern(text, literal) + "%")


def upper_cve(name: Column) -> Column:
    return F.upper(name)


def title_case(name: Column) -> Column:
    """First letter of every run of letters in upper case, the rest in lower case."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.concat(
                F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))
            ),
        ),
        "",
    )


def alias_list(text: Column) -> Column:
    """Comma list to trimmed, non-empty entries."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda a: a != "")


def join_list(items: Column, separator: str) -> Column:
    return F.array_join(items, separator)


def word_count(text: Column) -> Column:
    cleaned = strip(text)
    words = F.size(F.split(cleaned, rf"[{SPACE}]+"))
    return F.when(cleaned == "", 0).otherwise(words)


def char_count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def spaced_variation(name: Column) -> Column:
    """``APT28`` -> ``APT 28``; null when the name does not start that way."""
    head = F.regexp_extract(name, r"^([a-zA-Z]+)(\p{Nd}+)", 1)
    digits = F.regexp_extract(name, r"^([a-zA-Z]+)(\p{Nd}+)", 2)
    return F.when(head != "", F.concat_ws(" ", head, digits))


def one_line(text: Column) -> Column:
    return _swap(text, (("\n", " "), ("\r", "")))


def file_name(text: Column, max_chars: int = FILENAME_CHARS) -> Column:
    """A value made safe for use as a file name."""
    ends = r"^[._]+|[._]++\z"
    named = _swap(text, FILENAME_WORDS.items())
    safe = F.regexp_replace(F.regexp_replace(named, rf"[^{WORD}.-]", "_"), "_+", "_")
    safe = F.regexp_replace(safe, ends, "")
    cut = F.regexp_replace(F.substring(safe, 1, max_chars), ends, "")
    short = F.when(F.length(safe) > max_chars, cut).otherwise(safe)
    return F.when(short == "", FILENAME_DEFAULT).otherwise(short)


def country_name(raw: Column) -> Column:
    """Country table spelling to the spelling used in articles."""
    low = F.lower(raw)
    rule = F.when(F.lit(False), "")
    for text, name in COUNTRY_EXACT.items():
        rule = rule.when(low == text, name)
    for text, name in COUNTRY_CONTAINS.items():
        rule = rule.when(F.contains(low, F.lit(text)), name)
    return rule.when(F.contains(raw, F.lit(",")), strip(F.substring_index(raw, ",", 1))).otherwise(raw)


def whitelist_kind(kind: Column) -> Column:
    """Whitelist section of an indicator type; null when there is none."""
    rule = F.when(F.lit(False), "")
    for name, section in WHITELIST_KIND.items():
        rule = rule.when(kind == name, section)
    return rule


def _ip_number(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _in_range(number: Column, cidr: str) -> Column:
    base, bits = cidr.split("/")
    low = _ip_number(base)
    return number.between(low, low + 2 ** (32 - int(bits)) - 1)


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 text as a number; null when it is not one."""
    octets = F.transform(F.split(ip, r"\."), lambda o: o.try_cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
    shape = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|\z)){4}(?<!\.)\z"
    return F.when(ip.rlike(shape), number)


def is_routable(ip: Column) -> Column:
    """Not private, loopback, unspecified or reserved; false for anything malformed."""

    def check(n):
        blocked = reduce(lambda a, b: a | b, [_in_range(n, c) for c in NON_ROUTABLE])
        excepted = reduce(lambda a, b: a | b, [_in_range(n, c) for c in NON_ROUTABLE_EXCEPT])
        return F.coalesce(~blocked | excepted, F.lit(False))

    return let(ip_number(ip), check)
