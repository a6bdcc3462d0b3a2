import random
import re
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from veilsight.functions import scalars as S
from veilsight.functions import textmatch as M
from veilsight.functions import urls as U
from veilsight.functions.arrays import running


def column(spark, values, expr, ddl="v string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ddl)
    return [r["o"] for r in df.select("i", expr.alias("o")).orderBy("i").collect()]


def test_refang(spark):
    cases = [
        ("192[.]168[.]1[.]1", "ipv4", "192.168.1.1"),
        ("1 2 3 4", "ipv4", "1.2.3.4"),
        ("hxxp://example[.]com/path", "domain", "http://example.com/path"),
        ("h__ps://a(.)b.", "url", "https://a.b"),
        ("a.b..", "domain", "a.b.."),
        ("user[@]example[.]com", "email", "user@example.com"),
        ("x[:]y ", "file", "x:y"),
        (None, "file", ""),
    ]
    got = column(spark, [c[:2] for c in cases], S.refang(F.col("v"), F.col("k")), "v string, k string")
    assert got == [c[2] for c in cases]


def test_normalize(spark):
    rows = [("EXAMPLE.COM", "domain"), ("U@E.COM", "email"), ("192.168.1.1", "ipv4")]
    got = column(spark, rows, S.normalize_value(F.col("v"), F.col("k")), "v string, k string")
    assert got == ["example.com", "u@e.com", "192.168.1.1"]
    assert column(spark, ["APT-28", "Fancy Bear", None], S.normalize_name(F.col("v"))) == [
        "apt28", "fancybear", ""]


def test_small_scalars(spark):
    v = F.col("v")
    assert column(spark, ["guinea-bissau", "cote d'ivoire", "NORTH korea"], S.title_case(v)) == [
        x.title() for x in ["guinea-bissau", "cote d'ivoire", "NORTH korea"]]
    assert column(spark, [" a b c ", "", "  "], S.word_count(v)) == [3, 0, 0]
    assert column(spark, ["APT28", "FIN7x", "Turla", "28"], S.spaced_variation(v)) == [
        "APT 28", "FIN 7", None, None]
    assert column(spark, ["a, b ,,c", ""], S.alias_list(v)) == [["a", "b", "c"], []]
    assert column(spark, ["/a/b/c"], S.char_count(v, "/")) == [3]
    assert column(spark, ["a\r\nb"], S.one_line(v)) == ["a b"]
    assert column(spark, ["domain", "url", "ipv4", "cve"], S.whitelist_kind(v)) == [
        "domains", "domains", "ips", None]


def test_country_names(spark):
    cases = {
        "Congo, Democratic Republic of the": "Congo",
        "Congo, The Democratic Republic of the": "DR Congo",
        "Korea, Republic of": "South Korea",
        "Virgin Islands, British": "British Virgin Islands",
        "Bolivia, Plurinational State of": "Bolivia",
        "France": "France",
    }
    assert column(spark, list(cases), S.country_name(F.col("v"))) == list(cases.values())


def test_file_names(spark):
    cases = {
        "evil.com": "evil.com",
        "http://a/b?c": "http_protocol_a_slash_b_question_c",
        "..x y..": "x_y",
        "???": "question_question_question",
        "...": "default_ioc_name",
        "a" * 99 + "._b": "a" * 99,
    }
    assert column(spark, list(cases), S.file_name(F.col("v"))) == list(cases.values())


def test_routable(spark):
    import ipaddress

    rng = random.Random(5)
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(500)]
    ips += ["10.0.0.1", "192.0.2.1", "224.0.0.1", "100.64.0.1", "192.0.0.9", "192.0.0.10",
            "192.0.0.11", "255.255.255.255", "0.0.0.0", "127.0.0.1", "198.19.255.255", "240.0.0.1"]
    want = []
    for ip in ips:
        o = ipaddress.ip_address(ip)
        want.append(not (o.is_private or o.is_loopback or o.is_unspecified or o.is_reserved))
    assert column(spark, ips, S.is_routable(F.col("v"))) == want
    assert column(spark, ["1.2.3", "x", "1.2.3.4.5", "256.1.1.1"], S.is_routable(F.col("v"))) == [False] * 4


def test_url_parts_and_resolve(spark):
    rng = random.Random(3)
    bases = ["http://h.com", "http://h.com/", "https://u:p@h.com:8/a/b/c.html?x=1#f", "http://h.com/a/b/",
             "http://h.com/a//b;p=1"]
    atoms = ["a", "b.html", "..", ".", "/", "//", "?", "q=1", "#", "#f", ";p", "http:", "https:", "mailto:", "x y", ""]
    hrefs = ["".join(rng.choice(atoms) for _ in range(rng.randrange(5))) for _ in range(600)]
    hrefs += ["/a/../../b", "../x", "?q", "#", "", "//other.com/x", "http://o.com/a/../b"]
    rows = [(b, h) for b in bases for h in hrefs]
    want = []
    for b, h in rows:
        full = urljoin(b, h)
        p = urlparse(full)
        want.append((full.rstrip("#"), p.netloc, p.path, p.fragment))
    got = column(
        spark, rows,
        F.struct(
            U.resolve(F.col("v"), F.col("h")).alias("u"),
            U.authority(U.resolve(F.col("v"), F.col("h"))).alias("n"),
            U.path(U.resolve(F.col("v"), F.col("h"))).alias("p"),
            U.fragment(U.resolve(F.col("v"), F.col("h"))).alias("f"),
        ),
        "v string, h string",
    )
    wrong = [(r, w, tuple(g)) for r, w, g in zip(rows, want, got)
             if (w[1], w[2], w[3]) != (g["n"], g["p"], g["f"])]
    # Only what can survive the same-site filter has to agree in full.
    base_host = {b: urlparse(b).netloc for b in bases}
    wrong = [x for x in wrong if x[1][1] == base_host[x[0][0]] or x[2][1] == base_host[x[0][0]]]
    assert wrong == []
    texts = [(r, w[0], g["u"]) for r, w, g in zip(rows, want, got)
             if w[1] == base_host[r[0]] and not w[3] and w[0] != g["u"]]
    assert texts == []


def test_running_is_ordered_over_blocks(spark):
    df = spark.range(3).select("id", F.sequence(F.lit(1), F.col("id") * 200 + 1).alias("a"))
    out = df.select("id", running(F.col("a"), F.lit(0).cast("long"), "long",
                                  lambda s, x: (s + x, F.array(s + x))).alias("o"))
    for r in out.collect():
        n = r["id"] * 200 + 1
        assert r["o"] == [i * (i + 1) // 2 for i in range(1, n + 1)]
    empty = spark.range(1).select(running(F.array().cast("array<long>"), F.lit(0).cast("long"), "long",
                                          lambda s, x: (s + x, F.array(s))).alias("o"))
    assert empty.first()["o"] == []


def test_lexicon_pattern_prefers_longest(spark):
    names = ["APT28", "APT 28", "APT2", "Fancy Bear", "Fancy", "U.S.", "C++"]
    text = "apt28 APT 28, apt2 x fancy  fancy bear fancybear U.S. U.S.A c++ C++x zapt28"
    flat = r"\b(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")\b"
    want = [m.group(0) for m in re.finditer(flat, text, re.I)]
    got = column(spark, [text], F.regexp_extract_all(F.col("v"), F.lit("(" + M.lexicon_pattern(names) + ")"), F.lit(1)))
    assert got == [want]
