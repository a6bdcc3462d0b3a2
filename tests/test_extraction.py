import random

import pytest
from pyspark.sql import functions as F

from constructed import HARMLESS, build, dirty, random_built, snippet
from veilsight.functions.textmatch import lexicon_pattern
from veilsight.operators import extraction as X
from veilsight.operators.mentions import occurrences_by_join
from veilsight.operators.reference import Reference, actor_lexicon, whitelist_frame

TLDS = ("com", "org", "net", "zip", "sh", "py", "de")
ACTORS = ["APT28", "APT 28", "Fancy Bear", "Lazarus Group", "Lazarus"]
COUNTRIES = ["North Korea", "Russia", "Korea"]
# Pieces that make up texts without a known answer: both ways of using reference tables must agree on them.
PIECES = [
    "a", "word", "host.example.com", "host[.]com", "a.b.c.d.e", "x.exe", ".exe", ",", ";", ".", "-", "@", "[.]", "1.2.3.4", "1 2 3", "10.0.0.1", "hxxp://h[.]com/a",
    "APT28", "apt 28", "fancy bear", "FANCY", "bear", "Lazarus Group", "lazarus", "north korea", "Türkiye", "TÜRKİYE", "ſofacy", "SOFACY", "Russia", "Russian", "_", "é",
    "for example", "google.com", "CVE-2024-1234", "“", "\u00a0", "\n", "K", "x" * 70,
]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " ", " ", ". "]) for _ in range(rng.randrange(30))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "article_idx long, text string")


ALL_TABLES = frozenset(["tlds", "whitelist", "actors", "countries"])


def reference(spark, joined=frozenset()):
    lex = [(n, "APT28" if n.lower() in ("apt28", "apt 28", "fancy bear") else "Lazarus Group") for n in ACTORS]
    return Reference(
        tlds=spark.createDataFrame([(t,) for t in TLDS], "tld string"),
        whitelist=whitelist_frame(spark),
        actors=spark.createDataFrame([(n.lower(), c) for n, c in lex], "name string, canonical string"),
        countries=spark.createDataFrame([(c,) for c in COUNTRIES], "name string"),
        joined=joined,
    )


def actual(spark, texts, ref):
    rows = X.extract(frame(spark, texts), ref).collect()
    got = {i: [] for i in range(len(texts))}
    for r in rows:
        got[r["article_idx"]].append((r["pos"], r["end_pos"], r["ioc_type"], r["ioc_value"], r["context_snippet"]))
    return [sorted(got[i]) for i in range(len(texts))], rows


@pytest.mark.parametrize("joined", [frozenset(), ALL_TABLES])
def test_parts_of_built_texts_are_found(spark, joined):
    built, rng = random_built(300, 7)
    got, rows = actual(spark, [dirty(rng, text) for text, _ in built], reference(spark, joined))
    for (text, hits), found in zip(built, got, strict=True):
        assert found == [(s, e, kind, value, snippet(text, s, e)) for s, e, kind, value in hits], text
    kinds = {r["ioc_type"] for r in rows}
    assert kinds == {"url", "email", "file", "domain", "cve", "ipv4", "md5", "sha1", "sha256", "apt_group_mention", "country_mention"}
    for r in rows:
        named = {"apt28": "APT28", "fancy bear": "APT28", "lazarus group": "Lazarus Group"}
        assert r["normalized_value"] == (named[r["ioc_value"].lower()] if r["ioc_type"] == "apt_group_mention" else None)


def test_harmless_context_drops_what_stands_near(spark):
    rng = random.Random(2)
    built = [b for b in (build(rng, 1) for _ in range(160)) if "@" not in b[0]]
    got, _ = actual(spark, [f"{HARMLESS} {text}" for text, _ in built], reference(spark))
    shift = len(HARMLESS) + 1
    for (text, hits), found in zip(built, got, strict=True):
        kept = [h for h in hits if h[2] not in ("url", "domain", "file", "ipv4", "email") or h[0] + shift - 50 > 0]
        assert [f[:4] for f in found] == [(s + shift, e + shift, k, v) for s, e, k, v in kept], text


@pytest.mark.parametrize("seed", [11, 12])
def test_joined_tables_give_the_same(spark, seed):
    texts = random_texts(120, seed) + ["", "nothing here", "in TÜRKİYE and Türkiye", "by ſofacy, Sofacy", "x blank start y"]
    extra = {"countries": ["Türkiye", " blank start", "Russia"], "actors": [("sofacy", "APT28"), ("apt28", "APT28"), ("fancy bear", "APT28")]}
    results = []
    for joined in (frozenset(), ALL_TABLES, frozenset(["countries"])):
        base = reference(spark, joined)
        ref = Reference(
            tlds=base.tlds, whitelist=base.whitelist, joined=joined, countries=spark.createDataFrame([(c,) for c in extra["countries"]], "name string"),
            actors=spark.createDataFrame(extra["actors"], "name string, canonical string"),
        )
        annotated = X.annotate(frame(spark, texts), ref)
        results.append((actual(spark, texts, ref)[0], annotated.count()))
    assert results[0] == results[1] == results[2]
    found = [[h[3] for h in hits] for hits in results[0][0][-4:]]
    assert found == [[], ["TÜRKİYE", "Türkiye"], ["ſofacy", "Sofacy"], ["blank start"]]


def test_a_large_table_must_be_named(spark, monkeypatch):
    from veilsight.operators import reference as module

    monkeypatch.setattr(module, "MAX_LITERALS", 2)
    with pytest.raises(ValueError, match="joined"):
        module.bounded(spark.range(4), 2)


def test_named_cases(spark):
    texts = ["see evil.exe now", "see evil.zip now", "go www.google.com now", "go google.com now",
             "for example 5.6.7.8 x", "10.0.0.1 x 192.0.2.1 x 224.0.0.1", "ip 1 2 3 4 end"]
    got, _ = actual(spark, texts, reference(spark))
    assert [[(t, v) for _, _, t, v, _ in g] for g in got] == [
        [("file", "evil.exe")], [("domain", "evil.zip")], [("domain", "www.google.com")], [], [],
        [("ipv4", "224.0.0.1")], [("ipv4", "1.2.3.4")]]


def test_actor_lexicon(spark):
    actors = spark.createDataFrame(
        [(1, "APT28", ["Fancy Bear", "Sofacy"]), (2, "Lazarus Group", None), (3, "Sofacy", []), (4, None, ["x"])],
        "seq long, name string, aliases array<string>")
    got = {r["name"]: r["canonical"] for r in actor_lexicon(actors).collect()}
    assert got == {"apt28": "APT28", "apt 28": "APT28", "fancy bear": "APT28", "sofacy": "Sofacy",
                   "lazarus group": "Lazarus Group"}


def test_long_runs_do_not_overflow(spark):
    texts = ["1." * 30_000 + "x", "a." * 20_000 + "com", ("x.exe," * 5_000), "a" * 200_000, "é" * 50_000 + " 1.2.3.9"]
    got, _ = actual(spark, texts, reference(spark))
    assert [len(g) for g in got] == [0, 1, 5_000, 0, 1]


def test_mentions_by_join(spark):
    names = [*COUNTRIES, "Korea, Republic of", "a-b", "Türkiye", "-x"]
    texts = [" ".join(t.split()) for t in random_texts(100, 13)] + ["", "North Korea", "xNorth Korea north koreas,north korea.", "KOREA, Republic of Korea, republic", "a-b a-bc -a-b-x y-x"]
    df = frame(spark, texts)
    rows = occurrences_by_join(df.withColumnRenamed("text", "_text"), spark.createDataFrame([(c,) for c in names], "name string")).collect()
    got = sorted((r["article_idx"], r["s"], r["e"], r["raw"], r["snippet"]) for r in rows)
    one_pattern = df.select("article_idx", "text", F.explode(X.hits(F.col("text"), lexicon_pattern(names))).alias("h")).collect()
    want = sorted((r["article_idx"], r["h"]["s"], r["h"]["e"], r["h"]["raw"], snippet(r["text"], r["h"]["s"], r["h"]["e"])[3:-3]) for r in one_pattern)
    assert got == want and len(got) > 20


def test_long_names_and_repeated_ones(spark):
    df = frame(spark, ["some words " * 50, "x" * 5000, None]).withColumnRenamed("text", "_text")
    names = spark.createDataFrame([("words",), ("WORDS",), ("x" * 5000,), ("",), (None,)], "name string")
    got = occurrences_by_join(df, names).groupBy("article_idx").count().collect()
    assert sorted(r["count"] for r in got) == [1, 50]
    assert occurrences_by_join(df, names.limit(0)).count() == 0


def test_what_a_full_bitmap_lets_through_is_no_mention(spark, monkeypatch):
    """With far too few bits nearly every run is let through; the names decide."""
    from veilsight.operators import mentions

    texts = [" ".join(f"w{(i * k) % 997}" for i in range(300)) for k in range(1, 20)]
    names = [f"w{i}" for i in range(0, 997, 5)] + [f"w{i} w{2 * i}" for i in range(1, 90)]
    df = frame(spark, texts).withColumnRenamed("text", "_text")
    listed = spark.createDataFrame([(n,) for n in names], "name string")
    exact = sorted(map(tuple, occurrences_by_join(df, listed).collect()))
    monkeypatch.setattr(mentions, "MOST_BITS", 64)
    assert sorted(map(tuple, occurrences_by_join(df, listed).collect())) == exact and len(exact) > 500


def test_only_likely_runs_leave_their_row(spark):
    from veilsight.operators import mentions

    df = frame(spark, [" ".join(f"word{i}" for i in range(k, k + 2000)) for k in range(0, 20000, 2000)]).withColumnRenamed("text", "_text")
    names = spark.createDataFrame([(f"word{i}",) for i in range(0, 20000, 100)], "name string")
    bits = 1 << 13
    likely = df.select("_text", mentions.name_bitmap(names, bits).alias("b")).select(F.explode(mentions.candidates(F.col("_text"), [1, 2], F.col("b"), bits)))
    assert 200 <= likely.count() < 400  # of 40,000 runs of one or two words




def test_patterns_are_not_tried_in_dull_words(spark):
    """What is left between runs of dull words is small, and gives the hits of the whole text, at their places."""
    dull = "many plain words, between (things) and others... of no interest; "
    parts = ["a.b.com", "x.exe", "m@h.org", "1 2 3 4", "CVE-2024-1234", "http://a between", "d" * 32, "y.", "a well-known"]
    texts = random_texts(60, 5) + [(dull * 5 + p + " ") * 3 + end for p in parts for end in ("", "end", dull * 40)]
    df = frame(spark, texts).select(X.normalize_text(F.col("text")).alias("t"))
    kept = df.select("t", X.stretches(F.col("t")).alias("k")).collect()
    assert all(r["t"][x["s"]:x["s"] + len(x["t"])] == x["t"] for r in kept for x in r["k"])
    long = [r for r in kept if len(r["t"]) > 2500]
    assert long and all(sum(len(x["t"]) for x in r["k"]) < len(r["t"]) / 4 for r in long)
    spans = lambda found: F.transform(found, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["raw"].alias("raw")))
    whole = F.flatten(F.array(*[X.hits(F.col("t"), p, g) for _, p, g in X.scans(F.col("t"), (), ())]))
    rows = df.select(F.array_sort(spans(X.candidates(F.col("t")))).alias("got"), F.array_sort(spans(whole)).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows) and sum(len(r["got"]) for r in rows) > 100


def test_names_of_one_piece_are_not_brought_together_by_article(spark):
    """Pieces of one text don't overlap; two texts under one key may."""
    names = spark.createDataFrame([("bear",), ("lazarus",)], "name string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    once = spark.createDataFrame([(1, "bear lazarus bear"), (2, "bear")], "article_idx long, _text string")
    found = occurrences_by_join(once, names)
    assert sorted((r["article_idx"], r["s"]) for r in found.collect()) == [(1, 0), (1, 5), (1, 13), (2, 0)]
    assert "_found" not in plan(found) and "_found" in plan(occurrences_by_join(once.union(once), names))
    twice = spark.createDataFrame([(1, "bear lazarus"), (1, "a lazarus")], "article_idx long, _text string")
    assert [(r["s"], r["e"]) for r in occurrences_by_join(twice, names).orderBy("s").collect()] == [(0, 4), (5, 12)]
