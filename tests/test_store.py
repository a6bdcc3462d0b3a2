import json
import tempfile

import pytest
from pyspark.sql import functions as F

from test_extraction import reference
from veilsight.operators import dashboards as B
from veilsight.operators import records as R
from veilsight.operators import stix as X
from veilsight.operators import store as T
from veilsight.operators.enrichment import Structured
from veilsight.plans import jobs as J
from veilsight.sources import dimensions as D
from veilsight.sources import sinks
from veilsight.streaming import incremental as I

AS_OF = "2024-11-30 23:59:58"
MENTION = ("ioc_value string, ioc_type string, mention_type string, value string, normalized_value string, "
           "seen struct<article_idx:long,ppos:int,place:int,mpos:int>, context_snippet string, iso2_code string, description string")
SUM = "ab" * 16


def sample(spark):
    """A host of one page, an address of two, a checksum, and an address of a kind that has no object."""
    iocs = spark.createDataFrame(
        [("ferry.test", "domain", 1, "ferry.test sank\ntwice", (4, 1)), ("203.0.114.9", "ipv4", 2, "seen at sea", (4, 70)),
         (SUM, "md5", 1, "a chart", (5, 3)), ("w", "url", 1, "x", (6, 1))],
        "ioc_value string, ioc_type string, occurrence_count long, first_seen_context_snippet string, first_at struct<article_idx:long,pos:int>")
    log, chart = "https://harbour.test/log", "https://harbour.test/chart"
    sources = spark.createDataFrame(
        [("ferry.test", "domain", log), ("203.0.114.9", "ipv4", log), ("203.0.114.9", "ipv4", chart), (SUM, "md5", chart), ("w", "url", chart)],
        "ioc_value string, ioc_type string, url string")
    mentions = spark.createDataFrame(
        [("ferry.test", "domain", "cve", "CVE-2019-20001", None, (4, 1, 1, 20), "...", None, None),
         ("ferry.test", "domain", "apt_group_mention", "Gull", "Gull", (4, 1, 1, 30), "...", None, "d"),
         ("203.0.114.9", "ipv4", "country_mention", "russia", None, (4, 70, 70, 90), "...", "RU", None),
         ("203.0.114.9", "ipv4", "country_mention", "Atlantis", None, (4, 70, 70, 95), "...", None, None)], MENTION)
    return Structured(iocs, sources, mentions)


def test_insert_if_absent_and_upsert(spark):
    old = spark.createDataFrame([("DE", "Germany")], "iso2_code string, name string")
    new = spark.createDataFrame([("DE", "X"), ("FR", "France"), ("FR", "Gaul")], "iso2_code string, name string")
    got = sorted(tuple(r) for r in T.insert_if_absent(old, new, "iso2_code").collect())
    assert got == [("DE", "Germany"), ("FR", "France")]
    old = spark.createDataFrame([("G1", "a", 1), ("G2", "b", 2)], "mitre_id string, name string, seq long")
    new = spark.createDataFrame([("G2", None), ("G3", "c")], "mitre_id string, name string")
    got = sorted(tuple(r) for r in T.upsert(old, new, "mitre_id").collect())
    assert got == [("G1", "a", 1), ("G2", None, 2), ("G3", "c", None)]


def test_of_several_new_rows_with_a_key_the_last_counts(spark):
    old = spark.createDataFrame([("G1", "a", 9)], "mitre_id string, name string, seq long")
    new = spark.createDataFrame([("G1", "z", 1), ("G1", "b", 2), ("G2", "y", 3), ("G2", None, 4)], "mitre_id string, name string, seq long")
    got = sorted(tuple(r) for r in T.upsert(old, new, "mitre_id", last_by="seq").collect())
    assert got == [("G1", "b", 2), ("G2", None, 4)]


def test_load_twice(spark):
    batch = sample(spark)
    tables = J.empty_tables(spark)
    countries = spark.createDataFrame([("Russia", "RU")], "name string, iso2_code string")
    fresh = T.new_sightings(batch, tables["sightings"], AS_OF)
    assert fresh.count() == 5 and T.new_iocs(batch, tables["iocs"], AS_OF).count() == 4
    linked = T.bridges(batch, fresh, tables["actors"], countries)
    assert linked["countries"].count() == 2 and linked["cves"].count() == 1 and linked["actors"].count() == 1
    assert [r["name"] for r in linked["added_actors"].collect()] == ["Gull"]
    iocs = T.new_iocs(batch, tables["iocs"], AS_OF)
    assert T.new_iocs(batch, iocs, AS_OF).count() == 0
    assert T.new_sightings(batch, fresh, AS_OF).count() == 0
    key = T.ioc_key(F.lit("203.0.114.9"), F.lit("ipv4"))
    ids = spark.range(1).select(key.alias("ioc_id"))
    state = {"iocs": iocs, "sightings": fresh, "sighting_countries": linked["countries"], "sighting_cves": linked["cves"]}
    left = T.delete_ioc(ids, state)
    assert [left[n].count() for n in ("iocs", "sightings", "sighting_countries", "sighting_cves")] == [3, 3, 0, 1]
    gone = spark.createDataFrame([("nope",)], "ioc_id string")
    assert [r["deleted"] for r in T.was_deleted(gone, iocs).collect()] == [False]
    assert T.delete_ioc(gone, state)["iocs"].count() == 4


def test_false_positives_go_to_whitelist(spark):
    white = spark.createDataFrame([("domains", "Google.com")], "kind string, value string")
    reported = spark.createDataFrame([("google.COM", "domain"), ("http://bad.org/x", "url"), ("a.exe", "file"), ("x", "cve")],
                                     "value string, type string")
    got = sorted(tuple(r) for r in T.whitelist_additions(reported, white).collect())
    assert got == [("domains", "Google.com"), ("domains", "bad.org"), ("files", "a.exe")]


def test_history_update(spark):
    h = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-01")], "url string, d string").select("url", F.col("d").cast("timestamp").alias("last_scanned"))
    u = spark.createDataFrame([("b",), ("c",)], "url string")
    got = sorted((r["url"], str(r["last_scanned"])[:10]) for r in T.update_history(h, u, F.lit("2024-02-01")).collect())
    assert got == [("a", "2024-01-01"), ("b", "2024-02-01"), ("c", "2024-02-01")]


def test_records_csv_json(spark):
    batch = sample(spark)
    rows = {r["ioc_value"]: r for r in R.csv_records(R.records(batch, AS_OF)).collect()}
    ip = rows["203.0.114.9"]
    assert ip["source_article_urls"] == "https://harbour.test/chart|https://harbour.test/log" and ip["part"] == 0
    assert ip["associated_countries"] == "russia;Atlantis" and ip["associated_cves"] == ""
    assert rows["ferry.test"]["first_seen_context_snippet"] == "ferry.test sank twice"
    assert rows["ferry.test"]["normalized_apts"] == "Gull"
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    counts = sinks.export(batch, path, AS_OF)
    assert counts["json"] == 4 and counts["csv"] == 4
    back = spark.read.json(f"{path}/json")
    assert {r["file_key"] for r in back.collect()} >= {"domain_ferry.test.json"}
    csv = spark.read.option("header", True).option("escape", '"').csv(f"{path}/csv")
    assert csv.columns[:4] == ["ioc_value", "ioc_type", "discovery_timestamp", "occurrence_count"] and csv.count() == 4
    kinds = [json.loads(r["value"])["type"] for r in spark.read.text(f"{path}/stix").collect()]
    assert counts["stix"] == len(kinds)
    for kind, n in (("domain-name", 1), ("ipv4-addr", 1), ("file", 1), ("vulnerability", 1), ("intrusion-set", 1), ("report", 2), ("relationship", 2), ("location", 1)):
        assert kinds.count(kind) == n, kind


def test_long_lists_are_split_not_cut(spark):
    n = 500
    iocs = spark.createDataFrame([("a.com", "domain", n, "s", (0, 0))], "ioc_value string, ioc_type string, occurrence_count long, first_seen_context_snippet string, first_at struct<article_idx:long,pos:int>")
    sources = spark.range(n).select(F.lit("a.com").alias("ioc_value"), F.lit("domain").alias("ioc_type"), F.concat(F.lit("u"), "id").alias("url"))
    batch = Structured(iocs, sources, spark.createDataFrame([], MENTION))
    rows = R.records(batch, AS_OF, max_items=50).collect()
    assert sorted(r["part"] for r in rows) == list(range(10))
    nested = R.records(batch, AS_OF, max_items=50)
    assert len({r["file_key"] for r in R.json_records(nested).collect()}) == 10
    assert len({r["part"] for r in R.csv_records(nested).collect()}) == 10
    assert sorted(u for r in rows for u in r["source_article_urls"]) == sorted(f"u{i}" for i in range(n))


def test_stix_bundle(spark):
    import uuid
    batch = sample(spark)
    lines = X.framed(X.bundle_objects(batch, AS_OF)).orderBy("part", "id").collect()
    data = json.loads("".join(r["line"] for r in lines))
    assert data["type"] == "bundle" and data["spec_version"] == "2.1" and data["id"].startswith("bundle--")
    assert len(data["objects"]) == len(lines) - 2
    empty = X.framed(X.bundle_objects(batch, AS_OF).limit(0)).orderBy("part", "id").collect()
    assert json.loads("".join(r["line"] for r in empty))["objects"] == []
    domain = next(o for o in data["objects"] if o["type"] == "domain-name")
    space = uuid.UUID("00abedb4-aa42-466c-9c01-fed23315a9b7")
    assert domain["value"] == "ferry.test" and domain["id"] == f"domain-name--{uuid.uuid5(space, json.dumps({'value': 'ferry.test'}, separators=(',', ':')))}"
    assert next(o for o in data["objects"] if o["type"] == "location")["name"] == "Russia"
    assert next(o for o in data["objects"] if o["type"] == "file")["hashes"] == {"MD5": SUM}


def test_dimension_pages(spark):
    def page(html):
        return spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")

    row = "<tr><td><a>{}</a></td><td>{}</td><td>{}</td><td>{}</td></tr>"
    apts = "<table><tbody>" + row.format("N1", "Gull", " Tern , Auk,,", "seabird") + "<tr><td>odd</td></tr>" + row.format("N2", "Eider", "", "duck") + "</tbody></table>"
    got = D.actors_from_page(page(apts)).orderBy("seq").collect()
    assert [(r["mitre_id"], r["name"], r["aliases"], r["description"]) for r in got] == [
        ("N1", "Gull", ["Tern", "Auk"], "seabird"), ("N2", "Eider", [], "duck")]
    cells = "<td>{}</td><td></td><td>{}</td><td>{}</td><td>{}</td><td></td><td></td><td>{}</td>"
    countries = "<tbody><tr>" + cells.format("AS", "<span>x</span><span style='display:table'>Korea, Republic of</span>", "KR", "KOR", ".kr") + \
        "</tr><tr>" + cells.format("EU", "Moldova, Republic of", "MD", "MDA", ".md") + "</tr></tbody>"
    got = sorted(tuple(r) for r in D.countries_from_page(page(countries)).collect())
    assert got == [("Moldova", "EU", "MD", "MDA", ".md"), ("South Korea", "AS", "KR", "KOR", ".kr")]
    tlds = "<table id='tld-table'><tr><td><span class='domain tld'><a>.COM</a></span></td></tr></table><span class=domain>.no</span>"
    assert [r["tld"] for r in D.tlds_from_page(page(tlds)).collect()] == ["com"]
    tables = {**J.empty_tables(spark), "actors": D.actors_from_page(page(apts))}
    after = J.refresh(tables, {"apts": page(apts.replace("Eider", "King Eider"))})
    assert sorted(r["name"] for r in after["actors"].collect()) == ["Gull", "King Eider"]
    twice = page(apts.replace("</tbody>", row.format("N2", "Scoter", "", "x") + row.format("N3", "B", "", "x") + row.format("N3", "A", "", "x") + "</tbody>"))
    assert sorted(r["name"] for r in J.refresh(tables, {"apts": twice})["actors"].collect()) == ["A", "Gull", "Scoter"]
    both = "<tbody><tr>" + cells.format("EU", "Border", "BB", "BBB", ".bb") + "</tr><tr>" + cells.format("AS", "Border", "BB", "BBB", ".bb") + "</tr></tbody>"
    assert [r["continent_code"] for r in J.refresh(J.empty_tables(spark), {"countries": page(both)})["countries"].collect()] == ["EU"]


def test_settings_files(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{path}/w.json", "w") as f:
        json.dump({"domains": [" A.com "], "ips": ["1.1.1.1 "], "files": []}, f, indent=1)
    assert sorted(tuple(r) for r in D.whitelist_from_json(spark, f"{path}/w.json").collect()) == [("domains", "a.com"), ("ips", "1.1.1.1")]
    with open(f"{path}/t.json", "w") as f:
        json.dump({"tlds": ["COM", "Org"]}, f, indent=1)
    assert sorted(r["tld"] for r in D.tlds_from_json(spark, f"{path}/t.json").collect()) == ["com", "org"]
    assert [r["value"] for r in D.list_from_json(spark, f"{path}/t.json", "tlds").collect()] == ["COM", "Org"]
    log = spark.createDataFrame([("a", "2025-06-01 00:00:00"), ("b", "2025-05-01 00:00:00"), ("c", None), ("d", "x")], "name string, last_run string")
    assert {r["name"]: r["stale"] for r in J.needs_refresh(log, F.lit("2025-06-20")).collect()}["a"] is True
    assert {r["name"]: r["stale"] for r in J.needs_refresh(log, F.lit("2025-06-05")).collect()} == {"a": False, "b": True, "c": True, "d": True}


def test_dashboards(spark):
    s = spark.createDataFrame([("s1", "i1", "http://a.com/1", "2024-01-05"), ("s2", "i1", "http://a.com/2", "2024-01-06"), ("s3", "i2", "http://b.com/1", "2024-03-01"), ("s4", "i2", "nohost", "2022-01-01")],
                              "sighting_id string, ioc_id string, source_article_url string, d string")
    s = s.withColumn("sighting_timestamp", F.col("d").cast("timestamp"))
    series = [tuple(r) for r in B.monthly_series(s, "2024-03-15", 4).collect()]
    assert series == [("2023-12", "Dec 23", 0, 0), ("2024-01", "Jan 24", 1, 2), ("2024-02", "Feb 24", 0, 0), ("2024-03", "Mar 24", 1, 1)]
    assert [tuple(r) for r in B.top_sources(s).collect()] == [("a.com", 2), ("b.com", 1)]
    iocs = spark.createDataFrame([("i1", "x.com", "domain"), ("i2", "Y.com", "domain"), ("i3", "z", "file")], "ioc_id string, value string, type string")
    iocs = iocs.withColumn("first_seen_timestamp", F.lit("2024-01-01").cast("timestamp"))
    found = B.search_iocs(iocs, s, "Domain", ".COM")
    assert sorted((r["value"], r["sources"]) for r in found.collect()) == [("Y.com", 2), ("x.com", 2)]
    by = [r["value"] for r in B.sort_search(B.search_iocs(iocs, s), "last_sighting").collect()]
    assert by == ["z", "x.com", "Y.com"]
    assert B.search_display(B.search_iocs(iocs, s, "file")).first()["last_sighting"] == "N/A"
    h = s.select(F.col("source_article_url").alias("url"), F.col("sighting_timestamp").alias("last_scanned"))
    assert [r["domain"] for r in B.scanned_domains(h).collect()] == ["Alle", "", "a.com", "b.com"]
    assert [r["url"] for r in B.search_history(h, "a.com").collect()] == ["http://a.com/2", "http://a.com/1"]


def test_stream_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    texts = ["evil.com near Russia 1.2.3.4", "again evil.com and APT28 and Foo 9.8.7.6", "nothing", "1.2.3.4 with CVE-2024-12345"]
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, I.ARTICLES)
    ref = reference(spark)
    dims = {"countries": spark.createDataFrame([("Russia", "EU", "RU", "RUS", ".ru")], J.TABLES["countries"])}
    for part in ([0, 1], [2], [3]):
        df.filter(F.col("article_idx").isin(part)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    I.run_incremental(spark, I.article_stream(spark, f"{root}/in", 1), f"{root}/state", f"{root}/cp", "2024-05-01", ref, dims)
    state = I.load_state(spark, f"{root}/state")
    tables = {**J.empty_tables(spark), **dims}
    want = tables
    for part in ([0, 1], [2], [3]):
        some = df.filter(F.col("article_idx").isin(part))
        once = J.run_articles(some, some.select("url"), want, "2024-05-01", ref)
        want = once.applied(want)
    for name in ("iocs", "sightings", "sighting_cves", "sighting_countries", "sighting_actors", "actors"):
        cols = [c for c in want[name].columns if c not in ("aliases", "context_snippet")]
        assert sorted(map(str, state[name].select(cols).collect())) == sorted(map(str, want[name].select(cols).collect())), name
    # A batch without any indicator is not counted as scanned.
    assert sorted(r["url"] for r in state["history"].collect()) == ["http://h/0", "http://h/1", "http://h/3"]
    assert {r["metric"]: r["n"] for r in once.metrics.collect()}["texts"] == 1
    I.run_incremental(spark, I.article_stream(spark, f"{root}/in"), f"{root}/state", f"{root}/cp", "2024-06-01", ref, dims)
    assert I.load_state(spark, f"{root}/state")["sightings"].count() == state["sightings"].count()


def test_whole_run(spark):
    listing = spark.createDataFrame([(1, "https://e.com/", "<article><a href='/2024/05/x.html'>one two three four</a></article>")], "page_id long, url string, html string")
    pages = spark.createDataFrame([(2, "https://e.com/2024/05/x.html", "<article><p>The bad host evil.com was seen in Russia along with CVE-2024-12345 again.</p></article>"),
                                   (3, "https://e.com/other", "<p>x</p>")], "page_id long, url string, html string")
    tables = {**J.empty_tables(spark), "countries": spark.createDataFrame([("Russia", "EU", "RU", "RUS", ".ru")], J.TABLES["countries"])}
    target = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    out = J.run(listing, None, pages, tables, F.lit("2024-05-02"), reference(spark), export_to=f"{target}/out", formats=("csv", "stix"))
    counted = {r["metric"]: r["n"] for r in out.metrics.collect()}
    assert counted["exported csv"] == 1 and counted["exported stix"] >= 3 and "exported json" not in counted
    assert spark.read.option("header", True).csv(f"{target}/out/csv").count() == 1
    after = out.applied(tables)
    assert [(r["value"], r["type"]) for r in after["iocs"].collect()] == [("evil.com", "domain")]
    assert after["sighting_countries"].count() == 1 and after["sighting_cves"].count() == 1
    assert [r["url"] for r in after["history"].collect()] == ["https://e.com/2024/05/x.html"]
    again = J.run(listing, None, pages, after, F.lit("2024-05-03"), reference(spark))
    assert again.delta["sightings"].count() == 0
