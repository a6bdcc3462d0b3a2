"""State of unattended runs: what is taken back, refreshed dimensions, pages from the stream."""

from functools import partial

from pyspark.sql import functions as F

from test_extraction import reference
from veilsight.operators.store import ioc_key
from veilsight.plans import jobs as J
from veilsight.streaming import incremental as I

RUSSIA = [("Russia", "EU", "RU", "RUS", ".ru")]


def values(state):
    return sorted(r["value"] for r in state["iocs"].collect())


def test_removed_indicators_and_new_dimensions(spark, tmp_path):
    state = str(tmp_path / "state")
    batches = [["gull.example.com in Russia", "9.8.7.6 in Russia with CVE-2024-12345"], ["gull.example.com in Russia"]]
    ref = reference(spark)
    I.start_state(spark, state, {"countries": spark.createDataFrame(RUSSIA, J.TABLES["countries"])})
    frames = [spark.createDataFrame([(10 * b + i, f"http://h/{b}{i}", t) for i, t in enumerate(ts)], I.ARTICLES) for b, ts in enumerate(batches)]
    I.process_batch(frames[0], 0, state, "2024-05-01", ref)
    assert values(I.load_state(spark, state)) == ["9.8.7.6", "gull.example.com"]
    gone = spark.range(1).select(ioc_key(F.lit("gull.example.com"), F.lit("domain")).alias("ioc_id"))
    I.forget(spark, state, gone)
    left = I.load_state(spark, state)
    assert values(left) == ["9.8.7.6"] and left["sightings"].count() == 1 and left["sighting_countries"].count() == 1
    I.process_batch(frames[1], 1, state, "2024-05-02", ref)
    again = I.load_state(spark, state)
    assert values(again) == ["9.8.7.6", "gull.example.com"] and again["sightings"].count() == 2 and again["sighting_countries"].count() == 2
    assert values(I.load_state(spark, state, 1)) == ["9.8.7.6"]
    known = again["countries"]
    I.replace_table(spark, state, "countries", known.withColumn("name", F.lit("Russland")))
    I.replace_table(spark, state, "countries", I.load_state(spark, state)["countries"].withColumn("tld", F.lit(".su")))
    assert [(r["name"], r["tld"]) for r in I.load_state(spark, state)["countries"].collect()] == [("Russland", ".su")]


def test_pages_of_a_stream_become_tables_and_exports(spark, tmp_path):
    state, source, out = (str(tmp_path / x) for x in ("state", "pages", "out"))
    text = "The host gull.example.com was seen along the coast of Russia for weeks."
    rows = [
        (1, "https://e.test/", "<article><a href='/2024/05/x.html'>four words of link</a></article>"),
        (2, "https://e.test/2024/05/x.html", f"<article><p>{text}</p></article>"), (3, "https://e.test/2024/05/x.html", f"<article><p>{text} Newer.</p></article>"),
    ]
    spark.createDataFrame(rows, I.PAGES).coalesce(1).write.parquet(source)
    dims = {"countries": spark.createDataFrame(RUSSIA, J.TABLES["countries"])}
    process = partial(I.process_pages, export_to=out)
    I.run_incremental(spark, I.page_stream(spark, source), state, str(tmp_path / "cp"), "2024-05-02", reference(spark), dims, process)
    found = I.load_state(spark, state)
    assert values(found) == ["gull.example.com"] and [r["url"] for r in found["history"].collect()] == ["https://e.test/2024/05/x.html"]
    assert spark.read.option("header", True).csv(f"{out}/batch=0/csv").count() == 1
