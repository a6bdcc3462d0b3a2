"""What is shuffled, dealt and held at once, whatever the size of the tables."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_store import AS_OF, sample
from veilsight.operators import records as R
from veilsight.operators import stix as X
from veilsight.operators import store as T
from veilsight.operators.enrichment import Structured
from veilsight.plans.queries import QUERIES
from veilsight.session import written_by
from veilsight.sources import pages as P

KEY = ("ioc_value", "ioc_type")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def joins_by_sorting(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def in_buckets(spark):
    batch = sample(spark)
    return Structured(*[written_by(df, "test", *KEY, buckets=3) for df in (batch.iocs, batch.sources, batch.mentions)])


def test_buckets_keep_rows_with_null_keys(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), (None, "t", 3), ("b", "t", 4)], "ioc_value string, ioc_type string, n int")
    kept = written_by(rows, "test", *KEY, buckets=3)
    assert sorted(r["n"] for r in kept.collect()) == [1, 2, 3, 4]
    assert "Exchange" not in physical(kept.groupBy(*KEY, "n").count())
    again = written_by(kept.groupBy(*KEY).agg(F.count("*").alias("c")), "test", *KEY, buckets=3, dealt=True)
    assert sorted(r["c"] for r in again.collect()) == [1, 1, 2]


def test_edge_ids_are_not_shuffled(spark, joins_by_sorting):
    batch = in_buckets(spark)
    counted = X.count_objects(X.bundle_parts(batch, AS_OF))
    plain = X.bundle_objects(batch, AS_OF).groupBy("type").agg(F.count("*").alias("objects"), F.countDistinct("id").alias("ids"))
    assert sorted(counted.collect()) == sorted(plain.collect())
    for edges in X.edges(batch).values():
        assert "Exchange" not in physical(edges.groupBy(*KEY).agg(F.countDistinct("id")))


def test_names_are_hashed_once_a_name_and_actors_of_edges_before_their_join(spark, joins_by_sorting):
    batch = in_buckets(spark)
    edges = X.edges(batch)
    for df, kind, ref in ((X.intrusion_sets(batch), "uses", "source_ref"), (X.vulnerabilities(batch), "targets", "target_ref")):
        assert "sha1(" not in physical(df)  # not in rows of mentions: the id is made of a group's name
        assert [r["id"] for r in df.collect()] == [r[ref] for r in edges[kind].collect()]
    assert "sha1(" not in physical(X.locations(batch))
    top, _, below = physical(edges["targets"]).partition("SortMergeJoin")
    assert "concat_ws(\x1f, _head#" in top and "AS _head#" in below


def test_uuid5_of_any_text(spark):
    import uuid

    from veilsight.fixed_values import STIX_NAMESPACE

    names = ["", "a", "b\x1fc", "é", "日本語 Æ", "\U0001f642", "x" * 300]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", X.uuid5(F.col("name")).alias("id"))
    assert {r["name"]: r["id"] for r in rows.collect()} == {n: str(uuid.uuid5(uuid.UUID(STIX_NAMESPACE), n)) for n in names}


def test_records_meet_without_a_shuffle_of_lists(spark, joins_by_sorting):
    plan = physical(R.records(in_buckets(spark), AS_OF))
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "part#" in line]
    want = sorted(map(str, R.records(sample(spark), AS_OF).collect()))
    assert sorted(map(str, R.records(in_buckets(spark), AS_OF).collect())) == want


def test_sightings_and_links_are_shuffled_by_the_indicator(spark, joins_by_sorting):
    batch = sample(spark)
    key = T.ioc_key(F.col("ioc_value"), F.col("ioc_type"))
    known = batch.sources.limit(1).select(key.alias("ioc_id"), F.col("url").alias("source_article_url"))
    unknown = spark.createDataFrame([(None, "https://harbour.test/log"), ("x", None)], "ioc_id string, source_article_url string")
    fresh = T.new_sightings(batch, known.unionByName(unknown), AS_OF)
    assert fresh.count() == batch.sources.count() - 1
    countries = spark.createDataFrame([("Russia", "RU")], "name string, iso2_code string")
    actors = spark.createDataFrame([], "name string, aliases array<string>, description string, seq long")
    links = T.bridges(batch, fresh, actors, countries)
    for df, other in ((fresh, "source_article_url"), (links["actors"], "actor_name"), (links["countries"], "country_iso2"), (links["cves"], "cve")):
        shuffled = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", physical(df))
        assert shuffled and not [x for x in shuffled if "ioc_id#" in x and f"{other}#" in x], (other, shuffled)


def test_pages_are_parsed_in_portions():
    htmls = ["x" * 40, None, "", "y" * 500, "z" * 40, "é" * 30]
    batch = pa.record_batch({"html": pa.array(htmls)})
    portions = [p.column("html").to_pylist() for p in P._portions(batch, "html", 100)]
    assert [h for p in portions for h in p] == htmls
    assert portions == [["x" * 40, None, ""], ["y" * 500], ["z" * 40, "é" * 30]]
    assert list(P._portions(batch.slice(0, 0), "html", 100)) == []


def test_table_pages_are_dealt_to_all_cores(spark, sf_dir):
    for name in ("country_table_page", "tld_table_page", "actor_table_page"):
        assert "REPARTITION_BY_NUM" in physical(QUERIES[name](spark, sf_dir)), name
