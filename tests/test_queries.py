import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from check_oracle import TABLES, compare  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from veilsight.plans.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    outcome, _, _ = compare(spark, con, name, sf_dir)
    assert outcome.startswith(("ok", "rows only")), outcome


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["type", "ioc_count"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_is_extracted_without_a_shuffle(spark, sf_dir):
    from veilsight.operators import extraction as X
    from veilsight.plans.queries import _reference

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS article_idx", "text")
    plan = physical(X.extract(docs, _reference(spark)))
    assert "Exchange" not in plan and "Python" not in plan
    # The extraction is evaluated in one place only.
    assert plan.count("hxxps") <= 2 * 2


def test_search_reads_only_what_it_needs(spark, sf_dir):
    plan = physical(QUERIES["ioc_search"](spark, sf_dir))
    scans = [line for line in plan.split("FileScan")[1:]]
    item = next(s for s in scans if "lineitem" in s)
    assert "l_extendedprice" not in item and "l_quantity" not in item


def test_tops_do_not_sort_everything(spark, sf_dir):
    for name in ("top_actors", "top_countries", "top_sources", "ioc_top_types"):
        assert "TakeOrderedAndProject" in physical(QUERIES[name](spark, sf_dir)), name
