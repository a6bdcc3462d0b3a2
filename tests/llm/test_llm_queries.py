"""Queries of the operators against their SQL."""

import duckdb
import pytest

from check_oracle import TABLES, compare
from veilsight.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    outcome, _, _ = compare(spark, con, name, sf_dir)
    assert outcome.startswith("ok"), outcome


def test_all_are_registered():
    import __spark_entry__

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
