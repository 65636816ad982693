"""Every query over made forms against its SQL."""

import duckdb
import pytest

from leafmill.plans import cases

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_forms_against_sql(spark, name):
    got = cases.QUERIES[name](spark, FOLDER)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
        want = con.sql(cases.ORACLES[name])
        assert got.columns == want.columns
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
