"""Every registered query of the graph package against its SQL; the others against their schema."""

import duckdb
import pytest
from conftest import SF

from waymesh.plans.oracles import ORACLES
from waymesh.plans.queries import QUERIES

TABLES = ("events",)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got.columns) and not got.columns.duplicated().any()
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert rows(got).equals(rows(want))
