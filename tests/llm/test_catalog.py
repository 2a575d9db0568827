"""The queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from alertloom.llm.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_all_registered():
    assert set(QUERIES) <= set(entry_module.queries()) and {f"op{n}_" for n in range(1, 14)} <= {q.split("_")[0] + "_" for q in QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    order = sorted(df.columns)
    ours = sorted(tuple(str(r[c]) for c in order) for r in df.collect())
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == order
    at = [rel.columns.index(c) for c in order]
    assert ours and ours == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())
