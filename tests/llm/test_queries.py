"""The subpackage's queries with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from textloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    key = sorted(got.columns)
    assert key == sorted(want.columns)
    a, b = (f[key].sort_values("doc_id").reset_index(drop=True) for f in (got, want))
    assert len(a) == len(b)
    for c in key:
        assert a[c].tolist() == pytest.approx(b[c].tolist()) if c == "target" else a[c].tolist() == b[c].tolist(), c


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
