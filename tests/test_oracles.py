"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from tessera.fixtures import DRIVER_TABLES
from tessera.plans.registry import load_all
from tools_compare import digest

SF = "/root/testdata/sf0.001"
REG = load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if q.oracle))
def test_matches_oracle(spark, con, name):
    q = REG[name]
    df = q.fn(spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(q.oracle)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if not q.oracle))
def test_runs_without_oracle(spark, name):
    df = REG[name].fn(spark, SF)
    assert df.count() >= 0
