"""Every registered query against its DuckDB equivalent, on the smallest tables."""

import os

import duckdb
import pytest

from chartloom.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, tables, tmp_path, name):
    QUERIES[name](spark, DIR).write.parquet(str(tmp_path / "out"))
    tables.execute(f"CREATE OR REPLACE TEMP TABLE expected AS {ORACLES[name]}")
    tables.execute(f"CREATE OR REPLACE TEMP TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = [sorted(r[0] for r in tables.execute(f"DESCRIBE {t}").fetchall()) for t in ("expected", "got")]
    assert columns[0] == columns[1]
    listed = ", ".join(f'"{c}"' for c in columns[0])
    for a, b in (("expected", "got"), ("got", "expected")):
        assert tables.execute(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b} LIMIT 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
