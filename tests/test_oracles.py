"""Every query with an oracle matches DuckDB at sf0.001 (the driver checks sf0.01)."""

import duckdb
import pytest

from conftest import SF001
from oracle_check import TYPE_MAP, rows_of
from __spark_entry__ import entry, oracle_sql, queries
from credence.sources.tables import TABLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF001)
    res = con.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert stypes == {c: TYPE_MAP.get(str(t), str(t)) for c, t in zip(dcols, [d[1] for d in res.description])}
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0 and "fake_score" in df.columns


def test_every_query_has_a_name_and_runs_lazily():
    assert set(oracle_sql()) <= set(queries())
