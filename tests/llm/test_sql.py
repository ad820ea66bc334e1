"""Corpus queries against their SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from quarryline.llm import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, DATA), con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, got.select(*names).collect())) == sorted(f"Row({', '.join(f'{n}={v!r}' for n, v in zip(names, r, strict=True))})" for r in want.fetchall())
