"""Every registered query equals its SQL on the smallest tables, where those are there."""

from __future__ import annotations

import os

import pytest

from rowloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not there")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("events", "embeddings", "orders", "lineitem", "documents", "conversations", "nation", "region"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ours = catalogue.QUERIES[name](spark, SMALL)
    cursor = c.execute(catalogue.ORACLE_SQL[name])
    names = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    assert sorted(ours.columns) == names
    assert sorted((tuple(r) for r in ours.select(*names).collect()), key=repr) == theirs
