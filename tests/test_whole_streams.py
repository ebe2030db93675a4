"""Queries over whole streams, longer than those of the smallest tables."""

from __future__ import annotations

import pytest

from rowloom.plans import catalogue


@pytest.mark.parametrize("events, orders", [(2500, 3000), (3000, 2500)])
def test_zip_takes_every_row_of_the_shorter_stream(spark, tmp_path, events, orders):
    spark.range(events).selectExpr("id AS event_id", "id * 2.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(orders).selectExpr("id AS o_orderkey", "id * 3.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    rows = catalogue.QUERIES["zip_streams_whole"](spark, str(tmp_path)).orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [(i, i * 5.0) for i in range(2500)]
