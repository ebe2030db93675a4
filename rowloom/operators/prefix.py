"""Running aggregates of a stream in two passes, so that one long stream is worked on in parallel.

State that combines (sums, counts, extremes) needs no sequential kernel: chunks are aggregated, the aggregates of earlier
chunks combined (one row a chunk), and each chunk's own running value added to what came before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def running(df: DataFrame, column: str, kind: str = "sum", name: str = "running", keys: tuple[str, ...] = ("stream_id",), chunk_rows: int = 1 << 20) -> DataFrame:
    """``df`` with the running sum, count, min or max of ``column`` in row_id order within ``keys``; nulls are passed over."""
    if kind not in _KINDS:
        raise ValueError(f"kind is one of {sorted(_KINDS)}")
    own, combine = _KINDS[kind]
    total = F.sum if kind == "count" else own
    chunked = df.withColumn("__chunk", ((F.col("row_id") - F.col("row_id") % chunk_rows) / chunk_rows).cast("long"))
    parts = chunked.groupBy(*keys, "__chunk").agg(own(column).alias("__part"))
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*keys, "__chunk", total("__part").over(earlier).alias("__before"))
    here = Window.partitionBy(*keys, "__chunk").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    within = chunked.withColumn("__own", own(column).over(here))
    return within.join(before, [*keys, "__chunk"]).withColumn(name, combine(F.col("__before"), F.col("__own"))).select(*df.columns, name)
