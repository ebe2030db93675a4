"""Streams without an end: stencil-free kernels with state, over Structured Streaming.

Rows carry stream_id and row_id. Rows may come late or out of order: a stream's state holds rows back until all before
them are there, so results equal those of a batch run over the same rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rowloom.operators.kernels import REGISTRY, Runner
from rowloom.session import importable


#: Rows that a stream may hold back for one that is missing, unless the caller says otherwise.
MAX_WAITING = 1 << 20


def run_stateful(df: DataFrame, name: str, column: str, output_type: str, max_waiting: int = MAX_WAITING, **args: object) -> DataFrame:
    """A sequential operation of one input over a streaming frame with stream_id, row_id and ``column``: stream_id, row_id,
    value and error.

    The kernel object itself is the state, pickled between batches, with the next row id and the rows that wait. A stream
    with an element that its kernel fails on, or with more than ``max_waiting`` rows waiting, gives one row with the error
    and nothing after it; the other streams go on. NaN is a value; a null goes past a kernel unless it accepts nulls.
    """
    op = REGISTRY[name]
    importable(df.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, waiting, kernel, error = pickle.loads(state.get[0]) if state.exists else (0, {}, None, None)
        if error is not None:
            return
        runner = Runner(op, args, {}, 1, (column,))
        if kernel is None:
            runner.start(int(key[0]), None, True)
        elif runner.kernel is not None:
            runner.kernel.__dict__.update(kernel)
        kind = op.inputs[0][1]
        for pdf in batches:
            for r, v, null in zip(pdf["row_id"].tolist(), pdf[column].tolist(), pdf["__null"].tolist()):
                if r >= following:
                    waiting[r] = None if null else kind.decode(v)
        rows, values = [], []
        while following in waiting:
            rows.append(following)
            values.append((waiting.pop(following),))
            following += 1
        made = runner.rows(values)
        bad = next((i for i, (_, e) in enumerate(made) if e), None)
        if bad is not None:
            rows, made, error = rows[: bad + 1], made[: bad + 1], made[bad][1]
        elif len(waiting) > max_waiting:
            error = f"{len(waiting)} rows wait for row {following}"
            rows, made = [*rows, following], [*made, ((None,), error)]
        if error is not None:
            waiting = {}
        state.update((pickle.dumps((following, waiting, dict(runner.kernel.__dict__) if runner.kernel is not None else {}, error)),))
        yield pd.DataFrame({"stream_id": [int(key[0])] * len(rows), "row_id": rows, "value": pd.Series([v[0] for v, _ in made], dtype=object), "error": pd.Series([e for _, e in made], dtype=object)})

    marked = df.withColumn("__null", F.col(column).isNull())
    return marked.groupBy("stream_id").applyInPandasWithState(update, f"stream_id long, row_id long, value {output_type}, error string", "state binary", "append", GroupStateTimeout.NoTimeout)


def sample_stride(df: DataFrame, stride: int) -> DataFrame:
    """Every stride-th row, renumbered: it needs no state."""
    if stride <= 0:
        raise ValueError("stride must be positive")
    return df.where(F.col("row_id") % stride == 0).withColumn("row_id", ((F.col("row_id") - F.col("row_id") % stride) / stride).cast("long"))


def sample_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of [start, end), renumbered."""
    return df.where((F.col("row_id") >= start) & (F.col("row_id") < end)).withColumn("row_id", F.col("row_id") - start)


def windowed_counts(df: DataFrame, timestamp: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by event-time window and key; rows later than ``late`` behind the newest are left out."""
    return df.withWatermark(timestamp, late).groupBy(F.window(timestamp, width), key).count().select(F.col("window.start").alias("start"), key, "count")
