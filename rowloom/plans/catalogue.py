"""Registered queries of the stream engine over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.client import CacheMode, Client
from rowloom.functions.vectors import resized
from rowloom.operators.prefix import running
from rowloom.plans.domain import SliceArgs
from rowloom.sources.catalog import FrameStream, StreamBatch
from rowloom.sources.files import PackedFileStream
from rowloom.types import pack_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str, column: str = "value") -> tuple[Client, Any]:
    """A client, and the events as one stream."""
    client = Client(spark)
    return client, client.io.Input([FrameStream(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", column)])


def plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(columns or ("row_id", "value")))


@query("SELECT event_id AS row_id, value FROM events")
def sample_all(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.All(e)))


@query("SELECT event_id // 4 AS row_id, value FROM events WHERE event_id % 4 = 0")
def sample_stride(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Stride(e, [4])))


@query("SELECT event_id - 100 AS row_id, value FROM events WHERE event_id >= 100 AND event_id < 300")
def sample_range(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Range(e, [(100, 300)])))


@query("SELECT r.off + e.event_id - r.a AS row_id, e.value FROM events e JOIN (VALUES (0,10,0),(100,150,10)) r(a,b,off) ON e.event_id >= r.a AND e.event_id < r.b")
def sample_ranges(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Ranges(e, [[(0, 10), (100, 150)]])))


@query("SELECT (event_id - 20) // 5 AS row_id, value FROM events WHERE event_id >= 20 AND event_id < 220 AND (event_id - 20) % 5 = 0")
def sample_strided_range(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.StridedRange(e, [(20, 220, 5)])))


@query("SELECT r.off + (e.event_id - r.a) // 3 AS row_id, e.value FROM events e JOIN (VALUES (0,10,0),(50,60,4)) r(a,b,off) ON e.event_id >= r.a AND e.event_id < r.b AND (e.event_id - r.a) % 3 = 0")
def sample_strided_ranges(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.StridedRanges(e, [[(0, 10), (50, 60)]], 3)))


@query("SELECT CAST(g.pos AS BIGINT) AS row_id, e.value FROM events e JOIN (VALUES (0,3),(1,612),(2,80),(3,944),(4,612),(5,7)) g(pos,rid) ON e.event_id = g.rid")
def sample_gather(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Gather(e, [[3, 612, 80, 944, 612, 7]])))


@query("SELECT event_id * 3 + j AS row_id, value FROM events, (SELECT unnest(range(3)) AS j)")
def space_repeat(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Repeat(e, [3])))


@query("SELECT event_id * 3 + j AS row_id, CASE WHEN j = 0 THEN value END AS value FROM events, (SELECT unnest(range(3)) AS j)")
def space_null(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.RepeatNull(e, [3])))


@query("SELECT (event_id // 4 - 10) * 2 + j AS row_id, value FROM events, (SELECT unnest(range(2)) AS j) WHERE event_id % 4 = 0 AND event_id // 4 >= 10 AND event_id // 4 < 100")
def sample_chain(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Repeat(c.streams.Range(c.streams.Stride(e, [4]), [(10, 100)]), [2])))


@query("SELECT event_id // 50 AS slice_id, event_id % 50 AS row_id, value FROM events")
def slice_all(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Slice(e, [c.partitioner.all(50)])), "slice_id", "row_id", "value")


@query("SELECT (event_id // 2) // 50 AS slice_id, (event_id // 2) % 50 AS row_id, value FROM events WHERE event_id % 2 = 0")
def slice_strided(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Slice(e, [c.partitioner.strided(2, 50)])), "slice_id", "row_id", "value")


@query("SELECT CAST(r.g AS BIGINT) AS slice_id, e.event_id - r.a AS row_id, e.value FROM events e JOIN (VALUES (0,2,21),(1,12,40),(2,30,33)) r(g,a,b) ON e.event_id >= r.a AND e.event_id < r.b")
def slice_ranges_overlap(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Slice(e, [c.partitioner.ranges([(2, 21), (12, 40), (30, 33)])])), "slice_id", "row_id", "value")


@query("SELECT CAST(r.g AS BIGINT) AS slice_id, (e.event_id - r.a) // 4 AS row_id, e.value FROM events e JOIN (VALUES (0,0,15),(1,100,200)) r(g,a,b) ON e.event_id >= r.a AND e.event_id < r.b AND (e.event_id - r.a) % 4 = 0")
def slice_strided_ranges(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Slice(e, [c.partitioner.strided_ranges([(0, 15), (100, 200)], 4)])), "slice_id", "row_id", "value")


@query("SELECT CAST(p.g AS BIGINT) AS slice_id, CAST(p.pos AS BIGINT) AS row_id, e.value FROM events e JOIN (VALUES (0,0,1),(0,1,7),(1,0,3)) p(g,pos,rid) ON e.event_id = p.rid")
def slice_gather(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Slice(e, [c.partitioner.gather([[1, 7], [3]])])), "slice_id", "row_id", "value")


@query("SELECT r.off + e.event_id - r.a AS row_id, e.value FROM events e JOIN (VALUES (0,10,0),(5,20,10),(20,30,25)) r(a,b,off) ON e.event_id >= r.a AND e.event_id < r.b")
def unslice_concat(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Unslice(c.streams.Slice(e, [c.partitioner.ranges([(0, 10), (5, 20), (20, 30)])]))))


@query("SELECT event_id AS row_id, value FROM events")
def unslice_all(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Unslice(c.streams.Slice(e, [c.partitioner.all(50)]))))


@query("SELECT r.off + e.event_id - r.a AS row_id, e.value FROM events e JOIN (VALUES (3,11,0),(13,19,8),(31,40,14)) r(a,b,off) ON e.event_id >= r.a AND e.event_id < r.b")
def slice_args(spark, sf_dir):
    """Overlapping slices, each sampled by a range of its own."""
    c, e = events(spark, sf_dir)
    cut = c.streams.Slice(e, [c.partitioner.ranges([(2, 21), (12, 40), (30, 45)])])
    return plain(c.frame(c.streams.Unslice(c.streams.Range(cut, [SliceArgs([(1, 9), (1, 7), (1, 10)])]))))


@query("SELECT event_id AS row_id, coalesce(lag(value) OVER w, value) AS prev_value, value, coalesce(lead(value) OVER w, value) AS next_value FROM events WINDOW w AS (ORDER BY event_id)")
def stencil_repeat_edge(spark, sf_dir):
    c, e = events(spark, sf_dir)
    df = c.frame(c.ops.Neighbours(value=e), "n")
    return df.select("row_id", F.col("n")[0].alias("prev_value"), F.col("n")[1].alias("value"), F.col("n")[2].alias("next_value"))


@query("SELECT event_id AS row_id, greatest(value, lag(value, 2, first) OVER w) AS value FROM (SELECT event_id, value, first_value(value) OVER (ORDER BY event_id) AS first FROM events) WINDOW w AS (ORDER BY event_id)")
def stencil_chunked(spark, sf_dir):
    """A window two rows back, with the stream cut into chunks that carry copies of their neighbours' rows."""
    from rowloom.plans.lower import Performance

    c, e = events(spark, sf_dir)
    df = c.frame(c.ops.Neighbours(value=e, stencil=[-2, 0]), "n", Performance(chunk_rows=128))
    return df.select("row_id", F.array_max("n").alias("value"))


@query("SELECT event_id // 4 AS row_id, coalesce(lead(value) OVER (ORDER BY event_id), value) AS next_value FROM events WHERE event_id % 4 = 0")
def stencil_after_stride(spark, sf_dir):
    c, e = events(spark, sf_dir)
    df = c.frame(c.ops.Neighbours(value=c.streams.Stride(e, [4]), stencil=[1]), "n")
    return df.select("row_id", F.col("n")[0].alias("next_value"))


@query("SELECT event_id AS row_id, coalesce(lag(value) OVER (PARTITION BY event_id // 50 ORDER BY event_id), value) AS prev_value FROM events")
def stencil_in_slice(spark, sf_dir):
    c, e = events(spark, sf_dir)
    cut = c.streams.Slice(e, [c.partitioner.all(50)])
    return c.frame(c.streams.Unslice(c.ops.Neighbours(value=cut, stencil=[-1])), "n").select("row_id", F.col("n")[0].alias("prev_value"))


@query("SELECT event_id - 500 AS row_id, value - lag(value, 1) OVER (ORDER BY event_id) AS value FROM events WHERE event_id >= 499 AND event_id < 510 QUALIFY event_id >= 500")
def stencil_pushdown(spark, sf_dir):
    """A range after a stencil: the scan reads the range and one row before it."""
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Range(c.ops.Difference(value=e), [(500, 510)])))


@query("WITH want(r) AS (VALUES (0),(10),(25),(26),(27)), need AS (SELECT DISTINCT e.event_id AS r FROM events e, want w WHERE e.event_id BETWEEN w.r - 3 AND w.r), isl AS (SELECT r, r - row_number() OVER (ORDER BY r) AS g FROM need), cnt AS (SELECT r, row_number() OVER (PARTITION BY g ORDER BY r) - 1 AS v FROM isl) SELECT row_number() OVER (ORDER BY r) - 1 AS row_id, v AS value FROM cnt WHERE r IN (SELECT r FROM want)")
def bounded_state_counter(spark, sf_dir):
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Gather(c.ops.CounterBounded(ignore=e, bounded_state=3), [[0, 10, 25, 26, 27]])))


@query("SELECT event_id AS row_id, event_id % 50 AS value FROM events")
def unbounded_running_count(spark, sf_dir):
    c, e = events(spark, sf_dir)
    cut = c.streams.Slice(e, [c.partitioner.all(50)])
    return plain(c.frame(c.streams.Unslice(c.ops.CounterUnbounded(ignore=cut))))


@query("SELECT event_id AS row_id, CAST(round(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) AS BIGINT) AS cents FROM events")
def bounded_moving_sum(spark, sf_dir):
    """A trailing window of six rows: a stencil whose rows before the first count as nothing."""
    c, e = events(spark, sf_dir)
    df = c.frame(c.ops.Neighbours(value=e, stencil=[-5, -4, -3, -2, -1, 0]), "n")
    inside = F.slice("n", F.greatest(F.lit(1), 6 - F.col("row_id").cast("int")), 6)
    return df.select("row_id", F.aggregate(inside, F.lit(0).cast("long"), lambda s, x: s + F.round(x * 100).cast("long")).alias("cents"))


@query("SELECT event_id AS row_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY event_id) AS BIGINT) AS value FROM events")
def unbounded_running_sum(spark, sf_dir):
    """State that combines, in two passes over chunks of the stream."""
    c, e = events(spark, sf_dir)
    cents = c.frame(e).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return running(cents, "value", "sum", "total", chunk_rows=1 << 12).select("row_id", F.col("total").alias("value"))


@query("SELECT event_id AS row_id, lag(value, 2) OVER (ORDER BY event_id) AS before, lead(value) OVER (ORDER BY event_id) AS after FROM events")
def stencil_repeat_null(spark, sf_dir):
    """A window that sees nulls beyond the ends of its stream."""
    c, e = events(spark, sf_dir)
    df = c.frame(c.ops.Neighbours(value=e, stencil=[-2, 1], boundary="repeat_null"), "n")
    return df.select("row_id", F.col("n")[0].alias("before"), F.col("n")[1].alias("after"))


@query("SELECT doc_id AS row_id, CAST(len(text) AS BIGINT) AS value FROM documents")
def python_kernel(spark, sf_dir):
    """A plain Python function over every element, in Arrow batches."""
    c = Client(spark)
    docs = c.io.Input([FrameStream(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")])
    return plain(c.frame(c.ops.TextLength(text=docs)))


def by_user(spark: SparkSession, sf_dir: str) -> tuple[StreamBatch, DataFrame]:
    """The events of each user as a stream; streams are numbered by user id. Users with a row id are the batch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = e.select("user_id").distinct().withColumn("stream_id", F.row_number().over(Window.orderBy("user_id")) - 1)
    ranked = e.select("user_id", "value", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("row_id"))
    return StreamBatch(ranked.join(users, "user_id"), "stream_id", "row_id", ["value"]), users


@query("SELECT user_id AS stream_id, row_id // (1 + user_id % 3) AS row_id, value FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_id FROM events) WHERE row_id % (1 + user_id % 3) = 0")
def batch_streams_args(spark, sf_dir):
    """A stride of its own for each of many streams."""
    c = Client(spark)
    batch, users = by_user(spark, sf_dir)
    strides = [1 + r["user_id"] % 3 for r in users.orderBy("stream_id").select("user_id").collect()]
    df = c.frame(c.streams.Stride(c.io.Input(batch), strides))
    return df.join(users, "stream_id").select(F.col("user_id").alias("stream_id"), "row_id", "value")


@query("SELECT a.event_id AS row_id, a.value + b.o_totalprice AS value FROM events a JOIN orders b ON a.event_id = b.o_orderkey")
def zip_streams_whole(spark, sf_dir):
    """Two sources joined by position, both cut to the length of the shorter one."""
    c, e = events(spark, sf_dir)
    orders = c.io.Input([FrameStream(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", "o_totalprice")])
    n = min(s.node.spec["counts"]()[0] for s in (e, orders))
    return plain(c.frame(c.ops.Sum(c.streams.Range(e, [(0, n)]), c.streams.Range(orders, [(0, n)]))))


@query("SELECT vec_id AS row_id, b AS bin, count(*) FILTER (WHERE least(15, greatest(0, CAST(floor((x + 1) * 8) AS INT))) = b) AS n FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), (SELECT unnest(range(16)) AS b) GROUP BY vec_id, b")
def frame_histogram(spark, sf_dir):
    c, v = vectors(spark, sf_dir)
    return c.frame(c.ops.VectorHistogram(vector=v)).select("row_id", F.posexplode("value").alias("bin", "n")).select("row_id", F.col("bin").cast("long"), F.col("n").cast("long"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[Client, Any]:
    c = Client(spark)
    return c, c.io.Input([FrameStream(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")])


@query("SELECT vec_id AS row_id, CAST(list_min(embedding) AS DOUBLE) AS low, CAST(list_max(embedding) AS DOUBLE) AS high, list_reduce(CAST(embedding AS DOUBLE[]), lambda a, b: a + b) / len(embedding) AS mean FROM embeddings")
def multi_output(spark, sf_dir):
    c, v = vectors(spark, sf_dir)
    low, high, mean = c.ops.Statistics(vector=v)
    family = c.lower([low.node]).families[low.node.id]
    return family.df.select("row_id", *(F.col(o.column).alias(n) for o, n in ((low, "low"), (high, "high"), (mean, "mean"))))


@query("SELECT doc_id AS row_id, concat_ws('/', lang, source, lang) AS value FROM documents")
def variadic(spark, sf_dir):
    c = Client(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang, source = c.io.columns(StreamBatch(docs.withColumn("s", F.lit(0)), "s", "doc_id", ["lang", "source"], [docs.count()]))
    return plain(c.frame(c.ops.Concat(lang, source, lang, args={"separator": "/"})))


def numbered(df: DataFrame, column: str = "value") -> DataFrame:
    """A row for every number of an array column: row_id, at and value."""
    return df.select("row_id", F.posexplode(column).alias("at", "value")).select("row_id", F.col("at").cast("long"), F.col("value").cast("double"))


@query("SELECT vec_id AS row_id, i AS at, CAST(embedding[1 + i % len(embedding)] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(3 * len(embedding))) AS i FROM embeddings)")
def clone_channels(spark, sf_dir):
    c, v = vectors(spark, sf_dir)
    return numbered(c.frame(c.ops.CloneChannels(vector=v, times=3)))


@query("SELECT conv_id AS stream_id, turn AS row_id, role, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), role) AS next_role FROM conversations")
def conversation_pairs(spark, sf_dir):
    c = Client(spark)
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    df = c.frame(c.ops.Neighbours(value=c.io.Input(StreamBatch(talk, "conv_id", "turn", ["role"])), stencil=[0, 1]), "n")
    return df.select(F.col("stream_id").cast("long"), "row_id", F.col("n")[0].alias("role"), F.col("n")[1].alias("next_role"))


@query("SELECT event_id * 2 + j AS row_id, CASE WHEN j = 0 THEN value + value END AS value FROM events, (SELECT unnest(range(2)) AS j)")
def null_propagation(spark, sf_dir):
    c, e = events(spark, sf_dir)
    spaced = c.streams.RepeatNull(e, [2])
    return plain(c.frame(c.ops.Sum(spaced, spaced)))


@query("SELECT vec_id AS row_id, i AS at, CASE WHEN i BETWEEN 1 AND len(e) - 2 THEN (e[i] + e[i + 1] + e[i + 2]) / 3 ELSE 0 END AS value FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, unnest(range(len(embedding))) AS i FROM embeddings)")
def sliding_mean(spark, sf_dir):
    c, v = vectors(spark, sf_dir)
    return numbered(c.frame(c.ops.SlidingMean(vector=c.ops.Widen(vector=v), width=3)))


@query("SELECT event_id // 10 AS row_id, CAST(CASE WHEN event_id = 0 THEN 0 ELSE 3 END AS BIGINT) AS value FROM events WHERE event_id % 10 = 0")
def bounded_state_stride(spark, sf_dir):
    """Every tenth row of a whole stream: state restarts at each, three rows before it."""
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Stride(c.ops.CounterBounded(ignore=e, bounded_state=3), [10])))


GATHERED = [7 * i + i % 3 for i in range(400)]


@query("WITH want AS (SELECT i, 7 * i + i % 3 AS r FROM range(400) t(i) WHERE 7 * i + i % 3 < (SELECT count(*) FROM events)), need AS (SELECT DISTINCT e.event_id AS r FROM events e, want w WHERE e.event_id BETWEEN w.r - 3 AND w.r), isl AS (SELECT r, r - row_number() OVER (ORDER BY r) AS g FROM need), cnt AS (SELECT r, row_number() OVER (PARTITION BY g ORDER BY r) - 1 AS v FROM isl) SELECT i AS row_id, v AS value FROM want JOIN cnt USING (r)")
def bounded_state_gather(spark, sf_dir):
    """Four hundred gathered rows, each with the rows that warm up its state."""
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Gather(c.ops.CounterBounded(ignore=e, bounded_state=3), [GATHERED])))


@query("SELECT user_id AS stream_id, row_id // s AS row_id, CASE WHEN s <= 3 THEN row_id ELSE least(row_id, 2) END AS value FROM (SELECT user_id, 1 + user_id % 11 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_id FROM events) WHERE row_id % s = 0")
def bounded_state_streams(spark, sf_dir):
    """Many streams, of each of which other rows are wanted."""
    c = Client(spark)
    batch, users = by_user(spark, sf_dir)
    strides = [1 + r["user_id"] % 11 for r in users.orderBy("stream_id").select("user_id").collect()]
    df = c.frame(c.streams.Stride(c.ops.CounterBounded(ignore=c.io.Input(batch), bounded_state=2), strides))
    return df.join(users, "stream_id").select(F.col("user_id").alias("stream_id"), "row_id", "value")


@query("WITH RECURSIVE e AS (SELECT event_id // 40 AS s, event_id % 40 AS p, value FROM events), r AS (SELECT s, p, value FROM e WHERE p = 0 UNION ALL SELECT e.s, e.p, (CAST(1 AS DOUBLE) - CAST(0.05 AS DOUBLE)) * r.value + CAST(0.05 AS DOUBLE) * e.value FROM r JOIN e ON e.s = r.s AND e.p = r.p + 1) SELECT s * 40 + p AS row_id, value FROM r")
def moving_average(spark, sf_dir):
    """Bounded state in slices that are shorter than its warm-up."""
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.streams.Unslice(c.ops.MovingAverage(value=c.streams.Slice(e, [c.partitioner.all(40)])))))


@query("SELECT doc_id AS row_id, CAST(len(text) AS BIGINT) AS value FROM documents")
def batch_kernel(spark, sf_dir):
    """A Python function over batches of elements."""
    c = Client(spark)
    docs = c.io.Input([FrameStream(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")])
    return plain(c.frame(c.ops.TextLengths(text=docs, batch=37)))


@query("SELECT event_id AS row_id, greatest(value, lag(value, 1, value) OVER w, lead(value, 1, value) OVER w) - least(value, lag(value, 1, value) OVER w, lead(value, 1, value) OVER w) AS value FROM events WINDOW w AS (ORDER BY event_id)")
def stencil_batch(spark, sf_dir):
    """A Python function over batches of windows."""
    c, e = events(spark, sf_dir)
    return plain(c.frame(c.ops.WindowSpread(value=e)))


def workspace(spark: SparkSession) -> str:
    """A new folder for a warehouse, where executors see it too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/rowloom-{uuid.uuid4().hex}"


@query("SELECT event_id // 2 AS row_id, value - lag(value, 1, value) OVER (ORDER BY event_id) AS value FROM events QUALIFY event_id % 2 = 0")
def run_round_trip(spark, sf_dir):
    """A job's output, read back from the catalog."""
    _, e = events(spark, sf_dir)
    c = Client(spark, workspace(spark))
    c.run(c.io.Output(c.streams.Stride(c.ops.Difference(value=e), [2]).lossless(), [c.stream("out")]))
    return c.stream("out").read().select("row_id", F.col("column").alias("value"))


@query("SELECT step, outcome, CAST((SELECT count(*) FROM events) AS BIGINT) AS n FROM (VALUES (0, 'run'), (1, 'error'), (2, 'skipped'), (3, 'run')) v(step, outcome)")
def cache_modes(spark, sf_dir):
    """What a second run of a job does with its output."""
    _, e = events(spark, sf_dir)
    c = Client(spark, workspace(spark))
    sink, rows = c.io.Output(e, [c.stream("out")]), []
    for step, mode in enumerate((CacheMode.ERROR, CacheMode.ERROR, CacheMode.IGNORE, CacheMode.OVERWRITE)):
        try:
            outcome = "skipped" if c.run(sink, cache_mode=mode) is None else "run"
        except ValueError:
            outcome = "error"
        rows.append((step, outcome, c.stream("out").length()))
    return spark.createDataFrame(rows, "step int, outcome string, n long")


@query("SELECT event_type AS name, count(*) AS n, max(value) <= 350 AS committed FROM events GROUP BY event_type")
def failed_streams(spark, sf_dir):
    """Streams with an element that their kernel fails on are left uncommitted; the others aren't."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = sorted(r["event_type"] for r in e.select("event_type").distinct().collect())
    c = Client(spark, workspace(spark))
    numbered_rows = e.select("event_type", "value", (F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1).alias("row_id"))
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")) - 1
    x = c.io.Input(StreamBatch(numbered_rows.withColumn("stream", place), "stream", "row_id", ["value"]))
    c.run(c.io.Output(c.ops.AtMost(value=x, limit=350.0), [c.stream(k) for k in kinds]))
    return c.catalog.summarize().select("name", F.col("rows").alias("n"), "committed")


@query("SELECT CAST(n_nationkey AS BIGINT) AS row_id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def new_table(spark, sf_dir):
    """A table out of literal values, with two columns of bytes."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    c = Client(spark, workspace(spark))
    c.catalog.new_table("nation", ["name", "region"], [[r["n_name"], str(r["n_regionkey"])] for r in rows], [str.encode, str.encode])
    return c.table("nation").frame().select("row_id", F.col("name").cast("string"), F.col("region").cast("string"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS row_id, r_name AS value FROM region")
def packed_file(spark, sf_dir):
    """The elements of one packed file."""
    names = [r["r_name"].encode() for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()]
    c = Client(spark, workspace(spark))
    path = f"{c.catalog.warehouse}/regions.bin"
    c.catalog.write_file(path, pack_rows(names))
    return c.frame(c.io.Input([PackedFileStream(spark, path)])).select("row_id", F.col("value").cast("string"))


def line_boxes(spark: SparkSession, sf_dir: str) -> tuple[Client, Any]:
    """For each order the boxes of its lines: those of equal l_partkey % 3 lie on each other, others apart."""
    x = (F.col("l_partkey") % 3 * 100).cast("float")
    number = lambda n: F.lit(n).cast("float")
    box = F.struct(x.alias("x1"), number(0).alias("y1"), (x + 50).cast("float").alias("x2"), number(50).alias("y2"), F.col("l_quantity").cast("float").alias("score"), F.lit(None).cast("int").alias("track_id"), F.lit(None).cast("double").alias("track_score"), F.lit(None).cast("int").alias("label"))
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))
    c = Client(spark)
    return c, c.io.Input([FrameStream(orders, "l_orderkey", "boxes")])


def box_rows(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.explode("value").alias("b")).select("row_id", F.round(F.col("b.x1") / 100).cast("long").alias("slot"), F.round(F.col("b.x2")).cast("long").alias("right"), F.col("b.score").cast("double").alias("score"))


BOX_SQL = "SELECT l_orderkey AS row_id, CAST(l_partkey % 3 AS BIGINT) AS slot, CAST(l_partkey % 3 * 100 + 50 AS BIGINT) AS right, CAST(max(l_quantity) AS DOUBLE) AS score FROM lineitem GROUP BY ALL"


@query(BOX_SQL)
def best_boxes(spark, sf_dir):
    c, found = line_boxes(spark, sf_dir)
    return box_rows(c.frame(c.ops.BestBoxes(found=found, overlap=0.3)))


@query(BOX_SQL)
def average_boxes(spark, sf_dir):
    c, found = line_boxes(spark, sf_dir)
    return box_rows(c.frame(c.ops.AverageBoxes(found=found, overlap=0.3)))


@query("SELECT event_id AS row_id, CASE WHEN event_id % 15 < 10 THEN CAST((10 - event_id % 15) * 10 AS DOUBLE) / (200 - (10 - event_id % 15) * 10) ELSE 0 END AS value FROM events")
def box_overlap(spark, sf_dir):
    """Intersection over union of two columns of boxes."""
    c = Client(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    box = lambda x: F.struct(x.cast("float").alias("x1"), F.lit(0.0).cast("float").alias("y1"), (x + 10).cast("float").alias("x2"), F.lit(10.0).cast("float").alias("y2"))
    df = e.select(F.lit(0).alias("s"), "event_id", box(F.lit(0)).alias("a"), box(F.col("event_id") % 15).alias("b"))
    a, b = c.io.columns(StreamBatch(df, "s", "event_id", ["a", "b"], [e.count()]))
    return plain(c.frame(c.ops.Overlap(first=a, second=b)))


@query("SELECT event_id AS row_id, CAST(32 AS INT) AS width, CAST(floor(32 / (CAST(10 + event_id % 50 AS DOUBLE) / (5 + event_id % 7))) AS INT) AS height FROM events")
def resized_sizes(spark, sf_dir):
    """The size that a resize to a width gives, by aspect."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = resized(10 + F.col("event_id") % 50, 5 + F.col("event_id") % 7, F.lit(32), F.lit(0))
    return e.select(F.col("event_id").alias("row_id"), size.alias("s")).select("row_id", "s.width", "s.height")


#: Frames of 8 x 8 numbers out of the vectors, as the queries below make them.
LEVELS = "levels AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor((CAST(x AS DOUBLE) + 1) * 127.5))) AS BIGINT)) AS l FROM embeddings)"


def frames(spark: SparkSession, sf_dir: str, channels: int = 1) -> tuple[Client, Any]:
    c, v = vectors(spark, sf_dir)
    return c, c.ops.ToFrame(vector=v, width=8, channels=channels)


@query(f"WITH {LEVELS} SELECT vec_id AS row_id, i AS at, CAST(CASE WHEN i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6 THEN (l[i - 8] + l[i - 7] + l[i - 6] + l[i] + l[i + 1] + l[i + 2] + l[i + 8] + l[i + 9] + l[i + 10]) // 9 ELSE 0 END AS DOUBLE) AS value FROM (SELECT vec_id, l, unnest(range(64)) AS i FROM levels)")
def blurred_frames(spark, sf_dir):
    c, f = frames(spark, sf_dir)
    return numbered(c.frame(c.ops.ToNumbers(frame=c.ops.Blur(frame=f, kernel_size=3))))


@query(f"WITH {LEVELS} SELECT vec_id AS row_id, i AS at, CAST(l[i + 1] AS DOUBLE) AS value FROM (SELECT vec_id, l, unnest(range(64)) AS i FROM levels)")
def encoded_frames(spark, sf_dir):
    """Frames through PNG files and back."""
    c, f = frames(spark, sf_dir)
    return numbered(c.frame(c.ops.ToNumbers(frame=c.ops.ImageDecoder(image=c.ops.ImageEncoder(frame=f)))))


@query(f"WITH {LEVELS} SELECT vec_id AS row_id, c AS channel, b AS bin, CAST(len(list_filter(l, lambda x: x // 16 = b)) AS BIGINT) AS n FROM levels, range(3) r(c), range(16) s(b)")
def color_histogram(spark, sf_dir):
    """Counts in 16 bins of each of three channels of a frame."""
    c, f = frames(spark, sf_dir, 3)
    df = c.frame(c.ops.Histogram(frame=f)).select("row_id", F.posexplode("value").alias("channel", "h"))
    return df.select("row_id", F.col("channel").cast("long"), F.posexplode("h").alias("bin", "n")).select("row_id", "channel", F.col("bin").cast("long"), F.col("n").cast("long"))


@query(f"WITH {LEVELS}, pairs AS (SELECT vec_id, l, coalesce(lead(l) OVER (ORDER BY vec_id), l) AS m FROM levels) SELECT vec_id AS row_id, i AS at, CAST(m[i + 1] - l[i + 1] AS DOUBLE) AS value FROM (SELECT vec_id, l, m, unnest(range(64)) AS i FROM pairs)")
def frame_differences(spark, sf_dir):
    """Every frame's change to the next one, a stencil over frames."""
    c, f = frames(spark, sf_dir)
    return numbered(c.frame(c.ops.ToNumbers(frame=c.ops.FrameDifference(frame=f))))


@query(f"WITH {LEVELS} SELECT vec_id AS row_id, i AS at, round_even(CAST(l[k] + l[k + 1] + l[k + 8] + l[k + 9] AS DOUBLE) / 4, 0) AS value FROM (SELECT vec_id, l, i, (i // 4) * 16 + (i % 4) * 2 + 1 AS k FROM (SELECT vec_id, l, unnest(range(16)) AS i FROM levels))")
def resized_frames(spark, sf_dir):
    """Frames at half their size, by arguments of the stream."""
    c, f = frames(spark, sf_dir)
    return numbered(c.frame(c.ops.ToNumbers(frame=c.ops.Resize(frame=f, width=[4], height=[4]))))


WINDOW_ROWS, SIGMAS = 50, 2


@query("""
WITH bins AS (SELECT vec_id, least(15, greatest(0, CAST(floor((x + 1) * 8) AS INT))) AS b
              FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)),
grid AS (SELECT v.vec_id, g.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT vec_id FROM bins) v
         CROSS JOIN (SELECT unnest(range(16)) AS b) g
         LEFT JOIN (SELECT vec_id, b, count(*) AS n FROM bins GROUP BY ALL) c ON c.vec_id = v.vec_id AND c.b = g.b),
lagged AS (SELECT vec_id, abs(n - lag(n) OVER (PARTITION BY b ORDER BY vec_id)) AS dlt FROM grid),
diffs AS (SELECT vec_id, CAST(max(dlt) AS BIGINT) AS diff FROM lagged WHERE dlt IS NOT NULL GROUP BY vec_id),
st AS (SELECT vec_id, diff, count(*) OVER w AS n, sum(diff) OVER w AS s, sum(diff * diff) OVER w AS q FROM diffs
       WINDOW w AS (ORDER BY vec_id ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING))
SELECT vec_id AS row_id, diff, (n * diff - s > 0) AND ((n * diff - s) * (n * diff - s) > 4 * (n * q - s * s)) AS boundary FROM st
""")
def shot_boundaries(spark, sf_dir):
    """Rows whose histogram changes by more than the mean and two deviations of the changes around them.

    The window is a stencil on whole numbers: n * diff - sum > 2 * sqrt(n * squares - sum ** 2), compared as squares.
    """
    c, v = vectors(spark, sf_dir)
    change = c.ops.HistogramDistance(histogram=c.ops.VectorHistogram(vector=v))
    df = c.frame(change, "diff").where("row_id > 0").select("stream_id", "row_id", F.col("diff").cast("long").alias("diff"))
    return outliers(df, WINDOW_ROWS, SIGMAS)


def outliers(df: DataFrame, around: int, sigmas: int, chunk_rows: int = 1 << 20) -> DataFrame:
    """(row_id, diff, boundary) of a stream's changes, by chunks with ``around`` rows of their neighbours."""
    first = ((F.greatest(F.col("row_id") - around, F.lit(0))) / chunk_rows).cast("long")
    spread = df.withColumn("chunk", F.explode(F.sequence(first, ((F.col("row_id") + around) / chunk_rows).cast("long"))))
    w = Window.partitionBy("stream_id", "chunk").orderBy("row_id").rowsBetween(-around, around)
    n, s, q, d = F.count("*").over(w), F.sum("diff").over(w), F.sum(F.col("diff") * F.col("diff")).over(w), F.col("diff")
    found = spread.withColumns({"n": n, "s": s, "q": q}).where(F.col("chunk") == (F.col("row_id") / chunk_rows).cast("long"))
    over = F.col("n") * d - F.col("s")
    return found.select("row_id", "diff", ((over > 0) & (over * over > sigmas**2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")))).alias("boundary"))
