"""Graphs end to end: kernels in every mode, validation, storage, cache modes and failures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pytest

from rowloom.client import CacheMode, Client
from rowloom.functions.boxes import average_nms, best_nms, iou, smooth
from rowloom.functions.images import blur, decode_png, encode_png, resize
from rowloom.operators.kernels import register_op
from rowloom.operators.prefix import running
from rowloom.plans.domain import SliceArgs
from rowloom.plans.graph import GraphError
from rowloom.plans.lower import Performance
from rowloom.sources.catalog import ExternalSink, FrameStream, StreamBatch
from rowloom.sources.files import ElementSource, FilesStream, PackedFileStream, SourceStream, ingest_images
from rowloom.types import FRAME, NullElement, encode_frame, find_type, pack_rows, uniform_list, unpack_rows


@register_op(name="Doubled", replace=True)
def doubled(config, x: int) -> int:
    return 2 * x


@register_op(name="BatchTotal", batch=4, replace=True)
def batch_total(config, x: Sequence[int]) -> Sequence[int]:
    assert len(x) <= 4
    return [v + len(x) for v in x]


@register_op(name="Window", stencil=[-1, 0, 1], replace=True)
def window(config, x: Sequence[int]) -> int:
    return sum(x)


@register_op(name="WindowBatch", stencil=[0, 1], batch=3, replace=True)
def window_batch(config, x: Sequence[Sequence[int]]) -> Sequence[int]:
    return [sum(w) for w in x]


@register_op(name="AllOf", replace=True)
def all_of(config, *x: int) -> int:
    return sum(x)


@register_op(name="Poison", replace=True)
def poison(config, x: int) -> int:
    if x == config.args["bad"]:
        raise RuntimeError("bad value")
    return x


@register_op(name="Two", replace=True)
def two(config, x: int) -> tuple[int, float]:
    return x, x / 2


@register_op(name="Scaled", replace=True)
class Scaled:
    def __init__(self, config, base: int = 0):
        self.base = base

    def new_stream(self, factor: int) -> None:
        self.factor = factor

    def execute(self, x: int) -> int:
        return self.base + self.factor * x


@register_op(name="Recent", bounded_state=2, replace=True)
class Recent:
    """The sum of the last three numbers: a kernel that keeps to its bound."""

    def __init__(self, config):
        self.last = []

    def reset(self):
        self.last = []

    def execute(self, x: int) -> int:
        self.last = [*self.last, x][-3:]
        return sum(self.last)


@pytest.fixture()
def client(spark, tmp_path):
    return Client(spark, str(tmp_path / "warehouse"))


def numbers(spark, n):
    return FrameStream(spark.range(n), "id", "id", n)


def values(df):
    return [r["value"] for r in df.orderBy("row_id").collect()]


def test_plain_batch_stencil_variadic_and_outputs(spark, client):
    x = client.io.Input([numbers(spark, 10)])
    assert values(client.frame(client.ops.Doubled(x=x))) == [2 * i for i in range(10)]
    total = values(client.frame(client.ops.BatchTotal(x=x)))
    assert len(total) == 10 and all(i < v <= i + 4 for i, v in enumerate(total))
    assert values(client.frame(client.ops.Window(x=x))) == [sum(max(0, min(9, i + o)) for o in (-1, 0, 1)) for i in range(10)]
    assert values(client.frame(client.ops.WindowBatch(x=x))) == [i + min(9, i + 1) for i in range(10)]
    assert values(client.frame(client.ops.AllOf(x, x, x))) == [3 * i for i in range(10)]
    a, b = client.ops.Two(x=x)
    assert values(client.frame(client.ops.Sum(a, b))) == [1.5 * i for i in range(10)]


@pytest.mark.parametrize("offsets", [[-1, 0], [0, 1], [-5], [7]])
def test_stencil_on_a_short_range_is_clamped(spark, client, offsets):
    x = client.streams.Range(client.io.Input([numbers(spark, 100)]), [(0, 1)])
    assert values(client.frame(client.ops.Window(x=x, stencil=offsets))) == [0]


def test_a_range_after_a_stencil_sees_its_neighbours(spark, client):
    x = client.io.Input([numbers(spark, 100)])
    assert values(client.frame(client.streams.Range(client.ops.Window(x=x, stencil=[-5]), [(50, 52)]))) == [45, 46]


def test_bounded_state_over_gathered_rows(spark, client):
    x = client.io.Input([numbers(spark, 720)])
    assert values(client.frame(client.streams.Gather(client.ops.CounterBounded(ignore=x, bounded_state=3), [[0, 10, 25, 26, 27]]))) == [0, 3, 3, 4, 5]


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_bounded_state_is_the_same_in_chunks(spark, client, chunk):
    x = client.io.Input([numbers(spark, 50)])
    df = client.frame(client.ops.Recent(x=x), performance=Performance(chunk_rows=chunk))
    assert values(df) == [i + max(0, i - 1) + max(0, i - 2) for i in range(50)]


def test_unbounded_state_in_slices(spark, client):
    x = client.streams.Slice(client.io.Input([numbers(spark, 120)]), [client.partitioner.all(50)])
    assert values(client.frame(client.streams.Unslice(client.ops.CounterUnbounded(ignore=x)))) == [i % 50 for i in range(120)]


def test_arguments_by_stream_and_slice(spark, client):
    x = client.io.Input([numbers(spark, 4), numbers(spark, 4)])
    df = client.frame(client.ops.Scaled(x=x, factor=[1, 10], base=5))
    assert [(r["stream_id"], r["value"]) for r in df.orderBy("stream_id", "row_id").collect()] == [(s, 5 + f * i) for s, f in ((0, 1), (1, 10)) for i in range(4)]
    cut = client.streams.Slice(client.io.Input([numbers(spark, 6)]), [client.partitioner.all(2)])
    assert values(client.frame(client.streams.Unslice(client.ops.Scaled(x=cut, factor=[SliceArgs([1, 10, 100])])))) == [0, 1, 20, 30, 400, 500]
    picked = client.streams.Stride(cut, [SliceArgs([1, 2, 1])])
    assert values(client.frame(client.streams.Unslice(picked))) == [0, 1, 2, 4, 5]


def test_streams_of_length_zero_and_one(spark, client):
    x = client.io.Input([numbers(spark, 0), numbers(spark, 1), numbers(spark, 37)])
    df = client.frame(client.ops.Window(x=client.streams.Stride(x, [5])))
    got = {s: [r["value"] for r in df.where(f"stream_id = {s}").orderBy("row_id").collect()] for s in range(3)}
    kept = list(range(0, 37, 5))
    assert got == {0: [], 1: [0], 2: [sum(kept[max(0, min(7, i + o))] for o in (-1, 0, 1)) for i in range(8)]}


def test_nulls_pass_kernels_by(spark, client):
    x = client.streams.RepeatNull(client.io.Input([numbers(spark, 3)]), [2])
    assert values(client.frame(client.ops.Doubled(x=x))) == [0, None, 2, None, 4, None]
    assert values(client.frame(client.ops.CounterUnbounded(ignore=x))) == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("build, message", [
    (lambda c, x, y: c.ops.AllOf(x, y), "different numbers of rows"),
    (lambda c, x, y: c.streams.Slice(c.streams.Slice(x, [c.partitioner.all(5)]), [c.partitioner.all(5)]), "nested"),
    (lambda c, x, y: c.streams.Unslice(x), "sliced input"),
    (lambda c, x, y: c.ops.Doubled(x=c.streams.Unslice(c.streams.Slice(x, [c.partitioner.all(5)]))), "sink"),
    (lambda c, x, y: c.ops.Doubled(x=x, stencil=[0]), "no stencil"),
    (lambda c, x, y: c.ops.Doubled(x=x, batch=2), "no batches"),
    (lambda c, x, y: c.streams.Stride(x, [1, 2]), "2 arguments for 1"),
    (lambda c, x, y: c.streams.Stride(x, [SliceArgs([1])]), "sliced input"),
    (lambda c, x, y: c.streams.Slice(x, [c.partitioner.range(0, 99)]), "exceeds"),
])
def test_graphs_that_make_no_sense(spark, client, build, message):
    x, y = client.io.Input([numbers(spark, 30)]), client.io.Input([numbers(spark, 15)])
    with pytest.raises(GraphError, match=message):
        client.lower([build(client, x, y).node])


def test_arguments_that_make_no_sense(spark, client):
    x = client.io.Input([numbers(spark, 3)])
    with pytest.raises(GraphError):
        client.streams.Stride(x, [0])
    with pytest.raises(GraphError):
        client.ops.Nothing(x=x)
    with pytest.raises(GraphError):
        client.ops.Doubled(y=x)
    with pytest.raises(GraphError):
        client.ops.Scaled(x=x)
    with pytest.raises(GraphError):
        client.io.Input([])
    with pytest.raises(GraphError):
        x.compress("mp3")


@pytest.mark.parametrize("make, error", [
    (lambda: register_op(name="Doubled")(lambda config, x: x), ValueError),
    (lambda: register_op(name="n1", bounded_state=1, unbounded_state=True)(doubled), ValueError),
    (lambda: register_op(name="n2")(lambda config, x: x), TypeError),
    (lambda: register_op(name="n3")(type("K", (), {})), TypeError),
    (lambda: register_op(name="n4", batch=2)(doubled), TypeError),
])
def test_bad_registrations(make, error):
    with pytest.raises(error):
        make()


def test_run_load_and_cache_modes(spark, client):
    x = client.io.Input([numbers(spark, 10), numbers(spark, 5)])
    outs = [client.stream("a"), client.stream("b")]
    sink = client.io.Output(client.ops.Doubled(x=x).lossless(), outs)
    job = client.run(sink)
    assert client.job_status(job)["status"] == "done" and client.get_profile(job).statistics()
    assert list(outs[0].load()) == [2 * i for i in range(10)]
    assert list(outs[1].load(rows=[1, 3])) == [2, 6] and outs[1].length() == 5
    assert list(outs[1].load(decode=str)) == ["0", "2", "4", "6", "8"]
    with pytest.raises(ValueError):
        client.run(sink)
    assert client.run(sink, cache_mode=CacheMode.IGNORE) is None
    again = client.io.Output(client.ops.Poison(x=x, bad=-1), outs)
    assert client.run(again, cache_mode=CacheMode.OVERWRITE)
    assert list(outs[0].load()) == list(range(10))
    with pytest.raises(ValueError):
        list(outs[0].load(rows=[3, 1]))


def test_a_failing_stream_is_not_committed(spark, client):
    x = client.io.Input([numbers(spark, 3), numbers(spark, 9), numbers(spark, 3)])
    outs = [client.stream(f"p{i}") for i in range(3)]
    job = client.run(client.io.Output(client.ops.Poison(x=x, bad=7), outs))
    assert [s.committed() for s in outs] == [True, False, True]
    assert "bad value" in client.job_status(job)["failed"]["p1"]
    job = client.run(client.io.Output(client.ops.Doubled(x=x), outs), cache_mode=CacheMode.IGNORE)
    assert [s.committed() for s in outs] == [True] * 3 and list(outs[1].load()) == [2 * i for i in range(9)]
    assert list(outs[0].load()) == [0, 1, 2]


def test_sinks_must_agree_and_share_their_graph(spark, client):
    x = client.io.Input([numbers(spark, 30)])
    y = client.ops.Doubled(x=x)
    ok = [client.io.Output(x, [client.stream("s1")]), client.io.Output(y, [client.stream("s2")])]
    client.wait_on_job(client.run(ok, detach=True))
    assert list(client.stream("s2").load())[:3] == [0, 2, 4] and not client.get_active_jobs()
    with pytest.raises(GraphError):
        client.run([client.io.Output(x, [client.stream("s3")]), client.io.Output(client.streams.Range(x, [(0, 15)]), [client.stream("s4")])])


def test_catalog(spark, client):
    t = client.catalog.new_table("test", ["col1", "col2"], [[b"r00", b"r01"], [None, b""]])
    assert t.length() == 2 and list(client.stream("test", "col2").load()) == [b"r01", b""]
    assert list(client.stream("test", "col1").load()) == [b"r00", NullElement()]
    with pytest.raises(ValueError):
        client.catalog.new_table("test", ["c"], [])
    assert client.catalog.new_table("test", ["c"], [], force=True).length() == 0
    assert client.catalog.has("test") and client.catalog.summarize().count() == 1
    client.catalog.delete(["test", "unknown"])
    assert not client.catalog.has("test")
    with pytest.raises(ValueError):
        client.catalog.ingest("gaps", spark.range(1, 5), "id", ["id"])
    assert client.catalog.ingest("dense", spark.range(5).selectExpr("id", "id * 2 AS column"), "id").length() == 5


def test_rows_are_pushed_to_the_scan(spark, client, tmp_path):
    spark.range(1000).selectExpr("id", "id * 2 AS v", "id AS other").write.parquet(str(tmp_path / "t"))
    x = client.io.Input([FrameStream(spark.read.parquet(str(tmp_path / "t")), "id", "v")])
    df = client.frame(client.streams.Range(client.ops.Neighbours(value=client.streams.Stride(x, [2])), [(10, 20)]), performance=Performance(chunk_rows=64))
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(id,18)" in plan and "LessThan(id,41)" in plan
    assert "ReadSchema: struct<id:bigint,v:bigint>" in plan and "SinglePartition" not in plan


def test_a_batch_of_streams_is_one_scan(spark, client):
    df = spark.range(60).selectExpr("CAST(id % 3 AS INT) AS s", "id DIV 3 AS r", "id AS v")
    x = client.io.Input(StreamBatch(df, "s", "r", ["v"]))
    got = client.frame(client.streams.Ranges(x, [[(0, 2)], [(1, 3), (5, 6)], []]))
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == [(0, 0, 0), (0, 1, 3), (1, 0, 4), (1, 1, 7), (1, 2, 16)]


def test_files_packed_files_and_sources(spark, client, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}").write_bytes(b"%d" % i)
    paths = [str(tmp_path / f"f{i}") for i in (2, 0, 1)]
    assert list(FilesStream(spark, paths).load()) == [b"2", b"0", b"1"]
    packed = pack_rows([b"a", b"", b"ccc"])
    assert unpack_rows(packed) == [b"a", b"", b"ccc"]
    (tmp_path / "packed").write_bytes(packed)
    assert list(PackedFileStream(spark, str(tmp_path / "packed")).load()) == [b"a", b"", b"ccc"]

    class Squares(ElementSource):
        def total(self):
            return 5

        def element(self, index):
            return b"%d" % index**2

    spark.dataSource.register(Squares)
    s = SourceStream(spark, "squares", "row_id", "column", rowsPerPartition=2)
    assert list(s.load()) == [b"0", b"1", b"4", b"9", b"16"]


def frames(n=4, seed=3):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 256, (4, 6, 3), np.uint8) for _ in range(n)]


def test_frames_and_images(spark, client, tmp_path):
    made = frames()
    df = spark.createDataFrame([(i, encode_frame(f)) for i, f in enumerate(made)], __import__("pyspark").sql.types.StructType().add("id", "long").add("frame", FRAME))
    x = client.io.Input([FrameStream(df, "id", "frame", 4)])
    hist = values(client.frame(client.ops.Histogram(frame=x)))
    assert hist[0] == [np.bincount(made[0][:, :, c].ravel() // 16, minlength=16).tolist() for c in range(3)]
    small = client.ops.Resize(frame=x, width=[3], height=[0])
    assert values(client.frame(small))[0]["shape"] == [2, 3, 3]
    out = [client.stream("png")]
    client.run(client.io.Output(client.ops.ImageEncoder(frame=x), out))
    pngs = list(out[0].load())
    assert all((decode_png(p) == f).all() for p, f in zip(pngs, made))
    for i, p in enumerate([*pngs, b"no image"]):
        (tmp_path / f"{i}.png").write_bytes(p)
    stream, failed = ingest_images(client.catalog, "frames", FilesStream(spark, [str(tmp_path / f"{i}.png") for i in range(5)]))
    assert [r["row_id"] for r in failed.collect()] == [4] and (next(iter(stream.load())) == made[0]).all()
    with pytest.raises(ValueError):
        ingest_images(client.catalog, "none", FilesStream(spark, [str(tmp_path / "4.png")]))


def test_image_functions():
    f = frames(1)[0]
    assert (resize(f, 6, 4) == f).all() and resize(f, 3, 2).shape == (2, 3, 3)
    assert blur(f, 3)[1, 1, 0] == int(f[:3, :3, 0].mean()) and not blur(f, 3)[0].any()
    assert (decode_png(encode_png(f.astype(np.uint16) * 257)) == f.astype(np.uint16) * 257).all()
    with pytest.raises(ValueError):
        encode_png(f.astype(float))


def test_boxes():
    boxes = [[0, 0, 10, 10, 0.9], [1, 1, 10, 10, 0.8], [50, 50, 60, 60, 0.7]]
    assert best_nms(boxes, 0.5)[:, 4].tolist() == [0.9, 0.7]
    assert np.allclose(average_nms(boxes, 0.5)[0], [0.8 / 1.7, 0.8 / 1.7, 10, 10, 0.9])
    assert iou([0, 0, 2, 2], [1, 1, 3, 3]) == pytest.approx(1 / 7) and iou([0, 0, 1, 1], [2, 2, 3, 3]) == 0
    assert len(best_nms([], 0.5)) == 0


def test_types():
    assert find_type(int).name == "long" and find_type("any").decode(find_type("any").encode(None)) is None
    with pytest.raises(ValueError):
        uniform_list("u", "ints")
    assert find_type("histogram").encode([[1], [2], [3]]) == [[1], [2], [3]]
    with pytest.raises(ValueError):
        find_type("histogram").encode([[1]])


def test_boundaries(spark, client):
    x = client.io.Input([numbers(spark, 4)])
    assert values(client.frame(client.ops.Neighbours(value=x, stencil=[-1, 2], boundary="repeat_null"))) == [[None, 2], [0, 3], [1, None], [2, None]]
    inside = client.streams.Range(client.ops.Neighbours(value=x, stencil=[-1], boundary="error"), [(1, 4)])
    assert values(client.frame(inside)) == [[0], [1], [2]]
    with pytest.raises(Exception, match="beyond its stream"):
        client.frame(client.ops.Neighbours(value=x, stencil=[-1], boundary="error")).collect()
    with pytest.raises(GraphError):
        client.ops.Neighbours(value=x, boundary="wrap")


@pytest.mark.parametrize("kind", ["sum", "count", "min", "max"])
def test_running_aggregates(spark, kind):
    rows = [(s, r, None if r % 5 == 0 else (r * 7919) % 101) for s in range(2) for r in range(40)]
    df = spark.createDataFrame(rows, "stream_id int, row_id long, v long")
    got = {(r[0], r[1]): r["running"] for r in running(df, "v", kind, chunk_rows=6).collect()}
    f = {"sum": sum, "count": len, "min": min, "max": max}[kind]
    for s, r, _ in rows:
        seen = [v for t, q, v in rows if t == s and q <= r and v is not None]
        assert got[s, r] == (f(seen) if seen or kind == "count" else None)


def test_external_sinks(spark, client, tmp_path):
    x = client.io.Input([numbers(spark, 3), numbers(spark, 2)])
    sinks = [ExternalSink(f"e{i}", "json", str(tmp_path / f"e{i}")) for i in range(2)]
    assert client.job_status(client.run(client.io.Output(client.ops.Doubled(x=x), sinks))) == {"status": "done", "streams": 2, "failed": {}}
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "e0")).select("row_id", "column").collect()) == [(0, 0), (1, 2), (2, 4)]


def test_smoothed_boxes():
    assert smooth([[0, 0, 10, 10, 0.9]], [[0, 0, 10, 12, 0.5]], [[50, 50, 60, 60, 0.5]]).tolist() == [[0, 0, 10, 11, 0.9]]


def test_sampling_inside_slices_of_different_lengths(spark, client):
    """Whatever the lengths, a slice is sampled as a stream of its own."""
    from rowloom.plans import domain as D

    lengths = [(23, 10), (7, 10)]
    streams = [numbers(spark, n) for n, _ in lengths]
    make = client.streams
    for build, samplers in (
        (lambda c: make.Ranges(c, [[(0, 3), (2, 9), (1, 2)]]), [D.Ranges(((0, 3), (2, 9), (1, 2)))] * 2),
        (lambda c: make.Ranges(c, [[(0, 3), (2, 9)], [(1, 6)]]), [D.Ranges(((0, 3), (2, 9))), D.Ranges(((1, 6),))]),
        (lambda c: make.Range(c, [(1, 5), (2, 4)]), [D.Ranges(((1, 5),)), D.Ranges(((2, 4),))]),
        (lambda c: make.Gather(c, [[0, 8, 1]]), [D.Gather((0, 8, 1))] * 2),
        (lambda c: make.Gather(c, [[2, 1], [0]]), [D.Gather((2, 1)), D.Gather((0,))]),
        (lambda c: make.Stride(c, [3, 2]), [D.Stride(3), D.Stride(2)]),
        (lambda c: make.Repeat(c, [2, 3]), [D.Repeat(2), D.Repeat(3)]),
    ):
        cut = make.Slice(client.io.Input(streams), [client.partitioner.all(10)])
        got = sorted(tuple(r) for r in client.frame(make.Unslice(build(cut))).collect())
        want = []
        for i, ((n, size), sampler) in enumerate(zip(lengths, samplers)):
            groups = D.GroupsOf(size).groups(n)
            want += [(i, k, r) for k, r in enumerate(g[x] for g in groups for x in sampler.rows(len(g)))]
        assert got == want
