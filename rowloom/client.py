"""The client: builds graphs over stored streams, runs them as jobs, and keeps the catalog of results."""

from __future__ import annotations

import importlib.util
import json
import sys
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from enum import Enum
from functools import reduce
from pathlib import Path
from types import ModuleType
from typing import Any

from pyspark import StorageLevel
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import library  # noqa: F401  registers the operations
from rowloom.plans import domain as D
from rowloom.plans.graph import GraphError, Node, Output, make_op, order
from rowloom.plans.lower import Lowering, Performance
from rowloom.session import importable
from rowloom.sources.catalog import Catalog, Entry, ExternalSink, NamedStream, StoredStream, StreamBatch, Table, read_together


class CacheMode(Enum):
    """What a run does with outputs that are there already."""

    ERROR = "error"
    IGNORE = "ignore"
    OVERWRITE = "overwrite"


@dataclass
class Profile:
    """Named wall-clock intervals of a job, in seconds since the epoch: of the driver, and of the tasks by executor."""

    intervals: list[tuple[str, float, float]] = field(default_factory=list)
    tasks: list[tuple[str, str, float, float]] = field(default_factory=list)

    @contextmanager
    def span(self, name: str) -> Iterator[None]:
        start = time.time()
        try:
            yield
        finally:
            self.intervals.append((name, start, time.time()))

    def collect_tasks(self, spark: SparkSession, group: str, most: int = 10_000) -> None:
        """Add the tasks of a job group (at most so many a stage), as Spark's status store holds them: (executor, stage,
        start, end)."""
        context = spark.sparkContext
        store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
        for job in tracker.getJobIdsForGroup(group):
            for stage in tracker.getJobInfo(job).stageIds if tracker.getJobInfo(job) else ():
                found = store.taskList(stage, 0, most)
                for i in range(found.size()):
                    task = found.apply(i)
                    if task.duration().isDefined():
                        start = task.launchTime().getTime() / 1000
                        self.tasks.append((task.executorId(), f"stage {stage}", start, start + task.duration().get() / 1000))

    def total_time_interval(self) -> tuple[float, float]:
        return (min(i[1] for i in self.intervals), max(i[2] for i in self.intervals)) if self.intervals else (0.0, 0.0)

    def statistics(self) -> dict[str, float]:
        """Seconds by name; those of tasks as "executor: stage"."""
        out: dict[str, float] = {}
        for name, a, b in [*self.intervals, *((f"{e}: {n}", a, b) for e, n, a, b in self.tasks)]:
            out[name] = out.get(name, 0.0) + b - a
        return out

    def write_trace(self, path: str) -> None:
        """A trace that browsers' trace viewers open, with a process for each executor."""
        events = [{"name": n, "ph": "X", "ts": a * 1e6, "dur": (b - a) * 1e6, "pid": "driver", "tid": 0} for n, a, b in self.intervals]
        events += [{"name": n, "ph": "X", "ts": a * 1e6, "dur": (b - a) * 1e6, "pid": f"executor {e}", "tid": n} for e, n, a, b in self.tasks]
        with open(path, "w") as f:
            json.dump({"traceEvents": events}, f)


@dataclass
class Job:
    """A run: its state and the streams that failed, with their first errors."""

    id: str
    status: str = "running"
    failed: dict[str, str] = field(default_factory=dict)
    streams: int = 0
    error: BaseException | None = None
    profile: Profile = field(default_factory=Profile)
    thread: threading.Thread | None = None


class Inputs:
    """Sources and sinks."""

    def Input(self, streams: Any) -> Output:
        """A source over stored streams of one kind, or over a StreamBatch (then the first of its columns)."""
        if isinstance(streams, StreamBatch):
            return self.columns(streams)[0]
        if not isinstance(streams, list) or not streams or not all(isinstance(s, StoredStream) for s in streams):
            raise GraphError("Input takes a list of stored streams")
        if len({type(s) for s in streams}) > 1:
            raise GraphError("the streams of an Input must be of one kind")

        def read(spark: SparkSession) -> DataFrame:
            if isinstance(streams[0], NamedStream) and (whole := read_together(streams)) is not None:
                return whole
            parts = [s.read().select(F.lit(i).alias("stream_id"), "row_id", "column") for i, s in enumerate(streams)]
            return reduce(DataFrame.unionByName, parts)

        def counts() -> list[int]:
            with ThreadPoolExecutor(min(16, len(streams))) as pool:
                return list(pool.map(lambda s: s.length(), streams))

        return Node("source", outputs=("column",), spec={"read": read, "counts": counts}).output()

    def columns(self, batch: StreamBatch) -> tuple[Output, ...]:
        """All value columns of a batch; operations over several of them need no join."""
        node = Node("source", outputs=tuple(batch.columns), spec={"read": lambda spark: batch.df, "counts": lambda: batch.lengths})
        return tuple(node.output(i) for i in range(len(batch.columns)))

    def Output(self, column: Output, streams: list[NamedStream]) -> Node:
        """A sink into named streams, one for each input stream."""
        if not isinstance(column, Output) or not streams or not all(isinstance(s, (NamedStream, ExternalSink)) for s in streams) or len({type(s) for s in streams}) > 1:
            raise GraphError("Output takes a column and a list of named streams, or of external sinks")
        return Node("sink", (column,), (), {"streams": streams, "codec": column.codec or "zstd"})


class Streams:
    """Stream operations. Arguments are lists by stream, or one for all; inside slices they may be SliceArgs."""

    @staticmethod
    def _sample(name: str, column: Output, values: Any, make: Callable[[Any], D.Sampler]) -> Output:
        def build(v: Any) -> Any:
            try:
                return D.SliceArgs([make(x) for x in v.values]) if isinstance(v, D.SliceArgs) else make(v)
            except ValueError as e:
                raise GraphError(f"{name}: {e}") from e

        listed = values if isinstance(values, list) else [values]
        if not listed:
            raise GraphError(f"{name} has no argument")
        return Node("sample", (column,), spec={"name": name, "samplers": [build(v) for v in listed]}).output()

    def All(self, column: Output) -> Output:
        return self._sample("All", column, [None], lambda _: D.All())

    def Stride(self, column: Output, strides: Any) -> Output:
        return self._sample("Stride", column, strides, D.Stride)

    def Range(self, column: Output, ranges: Any) -> Output:
        return self._sample("Range", column, ranges, lambda r: D.Ranges((tuple(r),)))

    def Ranges(self, column: Output, intervals: Any) -> Output:
        return self._sample("Ranges", column, intervals, lambda r: D.Ranges(tuple(map(tuple, r))))

    def StridedRange(self, column: Output, ranges: Any) -> Output:
        return self._sample("StridedRange", column, ranges, lambda r: D.Ranges((tuple(r[:2]),), r[2]))

    def StridedRanges(self, column: Output, intervals: Any, stride: int) -> Output:
        return self._sample("StridedRanges", column, intervals, lambda r: D.Ranges(tuple(map(tuple, r)), stride))

    def Gather(self, column: Output, indices: Any) -> Output:
        return self._sample("Gather", column, indices, lambda r: D.Gather(tuple(r)))

    def Repeat(self, column: Output, spacings: Any) -> Output:
        return self._sample("Repeat", column, spacings, D.Repeat)

    def RepeatNull(self, column: Output, spacings: Any) -> Output:
        return self._sample("RepeatNull", column, spacings, lambda k: D.Repeat(k, True))

    def Slice(self, column: Output, partitioners: Any) -> Output:
        return Node("slice", (column,), spec={"partitioners": partitioners if isinstance(partitioners, list) else [partitioners]}).output()

    def Unslice(self, column: Output) -> Output:
        return Node("unslice", (column,)).output()


class Partitioners:
    """How Slice cuts a stream."""

    def all(self, group_size: int = 250) -> D.Partitioner:
        return D.GroupsOf(group_size)

    def strided(self, stride: int, group_size: int = 250) -> D.Partitioner:
        return D.GroupsOf(group_size, stride)

    def range(self, start: int, end: int) -> D.Partitioner:
        return D.RangeGroups(((start, end),))

    def ranges(self, intervals: list[tuple[int, int]]) -> D.Partitioner:
        return D.RangeGroups(tuple(map(tuple, intervals)))

    def strided_range(self, start: int, end: int, stride: int) -> D.Partitioner:
        return D.RangeGroups(((start, end),), stride)

    def strided_ranges(self, intervals: list[tuple[int, int]], stride: int) -> D.Partitioner:
        return D.RangeGroups(tuple(map(tuple, intervals)), stride)

    def gather(self, groups: list[list[int]]) -> D.Partitioner:
        return D.GatherGroups(tuple(map(tuple, groups)))


class Operations:
    """Registered operations by name: ``ops.Histogram(frame=column)``."""

    def __getattr__(self, name: str) -> Callable[..., Any]:
        def call(*columns: Output, stencil: list[int] | None = None, batch: int | None = None, bounded_state: int | None = None, args: dict | None = None, boundary: str = "repeat_edge", **more: Any) -> Any:
            named = {k: more.pop(k) for k in list(more) if isinstance(more[k], Output)}
            return make_op(name, list(columns) if columns else named, stencil, batch, bounded_state, args, boundary, **more)

        return call


class Client:
    """One session's graphs, jobs and catalog."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None):
        self.spark = importable(spark)
        self.io, self.streams, self.ops, self.partitioner = Inputs(), Streams(), Operations(), Partitioners()
        self.catalog = Catalog(spark, warehouse) if warehouse else None
        self.jobs: dict[str, Job] = {}

    def stream(self, name: str, column: str | None = None) -> NamedStream:
        return NamedStream(self.catalog, name, column)

    def lower(self, ends: list[Node], performance: Performance | None = None) -> Lowering:
        counts = {n.id: n.spec["counts"]() for n in order(ends) if n.kind == "source"}
        return Lowering(self.spark, ends, counts, performance)

    def frame(self, output: Output, name: str = "value", performance: Performance | None = None) -> DataFrame:
        """The lazy DataFrame of a column: stream_id [, slice_id], row_id and the value."""
        return self.lower([output.node], performance).frame(output, name)

    def table(self, name: str) -> Table:
        """A stream of the catalog with all its columns."""
        return Table(self.catalog, name)

    def load_op(self, path: str) -> ModuleType:
        """Run a Python file that registers operations; executors get it by value with the kernels, so they need no copy."""
        spec = importlib.util.spec_from_file_location(f"loaded_{Path(path).stem}", path)
        if spec is None or spec.loader is None:
            raise GraphError(f"{path} is no Python file")
        module = importlib.util.module_from_spec(spec)
        sys.modules[spec.name] = module
        spec.loader.exec_module(module)
        return self.register_module(module)

    def register_module(self, module: ModuleType) -> ModuleType:
        """Send a module to executors by value, with the operations that it registers."""
        register_pickle_by_value(module)
        return module

    def run(self, outputs: Node | list[Node], performance: Performance | None = None, cache_mode: CacheMode = CacheMode.ERROR, detach: bool = False, task_timeout: float | None = None) -> str | None:
        """Run sinks as one job and return its id, or None if all outputs are there already.

        A stream with an element that its kernel failed on, or whose task took more than ``task_timeout`` seconds, is left
        uncommitted (not written, if its sink is external) and reported with the job; the others are committed. So is a
        stream whose kernel ends its worker. IGNORE skips streams that are committed; leftovers of failed runs are written
        anew. External sinks have no cache modes.
        """
        sinks = outputs if isinstance(outputs, list) else [outputs]
        if not sinks or any(not isinstance(n, Node) or n.kind != "sink" for n in sinks):
            raise GraphError("run takes one or more Outputs")
        names = [s.name for n in sinks for s in n.spec["streams"]]
        if not all(names) or len(set(names)) < len(names):
            raise GraphError("every output stream needs a name of its own")
        if task_timeout is not None:
            performance = replace(performance or Performance(), task_timeout=task_timeout)
        low = self.lower(sinks, performance)
        for n in sinks:
            if len(n.spec["streams"]) != low.streams:
                raise GraphError(f"an Output has {len(n.spec['streams'])} streams for {low.streams} inputs")
        stored = [n for n in sinks if not isinstance(n.spec["streams"][0], ExternalSink)]
        if len({n.spec["streams"][0].catalog.warehouse for n in stored}) > 1:
            raise GraphError("all outputs of a job go to one warehouse")
        skip = self._cached(stored, cache_mode) if stored else set()
        todo = [i for i in range(low.streams) if i not in skip]
        if not todo:
            return None
        job = Job(uuid.uuid4().hex, streams=len(todo))
        self.jobs[job.id] = job
        if detach:
            job.thread = threading.Thread(target=self._guarded, args=(job, sinks, low, todo), daemon=True)
            job.thread.start()
        else:
            self._guarded(job, sinks, low, todo)
            if job.error:
                raise job.error
        return job.id

    def _cached(self, sinks: list[Node], mode: CacheMode) -> set[int]:
        there = [{i for i, s in enumerate(n.spec["streams"]) if s.exists()} for n in sinks]
        if mode is CacheMode.ERROR and any(there):
            name = next(n.spec["streams"][min(t)].name for n, t in zip(sinks, there) if t)
            raise ValueError(f"output stream {name} exists")
        if mode is CacheMode.OVERWRITE:
            for n, t in zip(sinks, there):
                for i in t:
                    n.spec["streams"][i].delete()
            return set()
        done = [{i for i in t if n.spec["streams"][i].committed()} for n, t in zip(sinks, there)]
        if any(d != done[0] for d in done):
            raise ValueError("with several outputs, IGNORE needs the same streams of each to be there")
        return done[0] if done else set()

    def _guarded(self, job: Job, sinks: list[Node], low: Lowering, todo: list[int]) -> None:
        context = self.spark.sparkContext
        context.setJobGroup(job.id, f"job {job.id}")
        try:
            with job.profile.span("job"):
                self._execute(job, sinks, low, todo)
            job.status = "done"
        except BaseException as e:
            job.status, job.error = "failed", e
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)
            job.profile.collect_tasks(self.spark, job.id)

    def _execute(self, job: Job, sinks: list[Node], low: Lowering, todo: list[int]) -> None:
        """Write every sink, look for failed streams, then commit the rest."""
        low = low.narrowed(todo)
        shared = [f for f in {id(low.families[n.inputs[0].node.id]): low.families[n.inputs[0].node.id] for n in sinks}.values() if low.python and len(sinks) > 1]
        for f in shared:
            f.df.persist(StorageLevel.DISK_ONLY)
        try:
            for k, node in enumerate(sinks):
                if isinstance(node.spec["streams"][0], ExternalSink):
                    self._send(job, node, low, todo, k)
                else:
                    self._store(job, node, low, todo, k)
        finally:
            for f in shared:
                f.df.unpersist()

    def _apart(self, job: Job, node: Node, todo: list[int], work: Callable[[list[int]], None]) -> None:
        """Do ``work`` for streams. If Spark gives up on it, as when a kernel ends its worker, halves of the streams go by
        themselves, until those are found that can't be done: they are reported."""
        try:
            work(todo)
        except Exception as e:
            if isinstance(e, AnalysisException) or type(e).__module__.split(".")[0] not in ("py4j", "pyspark"):
                raise
            if len(todo) == 1:
                job.failed[node.spec["streams"][todo[0]].name] = str(e).split("\n")[0]
                return
            for half in (todo[: len(todo) // 2], todo[len(todo) // 2 :]):
                self._apart(job, node, half, work)

    @staticmethod
    def _errors(df: DataFrame) -> dict[int, str]:
        """The first error of each stream that has one."""
        return {r["stream_id"]: r["e"] for r in df.where("__error IS NOT NULL").groupBy("stream_id").agg(F.min("__error").alias("e")).collect()}

    def _send(self, job: Job, node: Node, low: Lowering, todo: list[int], k: int) -> None:
        """The streams of an external sink: the graph runs once, and streams with errors are reported, not written."""
        streams = node.spec["streams"]

        def work(part: list[int]) -> None:
            df = low.narrowed(part).with_errors(node.inputs[0], "column").persist(StorageLevel.DISK_ONLY)
            try:
                with job.profile.span(f"verify {k}"):
                    errors = self._errors(df) if low.python else {}
                for i in part:
                    if i in errors:
                        job.failed[streams[i].name] = errors[i]
                    else:
                        with job.profile.span(f"write {k}"):
                            streams[i].write(df.where(F.col("stream_id") == i).select("row_id", "column"))
            finally:
                df.unpersist()

        self._apart(job, node, todo, work)

    def _store(self, job: Job, node: Node, low: Lowering, todo: list[int], k: int) -> None:
        """The streams of a sink in the catalog, each attempt to a folder of its own."""
        column = node.inputs[0]
        catalog: Catalog = node.spec["streams"][0].catalog
        kind = dict(low.with_errors(column, "column").dtypes)["column"]
        op = column.node.spec.get("op")
        element = op.outputs[column.index][1].name if op and op.outputs[column.index][1] else ""
        attempt = iter(range(1 << 30))

        def work(part: list[int]) -> None:
            root = f"{catalog.warehouse}/streams/{job.id}-{k}-{next(attempt)}"
            entries = {}
            for i in part:
                entries[i] = Entry(node.spec["streams"][i].name, f"{root}/stream_id={i}", {"column": kind}, {"column": element} if element else {}, low.shapes[node.id].lengths[i].total, False, job.id, time.time())
            catalog.put_all(list(entries.values()))
            df = low.narrowed(part).with_errors(column, "column")
            with job.profile.span(f"write {k}"):
                df.sortWithinPartitions("stream_id", "row_id").write.partitionBy("stream_id").option("compression", node.spec["codec"]).parquet(root)
            errors: dict[int, str] = {}
            if low.python and any(e.rows for e in entries.values()):
                with job.profile.span(f"verify {k}"):
                    errors = self._errors(self.spark.read.parquet(root))
            for i in errors:
                job.failed[entries[i].name] = errors[i]
            done = [e for i, e in entries.items() if i not in errors]
            for e in done:
                e.committed = True
            catalog.put_all(done)

        self._apart(job, node, todo, work)

    def wait_on_job(self, job_id: str) -> Job:
        job = self.jobs[job_id]
        if job.thread:
            job.thread.join()
        if job.error:
            raise job.error
        return job

    def get_active_jobs(self) -> list[str]:
        return [j.id for j in self.jobs.values() if j.status == "running"]

    def job_status(self, job_id: str) -> dict[str, Any]:
        job = self.jobs[job_id]
        return {"status": job.status, "streams": job.streams, "failed": dict(job.failed)}

    def get_profile(self, job_id: str) -> Profile:
        return self.jobs[job_id].profile

    def batch_load(self, streams: list[StoredStream], callback: Callable[[Any], Any], column_type: str = "string") -> DataFrame:
        """``callback`` over every element of many streams, in parallel: (stream_id, row_id, result)."""
        df = reduce(DataFrame.unionByName, [s.read().select(F.lit(i).alias("stream_id"), "row_id", "column") for i, s in enumerate(streams)])

        def run(batches):
            for pdf in batches:
                pdf["result"] = [None if v is None else callback(v) for v in pdf["column"]]
                yield pdf[["stream_id", "row_id", "result"]]

        return df.mapInPandas(run, f"stream_id int, row_id long, result {column_type}")
