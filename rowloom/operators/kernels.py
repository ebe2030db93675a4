"""Kernels: the registry of operations, and how Python kernels run over the rows of a partition.

An operation is a function of columns (``expression=True``; it stays inside the JVM), a Python function, or a class with
``execute``. Annotations give the element types. A class may have ``reset`` (before a run of rows that doesn't follow the
last one), ``new_stream`` (whose parameters are arguments by stream), ``fetch_resources`` (once a process),
``setup_with_resources`` and ``close``.
"""

from __future__ import annotations

import collections.abc
import inspect
import signal
import sys
import threading
import typing
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql.pandas.types import to_arrow_type

from rowloom.types import ElementType, find_type


@dataclass(frozen=True)
class KernelConfig:
    """What a kernel is built with: its arguments and, for information, its column names."""

    args: dict[str, Any] = field(default_factory=dict)
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Operation:
    """A registered operation."""

    name: str
    target: Any
    inputs: tuple[tuple[str, ElementType | None], ...]
    outputs: tuple[tuple[str, ElementType], ...]
    variadic: bool = False
    expression: bool = False
    stencil: tuple[int, ...] | None = None
    batch: int = 1
    takes_batch: bool = False
    bounded_state: int | None = None
    unbounded_state: bool = False
    accepts_null: bool = False
    init_args: tuple[str, ...] = ()
    stream_args: tuple[str, ...] = ()


REGISTRY: dict[str, Operation] = {}
_FETCHED: set[str] = set()


def _element(annotation: Any, layers: int, where: str) -> ElementType:
    """The element type under ``layers`` of Sequence."""
    for _ in range(layers):
        if typing.get_origin(annotation) not in (collections.abc.Sequence, list, tuple):
            raise TypeError(f"{where} must be a Sequence: the operation takes batches or windows")
        annotation = typing.get_args(annotation)[0]
    return find_type(annotation)


def register_op(name: str | None = None, stencil: Sequence[int] | None = None, bounded_state: int | None = None, unbounded_state: bool = False, batch: int | None = None, expression: bool = False, outputs: dict[str, Any] | None = None, accepts_null: bool = False, replace: bool = False) -> Callable:
    """Register a function or class as an operation; the checks name what is missing or contradictory."""

    def decorate(target: Any) -> Any:
        label = name or target.__name__
        if label in REGISTRY and not replace:
            raise ValueError(f"operation {label} is registered already")
        if bounded_state is not None and unbounded_state:
            raise ValueError(f"{label}: state is either bounded or unbounded")
        if batch is not None and batch < 1:
            raise ValueError(f"{label}: a batch needs at least one row")
        is_class = inspect.isclass(target)
        if is_class and not callable(getattr(target, "execute", None)):
            raise TypeError(f"{label} has no execute method")
        function = target.execute if is_class else target
        hints = typing.get_type_hints(function)
        parameters = list(inspect.signature(function).parameters.values())[1:]
        layers = (batch is not None) + (stencil is not None)
        variadic, inputs = False, []
        for p in parameters:
            if p.kind in (p.VAR_KEYWORD, p.POSITIONAL_ONLY):
                raise TypeError(f"{label}: parameter {p.name} must be plain")
            if p.kind == p.VAR_POSITIONAL:
                variadic = True
            if expression:
                inputs.append((p.name, None))
                continue
            if p.name not in hints:
                raise TypeError(f"{label}: parameter {p.name} has no annotation")
            inputs.append((p.name, _element(hints[p.name], layers, f"{label}: {p.name}")))
        if variadic and len(inputs) > 1:
            raise TypeError(f"{label}: *args must be the only input")
        if not inputs:
            raise TypeError(f"{label} has no input")
        if outputs is not None:
            made = [(k, find_type(v)) for k, v in outputs.items()]
        elif expression:
            made = [("ret0", None)]
        else:
            if "return" not in hints:
                raise TypeError(f"{label} has no return annotation")
            result = hints["return"]
            if batch is not None:
                if typing.get_origin(result) not in (collections.abc.Sequence, list):
                    raise TypeError(f"{label}: the result must be a Sequence: the operation takes batches")
                result = typing.get_args(result)[0]
            if typing.get_origin(result) is tuple:
                parts = typing.get_args(result)
                if Ellipsis in parts:
                    raise TypeError(f"{label}: the number of results must be fixed")
                made = [(f"ret{i}", find_type(t)) for i, t in enumerate(parts)]
            else:
                made = [("ret0", find_type(result))]
        init, by_stream = [], []
        if is_class:
            init = [p for p in inspect.signature(target.__init__).parameters][1:] if target.__init__ is not object.__init__ else []
            if not init or init[0] != "config":
                raise TypeError(f"{label}: the first argument of __init__ must be config")
            init = init[1:]
            if hasattr(target, "new_stream"):
                by_stream = [p for p in inspect.signature(target.new_stream).parameters][1:]
        if not target.__module__.startswith("rowloom."):  # workers may not have the user's module
            register_pickle_by_value(sys.modules[target.__module__])
        REGISTRY[label] = Operation(label, target, tuple(inputs), tuple(made), variadic, expression, tuple(stencil) if stencil is not None else None, batch or 1, batch is not None, bounded_state, unbounded_state, accepts_null, tuple(init), tuple(by_stream))
        return target

    return decorate


class TaskTimeout(BaseException):
    """A task took too long. No Exception, so that kernels that catch those don't hold it up."""


@contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """Raises TaskTimeout after so many seconds (0: never). Alarms reach main threads only, which workers run kernels in."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def ring(*_: Any) -> None:
        raise TaskTimeout

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


class Runner:
    """One kernel instance in a worker, fed with rows in order. Consecutive rows of a batch are a task."""

    def __init__(self, op: Operation, args: dict[str, Any], stream_args: dict[str, list], batch: int, names: tuple[str, ...], timeout: float = 0.0):
        self.op, self.batch, self.stream_args, self.timeout = op, batch, stream_args, timeout
        self.stuck: set[int] = set()
        config = KernelConfig(args, names, tuple(o[0] for o in op.outputs))
        if inspect.isclass(op.target):
            if op.name not in _FETCHED and hasattr(op.target, "fetch_resources"):
                self.kernel = op.target(config, **{k: args[k] for k in op.init_args if k in args})
                self.kernel.fetch_resources()
                _FETCHED.add(op.name)
            self.kernel = op.target(config, **{k: args[k] for k in op.init_args if k in args})
            if hasattr(self.kernel, "setup_with_resources"):
                self.kernel.setup_with_resources()
            self.call = self.kernel.execute
        else:
            self.kernel = None
            self.call = lambda *values: op.target(config, *values)

    def start(self, stream: int, slice_id: int | None, fresh: bool) -> None:
        """Before the first row of a run (``fresh``: of another stream or slice, or after a gap)."""
        if self.kernel is None:
            return
        if fresh and hasattr(self.kernel, "reset"):
            self.kernel.reset()
        if hasattr(self.kernel, "new_stream"):
            chosen = {}
            for k, values in self.stream_args.items():
                v = values[stream] if len(values) > 1 else values[0]
                if hasattr(v, "values") and isinstance(v.values, list):
                    v = v.values[slice_id or 0]
                chosen[k] = v
            self.kernel.new_stream(**chosen)

    def close(self) -> None:
        if self.kernel is not None and hasattr(self.kernel, "close"):
            self.kernel.close()

    def rows(self, values: list[tuple], stream: int = 0) -> list[tuple[tuple, str | None]]:
        """Encoded results and errors of consecutive rows. After a task that took too long its stream isn't worked on."""
        out: list[tuple[tuple, str | None]] = []
        late = ((None,) * len(self.op.outputs), f"{self.op.name}: a task took more than {self.timeout} s")
        if stream not in self.stuck:
            try:
                with time_limit(self.timeout):
                    for i in range(0, len(values), self.batch):
                        out += self._batch(values[i : i + self.batch])
                return out
            except TaskTimeout:
                self.stuck.add(stream)
        return out + [late] * (len(values) - len(out))

    def _batch(self, part: list[tuple]) -> list[tuple[tuple, str | None]]:
        nothing = (None,) * len(self.op.outputs)
        live = [k for k, v in enumerate(part) if self.op.accepts_null or not any(_missing(x) for x in v)]
        found: list[tuple[tuple, str | None]] = [(nothing, None)] * len(part)
        if not live:
            return found
        try:
            if self.op.takes_batch:
                results = list(self.call(*([part[k][c] for k in live] for c in range(len(part[0])))))
                if len(results) != len(live):
                    raise ValueError(f"{self.op.name} made {len(results)} elements of {len(live)}")
            else:
                results = [self.call(*part[k]) for k in live]
            for k, r in zip(live, results):
                made = r if len(self.op.outputs) > 1 else (r,)
                if len(made) != len(self.op.outputs):
                    raise ValueError(f"{self.op.name} made {len(made)} values for {len(self.op.outputs)} outputs")
                found[k] = (tuple(None if v is None else t.encode(v) for v, (_, t) in zip(made, self.op.outputs)), None)
        except Exception as e:  # the stream is reported and not committed; the others go on
            return [(nothing, f"{self.op.name}: {type(e).__name__}: {e}")] * len(part)
        return found


def _missing(value: Any) -> bool:
    return value is None or isinstance(value, list) and any(v is None for v in value)


def partition_runner(op: Operation, args: dict, stream_args: dict, batch: int, inputs: list[str], windows: bool, keep: list[str], outputs: list[str], sliced: bool, stateful: bool, timeout: float = 0.0, batch_rows: int = 10_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that a partition's Arrow batches go through: nulls are those of Arrow, so NaN is a value. Rows of a
    stateful operation come in order; those whose ``__emit`` is false are computed and dropped."""
    types = [t for _, t in op.inputs] * (len(inputs) if op.variadic else 1)
    names = tuple(inputs)
    made = [(c, t.spark) for c, (_, t) in zip(outputs, op.outputs)]

    def decode(value: Any, kind: ElementType) -> Any:
        if value is None:
            return None
        if windows:
            return [None if v is None else kind.decode(v) for v in value]
        return value if op.variadic else kind.decode(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner, last = Runner(op, args, stream_args, batch, names, timeout), None
        for part in (whole.slice(i, batch_rows) for whole in batches for i in range(0, whole.num_rows, batch_rows)):
            n = part.num_rows
            listed = lambda c: part.column(c).to_pylist()
            streams, ids, before = listed("stream_id"), listed("row_id"), listed("__error")
            slices = listed("slice_id") if sliced else [None] * n
            chunks = listed("__chunk") if stateful else [0] * n
            values = list(zip(*([decode(v, t) for v in listed(c)] for c, t in zip(inputs, types))))
            results, i = [], 0
            while i < n:
                j = i + 1
                while j < n and (streams[j], slices[j], chunks[j]) == (streams[i], slices[i], chunks[i]) and (not stateful or ids[j] == ids[j - 1] + 1):
                    j += 1
                here = (streams[i], slices[i], chunks[i])
                fresh = last is None or last[0] != here or (stateful and ids[i] != last[1] + 1)
                if fresh:
                    runner.start(streams[i], slices[i], True)
                results += runner.rows(values[i:j], streams[i])
                last, i = (here, ids[j - 1]), j
            arrays = [part.column(c) for c in keep]
            arrays += [pa.array([r[0][k] for r in results], to_arrow_type(kind)) for k, (_, kind) in enumerate(made)]
            arrays.append(pa.array([e or r[1] for e, r in zip(before, results)], pa.string()))
            out = pa.RecordBatch.from_arrays(arrays, [*keep, *outputs, "__error"])
            yield out.filter(part.column("__emit")) if stateful else out
        runner.close()

    return run
