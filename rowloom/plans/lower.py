"""Lowering of a graph to lazy DataFrames: one plan for all streams, keyed by stream_id [, slice_id] and row_id.

Columns made from one another row by row live in one frame (a family), so joining them costs nothing; inputs from
different families are joined by their keys. Wanted rows become filters on the stored row id at the scan. Arguments that
are the same for all streams become literals; others a small table by stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.operators.kernels import Operation, partition_runner
from rowloom.plans import domain as D
from rowloom.plans.graph import Node, Output, Shape, analyse, needs, per_stream, samplers_of, wanted

#: Argument tables up to this many rows are broadcast; their rows come from the driver, so the size is known.
BROADCAST_ROWS = 100_000
#: Ranges up to this many stand in the plan as literals.
LITERAL_RANGES = 64


@dataclass
class Performance:
    """Rows after which a window or bounded state is cut into chunks, rows of a Python batch, and seconds that a task (the
    consecutive rows of a batch) may take. The sizes don't change what kernels compute that keep to their stencil and state."""

    chunk_rows: int = 1 << 20
    batch_rows: int = 10_000
    task_timeout: float = 0.0

    @classmethod
    def manual(cls, work_packet_size: int, io_packet_size: int, **_: Any) -> Performance:
        """Batches of a work packet's rows, and chunks of an io packet's."""
        if work_packet_size <= 0 or io_packet_size <= 0 or io_packet_size % work_packet_size:
            raise ValueError("the io packet must be a multiple of the work packet")
        return cls(chunk_rows=io_packet_size, batch_rows=work_packet_size)

    @classmethod
    def estimate(cls, element_bytes: int = 0, memory_bytes: int = 256 << 20, **_: Any) -> Performance:
        """Batches that take at most a sixteenth of a task's memory, by the size of an element, and chunks of many."""
        if element_bytes <= 0:
            return cls()
        rows = max(1, min(10_000, memory_bytes // 16 // element_bytes))
        return cls(chunk_rows=max(rows, min(1 << 20, memory_bytes // element_bytes)), batch_rows=rows)


@dataclass(eq=False)
class Family:
    """A frame with keys, __error and the columns of row-aligned nodes."""

    df: DataFrame
    sliced: bool
    columns: set[str] = field(default_factory=set)

    @property
    def keys(self) -> list[str]:
        return ["stream_id", "slice_id", "row_id"] if self.sliced else ["stream_id", "row_id"]


def rows_filter(rows: list[D.Rows], lengths: list[int]) -> Column | None:
    """A condition that holds for the wanted rows of every stream, and for rows between them if they are many; None
    keeps all."""
    if all(r == ((0, n),) or not n for r, n in zip(rows, lengths)):
        return None
    one = lambda r: reduce(lambda a, b: a | b, ((F.col("row_id") >= a) & (F.col("row_id") < b) for a, b in r), F.lit(False)) if r else F.lit(False)
    if len(set(rows)) == 1:
        return one(rows[0])
    if len(rows) <= 32:
        return reduce(lambda a, b: a | b, ((F.col("stream_id") == i) & one(r) for i, r in enumerate(rows)))
    every = D.merge([(min(r[0][0] for r in rows if r), max(r[-1][1] for r in rows if r))]) if any(rows) else ()
    return one(every)


def fed_filter(rows: list[D.Wanted], warmup: int) -> Column:
    """The condition that holds for exactly the wanted rows of every stream and the ``warmup`` rows before each."""

    @F.pandas_udf("boolean")
    def fed(stream_id: pd.Series, row_id: pd.Series) -> pd.Series:
        streams, ids = stream_id.to_numpy(), row_id.to_numpy()
        order = np.lexsort((ids, streams))
        found = np.zeros(len(ids), bool)
        for part in np.split(order, np.flatnonzero(np.diff(streams[order])) + 1):
            if len(part):
                found[part] = rows[streams[part[0]]].any(ids[part], ids[part] + warmup)
        return pd.Series(found)

    return fed("stream_id", "row_id")


class Lowering:
    """Lowers the nodes of one graph."""

    def __init__(self, spark: SparkSession, ends: list[Node], counts: dict[int, list[int]], performance: Performance | None = None, only: list[int] | None = None):
        self.spark, self.performance, self.counts, self.only = spark, performance or Performance(), counts, only
        self.nodes, self.shapes = analyse(ends, counts)
        self.ends, self.wanted = ends, {}
        self.needs = needs(self.nodes, self.shapes, ends)
        self.families: dict[int, Family] = {}
        self.python = False
        self.uses: dict[str, int] = {}
        for i, node in enumerate(self.nodes):
            for o in node.inputs:
                self.uses[o.column] = len(self.nodes) if node.kind == "sink" else max(i, self.uses.get(o.column, 0))
        for node in ends:
            for k in range(len(node.outputs)):
                self.uses[node.output(k).column] = len(self.nodes)
        for i, node in enumerate(self.nodes):
            if node.kind != "sink":
                self.families[node.id] = getattr(self, f"_{node.kind}")(node, i)

    @property
    def streams(self) -> int:
        return len(next(iter(self.shapes.values())).lengths)

    def narrowed(self, streams: list[int]) -> Lowering:
        """The same graph over some of the streams: sources read no others, so that kernels don't meet them."""
        return self if len(streams) == len(self.only or range(self.streams)) else Lowering(self.spark, self.ends, self.counts, self.performance, streams)

    def frame(self, output: Output, name: str = "value") -> DataFrame:
        """Keys and the column of an output."""
        family = self.families[output.node.id]
        return family.df.select(*family.keys, F.col(output.column).alias(name))

    def with_errors(self, output: Output, name: str = "value") -> DataFrame:
        family = self.families[output.node.id]
        return family.df.select(*family.keys, F.col(output.column).alias(name), "__error")

    def _input(self, node: Node) -> Family:
        """The family with all inputs of a node."""
        found: list[Family] = []
        for o in node.inputs:
            if (f := self.families[o.node.id]) not in found:
                found.append(f)
        base = found[0]
        if len(found) == 1:
            return base
        wanted = {o.column for o in node.inputs}
        df = base.df.select(*base.keys, "__error", *sorted(base.columns & wanted))
        for i, other in enumerate(found[1:]):
            right = other.df.select(*other.keys, F.col("__error").alias(f"__error{i}"), *sorted((other.columns - base.columns) & wanted))
            df = df.join(right, base.keys).withColumn("__error", F.coalesce("__error", f"__error{i}")).drop(f"__error{i}")
        return Family(df, base.sliced, wanted)

    def _source(self, node: Node, _: int) -> Family:
        df = node.spec["read"](self.spark)
        shape = self.shapes[node.id]
        condition = rows_filter(self.needs[node.id], [n.total for n in shape.lengths])
        if condition is not None:
            df = df.where(condition)
        if self.only is not None:
            df = df.where(F.col("stream_id").isin(self.only))
        columns = [node.output(k).column for k in range(len(node.outputs))]
        df = df.select("stream_id", "row_id", F.lit(None).cast("string").alias("__error"), *(F.col(c).alias(n) for c, n in zip(node.outputs, columns)))
        return Family(df, False, set(columns))

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        df = self.spark.createDataFrame(rows, schema)
        return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df

    def _sample(self, node: Node, _: int) -> Family:
        family = self._input(node)
        source, made = node.inputs[0].column, node.output().column
        df = family.df.select(*family.keys, "__error", F.col(source).alias(made))
        lengths = self.shapes[node.inputs[0].node.id].lengths
        chosen = [samplers_of(node, i, n.groups, family.sliced, self.streams) for i, n in enumerate(lengths)]
        flat = {s for c in chosen for s in c}
        kinds = {type(s) for s in flat}
        if len(kinds) != 1:
            raise ValueError(f"{node.spec['name']}: arguments of different kinds")
        kind = kinds.pop()
        by_slice = any(len(c) > 1 for c in chosen)
        if kind is not D.All:
            df = getattr(self, f"_{kind.__name__.lower()}")(df, made, chosen, lengths, by_slice, next(iter(flat)) if len(flat) == 1 else None)
        wanted = rows_filter(self.needs[node.id], [n.total for n in self.shapes[node.id].lengths]) if not family.sliced else None
        if wanted is not None:
            df = df.where(wanted)
        return Family(df.select(*family.keys, "__error", made), family.sliced, {made})

    def _by_slice(self, chosen: list[list], lengths: list[D.Lengths], by_slice: bool):
        """(stream, slice, rows of the slice, sampler); without ``by_slice`` one entry a stream."""
        for i, (samplers, n) in enumerate(zip(chosen, lengths)):
            if by_slice:
                for g, size in enumerate(n):
                    yield i, g, size, samplers[g if len(samplers) > 1 else 0]
            else:
                yield i, 0, max((k for k, _ in n.runs), default=0), samplers[0]

    def _stride(self, df, made, chosen, lengths, by_slice, one):
        if one:
            step = F.lit(one.stride)
        else:
            table = self._table([(i, g, s.stride) for i, g, _, s in self._by_slice(chosen, lengths, by_slice)], "p_stream int, p_slice long, p_step long")
            df, step = df.join(table, self._on(by_slice)), F.col("p_step")
        return df.where(F.col("row_id") % step == 0).withColumn("row_id", F.expr("row_id div 1") if one and one.stride == 1 else self._div(F.col("row_id"), step))

    @staticmethod
    def _div(a: Column, b: Column) -> Column:
        """Whole quotient of non-negative longs."""
        return ((a - a % b) / b).cast("long")

    @staticmethod
    def _on(by_slice: bool) -> Column:
        on = F.col("stream_id") == F.col("p_stream")
        return on & (F.col("slice_id") == F.col("p_slice")) if by_slice else on

    def _repeat(self, df, made, chosen, lengths, by_slice, one):
        if one:
            times = F.lit(one.times)
        else:
            table = self._table([(i, g, s.times) for i, g, _, s in self._by_slice(chosen, lengths, by_slice)], "p_stream int, p_slice long, p_times long")
            df, times = df.join(table, self._on(by_slice)), F.col("p_times")
        null = next(s for c in chosen for s in c).null
        df = df.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), (times - 1).cast("long")))).withColumn("row_id", F.col("row_id") * times + F.col("__j"))
        return df.withColumn(made, F.when(F.col("__j") == 0, F.col(made))) if null else df

    def _ranges(self, df, made, chosen, lengths, by_slice, one):
        if one and len(one.intervals) <= LITERAL_RANGES:
            if not one.intervals:
                return df.where(F.lit(False))
            low, high = min(a for a, _ in one.intervals), max(b for _, b in one.intervals)
            df = df.where((F.col("row_id") >= low) & (F.col("row_id") < high))
            if len(one.intervals) == 1:
                df = df.where((F.col("row_id") - low) % one.stride == 0) if one.stride > 1 else df
                return df.withColumn("row_id", self._div(F.col("row_id") - low, F.lit(one.stride)))
            if len({n for x in lengths for n, _ in x.runs}) <= 1:
                size = next((n for x in lengths for n, _ in x.runs), 0)
                listed = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(at).cast("long").alias("at")) for a, b, at in one.cut(size) or [(0, 0, 0)]))
                r = F.col("row_id")
                df = df.withColumn("__r", F.explode(F.filter(listed, lambda x: (x["a"] <= r) & (r < x["b"]) & ((r - x["a"]) % one.stride == 0))))
                return df.withColumn("row_id", F.col("__r.at") + self._div(F.col("row_id") - F.col("__r.a"), F.lit(one.stride)))
        # where a range may be cut, the offsets of later ones depend on the slice's length
        by_slice = by_slice or "slice_id" in df.columns and any(len(s.intervals) > 1 for c in chosen for s in c)
        rows = [(i, g, a, b, at, s.stride) for i, g, size, s in self._by_slice(chosen, lengths, by_slice) for a, b, at in s.cut(size)]
        return self._range_join(df, rows, by_slice)

    def _range_join(self, df: DataFrame, rows: list[tuple], by_slice: bool, width: int | None = None) -> DataFrame:
        """Rows in (stream, slice, start, end, offset, stride); an equi-join on the bucket of the row id."""
        width = width or max([1, *(b - a for _, _, a, b, _, _ in rows)])
        spread = [(*r, k) for r in rows for k in range(r[2] // width, (r[3] - 1) // width + 1)]
        table = self._table(spread, "p_stream int, p_slice long, p_a long, p_b long, p_at long, p_step long, p_bucket long")
        r = F.col("row_id")
        df = df.withColumn("__bucket", self._div(r, F.lit(width))).join(table, self._on(by_slice) & (F.col("__bucket") == F.col("p_bucket")))
        df = df.where((r >= F.col("p_a")) & (r < F.col("p_b")) & ((r - F.col("p_a")) % F.col("p_step") == 0))
        return df.withColumn("row_id", F.col("p_at") + self._div(r - F.col("p_a"), F.col("p_step")))

    def _gather(self, df, made, chosen, lengths, by_slice, one):
        shortest = min((n for x in lengths for n, _ in x.runs), default=0)
        by_slice = by_slice or "slice_id" in df.columns and any(r >= shortest for c in chosen for s in c for r in s.indices)
        rows = [(i, g, r, k) for i, g, size, s in self._by_slice(chosen, lengths, by_slice) for k, r in enumerate(s.within(size))]
        if not rows:
            return df.where(F.lit(False))
        df = df.where((F.col("row_id") >= min(r[2] for r in rows)) & (F.col("row_id") <= max(r[2] for r in rows)))
        table = self._table(rows, "p_stream int, p_slice long, p_row long, p_at long")
        return df.join(table, self._on(by_slice) & (F.col("row_id") == F.col("p_row"))).withColumn("row_id", F.col("p_at"))

    def _slice(self, node: Node, _: int) -> Family:
        family = self._input(node)
        made = node.output().column
        df = family.df.select("stream_id", "row_id", "__error", F.col(node.inputs[0].column).alias(made))
        parts = per_stream(node.spec["partitioners"], self.streams, "Slice")
        r = F.col("row_id")
        if len(set(parts)) == 1 and isinstance(parts[0], D.GroupsOf):
            p = parts[0]
            df = (df.where(r % p.stride == 0).withColumn("row_id", self._div(r, F.lit(p.stride)))) if p.stride > 1 else df
            df = df.withColumn("slice_id", self._div(r, F.lit(p.size))).withColumn("row_id", r % p.size)
        elif all(isinstance(p, D.GatherGroups) for p in parts):
            rows = [(i, g, x, k) for i, p in enumerate(parts) for g, group in enumerate(p.rows) for k, x in enumerate(group)]
            table = self._table(rows, "p_stream int, p_slice long, p_row long, p_at long")
            df = df.join(table, self._on(False) & (r == F.col("p_row"))).withColumn("row_id", F.col("p_at")).withColumn("slice_id", F.col("p_slice"))
        else:
            up = self.shapes[node.inputs[0].node.id].lengths
            rows = []
            for i, p in enumerate(parts):
                if isinstance(p, D.RangeGroups):
                    rows += [(i, g, a, b, 0, p.stride) for g, (a, b) in enumerate(p.intervals) if a < b]
                else:
                    for g in range(p.lengths(up[i].total).groups):
                        rows.append((i, g, g * p.size * p.stride, min((g + 1) * p.size * p.stride, up[i].total), 0, p.stride))
            df = self._range_join(df, rows, False).withColumn("slice_id", F.col("p_slice"))
        return Family(df.select("stream_id", "slice_id", "row_id", "__error", made), True, {made})

    def _unslice(self, node: Node, _: int) -> Family:
        family = self._input(node)
        made = node.output().column
        df = family.df.select(*family.keys, "__error", F.col(node.inputs[0].column).alias(made))
        lengths = self.shapes[node.inputs[0].node.id].lengths
        strides = {n.stride() for n in lengths}
        if len(strides) == 1 and None not in strides:
            df = df.withColumn("row_id", F.col("slice_id") * strides.pop() + F.col("row_id"))
        else:
            table = self._table([(i, g, at) for i, n in enumerate(lengths) for g, at in enumerate(n.offsets())], "p_stream int, p_slice long, p_at long")
            df = df.join(table, self._on(True)).withColumn("row_id", F.col("p_at") + F.col("row_id"))
        return Family(df.select("stream_id", "row_id", "__error", made), False, {made})

    def _chunked(self, df: DataFrame, keys: list[str], before: int, after: int, lengths: list[D.Lengths]) -> tuple[DataFrame, list[str]]:
        """Rows with their chunk (of ``before`` rows more on the left and ``after`` on the right) and whether they are the chunk's own.

        Streams shorter than a chunk are one; a row that neighbouring chunks need is copied to them.
        """
        size = self.performance.chunk_rows
        longest = max((n for x in lengths for n, _ in x.runs), default=0)
        if longest <= size:
            return df.withColumn("__chunk", F.lit(0).cast("long")).withColumn("__emit", F.lit(True)), [*keys[:-1], "__chunk"]
        r = F.col("row_id")
        own = self._div(r, F.lit(size))
        first = self._div(F.greatest(r - after, F.lit(0)), F.lit(size))
        df = df.withColumn("__own", own).withColumn("__chunk", F.explode(F.sequence(first, self._div(r + before, F.lit(size)))))
        return df.withColumn("__emit", F.col("__chunk") == F.col("__own")).drop("__own"), [*keys[:-1], "__chunk"]

    def _op(self, node: Node, position: int) -> Family:
        op: Operation = node.spec["op"]
        family = self._input(node)
        shape: Shape = self.shapes[node.id]
        offsets = tuple(node.spec["stencil"]) if node.spec["stencil"] is not None else op.stencil
        names = [o.column for o in node.inputs]
        made = [node.output(k).column for k in range(len(op.outputs))]
        df, columns = family.df, dict(zip(names, names))
        if offsets is not None:
            df, columns = self._stencil_columns(df, family.keys, names, offsets, shape, not op.expression, node.spec["boundary"])
        keep = [c for c in sorted(family.columns) if self.uses.get(c, -1) > position]
        if op.expression:
            from rowloom.operators.kernels import KernelConfig

            given = [columns[c] if offsets is not None else F.col(columns[c]) for c in names]
            result = op.target(KernelConfig(node.spec["args"], tuple(names), tuple(made)), *given)
            result = result if isinstance(result, tuple) else (result,)
            df = df.select(*family.keys, "__error", *keep, *(c.alias(n) for c, n in zip(result, made)))
        else:
            df = self._python(node, op, df, family, [columns[c] for c in names], made, keep, offsets is not None, shape)
        grown = Family(df, family.sliced, {*keep, *made})
        for k, f in self.families.items():
            if f is family:
                self.families[k] = grown
        return grown

    def _stencil_columns(self, df: DataFrame, keys: list[str], names: list[str], offsets: tuple[int, ...], shape: Shape, listed: bool, boundary: str):
        """The neighbours of every row at ``offsets``, row ids clamped to the stream or slice."""
        df, group = self._chunked(df, keys, max(0, -min(offsets)), max(0, max(offsets)), shape.lengths)
        ordered = Window.partitionBy(*group).orderBy("row_id")
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        columns: dict[str, Any] = {}
        for n in dict.fromkeys(names):
            box = F.struct(F.col(n).alias("v"))
            around = []
            for k, o in enumerate(offsets):
                found = box if o == 0 else F.lag(box, -o).over(ordered) if o < 0 else F.lead(box, o).over(ordered)
                if o and boundary == "repeat_edge":
                    found = F.coalesce(found, (F.first(box) if o < 0 else F.last(box)).over(whole))
                elif o and boundary == "error":
                    missing = F.when(F.col("__emit"), F.raise_error(F.lit(f"a window reaches {o} rows beyond its stream"))).cast(f"struct<v:{df.schema[n].dataType.simpleString()}>")
                    found = F.coalesce(found, missing)
                df = df.withColumn(f"__s_{n}_{k}", found)
                around.append(F.col(f"__s_{n}_{k}")["v"])
            columns[n] = around
        df = df.where("__emit").drop("__emit", "__chunk")
        if listed:
            for n, around in columns.items():
                df = df.withColumn(f"__s_{n}", F.array(*around))
                columns[n] = f"__s_{n}"
        return df, columns

    def _python(self, node: Node, op: Operation, df: DataFrame, family: Family, inputs: list[str], made: list[str], keep: list[str], windows: bool, shape: Shape) -> DataFrame:
        self.python = True
        warmup = node.spec["bounded_state"] if node.spec["bounded_state"] is not None else op.bounded_state
        stateful = op.unbounded_state or warmup is not None
        batch = node.spec["batch"] or op.batch
        carried = [*family.keys, "__error", *keep]
        extra = []
        if stateful:
            if not family.sliced:
                condition = rows_filter(self.needs[node.id], [n.total for n in shape.lengths])
                df = df.where(condition) if condition is not None else df
                exact = wanted(node, self.nodes, self.shapes, self.ends, self.wanted)
                if not op.unbounded_state and not all(w.whole for w in exact):
                    df = df.where(fed_filter(exact, warmup))
            if op.unbounded_state:
                df, group = df.withColumn("__chunk", F.lit(0).cast("long")).withColumn("__emit", F.lit(True)), [*family.keys[:-1], "__chunk"]
            else:
                df, group = self._chunked(df, family.keys, warmup, 0, shape.lengths)
            df = df.repartition(*group).sortWithinPartitions(*group, "row_id")
            extra = ["__chunk", "__emit"]
        fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        schema = ", ".join([f"`{c}` {fields[c]}" for c in carried if c != "__error"] + [f"`{m}` {t.spark.simpleString()}" for m, (_, t) in zip(made, op.outputs)] + ["`__error` string"])
        run = partition_runner(op, node.spec["args"], {k: per_stream(v, self.streams, k) for k, v in node.spec["stream_args"].items()}, batch, inputs, windows, [c for c in carried if c != "__error"], made, family.sliced, stateful, self.performance.task_timeout, self.performance.batch_rows)
        return df.select(*dict.fromkeys([*carried, *extra, *inputs])).mapInArrow(run, schema)
