"""Named streams in a warehouse: one Parquet folder a stream, with an entry that tells its rows and whether it is
committed. All paths go through Hadoop's file systems, so a warehouse may be anywhere that Spark can write."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.types import ElementType, NullElement, find_type


@dataclass
class Entry:
    """What the catalog knows of a stream."""

    name: str
    path: str
    columns: dict[str, str]
    types: dict[str, str] = field(default_factory=dict)
    rows: int = 0
    committed: bool = False
    job: str = ""
    timestamp: float = 0.0
    video: dict[str, Any] = field(default_factory=dict)


class Catalog:
    """The streams of a warehouse folder."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse = spark, warehouse.rstrip("/")
        self.mkdirs(f"{self.warehouse}/_catalog")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def mkdirs(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.mkdirs(p)

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _entry_path(self, name: str) -> str:
        return f"{self.warehouse}/_catalog/{name.encode().hex()}.json"

    def put(self, entry: Entry) -> None:
        """Write an entry; a rename makes it visible whole."""
        final, part = self._entry_path(entry.name), f"{self.warehouse}/_catalog/.{uuid.uuid4().hex}"
        self.write_file(part, json.dumps(asdict(entry)).encode())
        fs, target = self._fs(final)
        fs.delete(target, False)
        fs.rename(self._fs(part)[1], target)

    def write_file(self, path: str, data: bytes) -> None:
        """One file, wherever Hadoop's file systems reach."""
        fs, p = self._fs(path)
        out = fs.create(p)
        out.write(bytearray(data))
        out.close()

    def put_all(self, entries: list[Entry]) -> None:
        """Write many entries, some at a time."""
        if len(entries) < 2:
            for e in entries:
                self.put(e)
            return
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(self.put, entries))

    def new_folder(self) -> str:
        return f"{self.warehouse}/streams/{uuid.uuid4().hex}"

    def put_new(self, name: str, path: str, columns: dict[str, str], types: dict[str, str], rows: int, video: dict[str, Any] | None = None) -> None:
        """A committed stream out of files that are there."""
        self.put(Entry(name, path, columns, types, rows, True, "", time.time(), video or {}))

    def get(self, name: str) -> Entry | None:
        fs, p = self._fs(self._entry_path(name))
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return Entry(**json.loads(text))

    def names(self) -> list[str]:
        fs, p = self._fs(f"{self.warehouse}/_catalog")
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(bytes.fromhex(f[:-5]).decode() for f in found if f.endswith(".json"))

    def has(self, name: str) -> bool:
        return self.get(name) is not None

    def delete(self, names: str | list[str]) -> None:
        """Remove streams; unknown names are passed over."""
        for name in [names] if isinstance(names, str) else names:
            if entry := self.get(name):
                self.remove(self._entry_path(name))
                self.remove(entry.path)

    def summarize(self) -> DataFrame:
        """A row for every stream."""
        rows = [(e.name, e.rows, e.committed, ",".join(e.columns), e.job, e.timestamp) for e in map(self.get, self.names()) if e]
        return self.spark.createDataFrame(rows, "name string, rows long, committed boolean, columns string, job string, timestamp double")

    def new_table(self, name: str, columns: list[str], rows: list[list[Any]], encoders: list[Callable[[Any], bytes]] | None = None, force: bool = False) -> NamedStream:
        """A committed stream out of literal values: bytes, or what ``encoders`` make bytes of."""
        if self.has(name):
            if not force:
                raise ValueError(f"stream {name} exists")
            self.delete(name)
        if any(len(r) != len(columns) for r in rows):
            raise ValueError("every row needs a value for each column")
        encoders = encoders or [lambda v: v] * len(columns)
        data = [(i, *(None if v is None or isinstance(v, NullElement) else bytearray(f(v)) for v, f in zip(r, encoders))) for i, r in enumerate(rows)]
        schema = T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in columns)])
        path = f"{self.warehouse}/streams/{uuid.uuid4().hex}"
        self.spark.createDataFrame(data, schema).coalesce(1).write.parquet(path)
        self.put(Entry(name, path, {c: "binary" for c in columns}, {c: "bytes" for c in columns}, len(rows), True, "", time.time()))
        return NamedStream(self, name)

    def ingest(self, name: str, df: DataFrame, row_id: str, columns: list[str] | None = None, force: bool = False) -> NamedStream:
        """A stream out of a table with a dense row id 0..n-1; rejects ids that are not."""
        if self.has(name):
            if not force:
                raise ValueError(f"stream {name} exists")
            self.delete(name)
        columns = columns or [c for c in df.columns if c != row_id]
        path = f"{self.warehouse}/streams/{uuid.uuid4().hex}"
        df.select(F.col(row_id).cast("long").alias("row_id"), *columns).write.parquet(path)
        seen = self.spark.read.parquet(path).agg(F.count("*"), F.min("row_id"), F.max("row_id"), F.sum("row_id")).first()
        n = seen[0]
        if n and (seen[1] != 0 or seen[2] != n - 1 or seen[3] != n * (n - 1) // 2):
            self.remove(path)
            raise ValueError(f"row ids of {name} are not 0..{n - 1}")
        kinds = dict(self.spark.read.parquet(path).dtypes)
        self.put(Entry(name, path, {c: kinds[c] for c in columns}, {}, n, True, "", time.time()))
        return NamedStream(self, name)


@dataclass(frozen=True)
class Enumerator:
    """How many elements a source has, and the arguments that one is read with."""

    elements: int
    arguments: Callable[[int], dict[str, Any]]

    def total_elements(self) -> int:
        return self.elements

    def element_args_at(self, index: int) -> dict[str, Any]:
        if not 0 <= index < self.elements:
            raise IndexError(f"element {index} of {self.elements}")
        return self.arguments(index)


class StoredStream:
    """A named, ordered, finite sequence in some storage: what graphs read from and write to."""

    def length(self) -> int:
        raise NotImplementedError

    def read(self) -> DataFrame:
        """row_id and the stream's column, named ``column``."""
        raise NotImplementedError

    def exists(self) -> bool:
        return True

    def committed(self) -> bool:
        return self.exists()

    def delete(self) -> None:
        raise NotImplementedError(f"{type(self).__name__} can't be deleted")

    def type(self) -> ElementType | None:
        return None

    def enumerator(self) -> Enumerator:
        """The elements of the stream, by number."""
        return Enumerator(self.length(), lambda i: {"row_id": i})

    def estimate_size(self) -> int:
        """Bytes of an average element, from the first rows."""
        sample = self.read().where(F.col("row_id") < 100).agg(F.avg(F.length(F.col("column").cast("string")))).first()[0]
        return int(sample or 0)

    def load(self, rows: list[int] | None = None, type: Any = None, decode: Callable[[Any], Any] | None = None) -> Iterator[Any]:
        """Values in row order; ``decode`` goes before ``type``, before the stored type. A missing element is a NullElement."""
        df = self.read()
        if rows is not None:
            if sorted(rows) != list(rows):
                raise ValueError("rows must ascend")
            df = df.where(F.col("row_id").isin(list(rows)))
        kind = find_type(type) if type is not None else self.type()
        turn = decode or (kind.decode if kind else lambda v: bytes(v) if isinstance(v, (bytearray, memoryview)) else v)
        for row in df.orderBy("row_id").toLocalIterator():
            yield NullElement() if row["column"] is None else turn(row["column"])


class NamedStream(StoredStream):
    """A column of a stream in the catalog."""

    def __init__(self, catalog: Catalog, name: str, column: str | None = None):
        self.catalog, self.name, self._column = catalog, name, column

    def _entry(self) -> Entry:
        entry = self.catalog.get(self.name)
        if entry is None:
            raise KeyError(f"there is no stream {self.name}")
        return entry

    @property
    def column(self) -> str:
        columns = list(self._entry().columns)
        if self._column is not None:
            if self._column not in columns:
                raise KeyError(f"stream {self.name} has no column {self._column}")
            return self._column
        return next((c for c in ("column", "frame") if c in columns), columns[-1])

    def length(self) -> int:
        if not self.committed():
            raise ValueError(f"stream {self.name} is not committed")
        return self._entry().rows

    def read(self) -> DataFrame:
        entry = self._entry()
        if not entry.committed:
            raise ValueError(f"stream {self.name} is not committed")
        if not entry.rows:
            return self.catalog.spark.createDataFrame([], f"row_id long, column {entry.columns[self.column]}")
        return self.catalog.spark.read.parquet(entry.path).select("row_id", F.col(self.column).alias("column"))

    def exists(self) -> bool:
        return self.catalog.has(self.name)

    def committed(self) -> bool:
        entry = self.catalog.get(self.name)
        return entry is not None and entry.committed

    def delete(self) -> None:
        self.catalog.delete(self.name)

    def type(self) -> ElementType | None:
        name = self._entry().types.get(self.column)
        try:
            return find_type(name) if name else None
        except KeyError:
            return None


def read_together(streams: list[NamedStream]) -> DataFrame | None:
    """Streams that one job wrote, as one scan whose partitions are pruned: stream_id (their places in the list), row_id and
    column. None if they lie apart, if one is listed twice, or if there are too few to matter."""
    if len(streams) < 3:
        return None
    with ThreadPoolExecutor(16) as pool:
        entries = list(pool.map(lambda s: (s._entry(), s.column), streams))
    parts = [e.path.rsplit("/stream_id=", 1) for e, _ in entries]
    if any(len(p) != 2 for p in parts) or len({p[0] for p in parts}) > 1 or len({p[1] for p in parts}) < len(parts) or len({c for _, c in entries}) > 1:
        return None
    if not all(e.committed for e, _ in entries):
        raise ValueError(f"stream {next(e.name for e, _ in entries if not e.committed)} is not committed")
    if not any(e.rows for e, _ in entries):
        return None
    place = {int(p[1]): i for i, p in enumerate(parts)}
    df = streams[0].catalog.spark.read.parquet(parts[0][0]).where(F.col("stream_id").isin(list(place)))
    if all(k == i for k, i in place.items()):
        return df.select("stream_id", "row_id", F.col(entries[0][1]).alias("column"))
    known = streams[0].catalog.spark.createDataFrame(list(place.items()), "p_stream int, p_place int")
    return df.join(F.broadcast(known), F.col("stream_id") == F.col("p_stream")).select(F.col("p_place").alias("stream_id"), "row_id", F.col(entries[0][1]).alias("column"))


class Table:
    """All columns of a stream in the catalog."""

    def __init__(self, catalog: Catalog, name: str):
        if not catalog.has(name):
            raise KeyError(f"there is no stream {name}")
        self.catalog, self.name = catalog, name

    @property
    def entry(self) -> Entry:
        return self.catalog.get(self.name)

    def columns(self) -> list[str]:
        return list(self.entry.columns)

    def num_rows(self) -> int:
        return self.entry.rows

    def committed(self) -> bool:
        return self.entry.committed

    def column(self, name: str) -> NamedStream:
        return NamedStream(self.catalog, self.name, name)

    def frame(self) -> DataFrame:
        """row_id and all columns."""
        return self.catalog.spark.read.parquet(self.entry.path).select("row_id", *self.columns())

    def load(self, columns: list[str] | None = None, rows: list[int] | None = None, decode: Callable[..., Any] | None = None) -> Iterator[Any]:
        """Tuples of the columns' values in row order, or what ``decode`` makes of them; missing ones are NullElements."""
        columns = columns or self.columns()
        kinds = [self.column(c).type() for c in columns]
        df = self.frame().select("row_id", *columns)
        if rows is not None:
            if sorted(rows) != list(rows):
                raise ValueError("rows must ascend")
            df = df.where(F.col("row_id").isin(list(rows)))
        for row in df.orderBy("row_id").toLocalIterator():
            values = [NullElement() if row[c] is None else k.decode(row[c]) if k else bytes(row[c]) if isinstance(row[c], (bytearray, memoryview)) else row[c] for c, k in zip(columns, kinds)]
            yield decode(*values) if decode else tuple(values)

    def parent_rows(self) -> list[int]:
        """The rows of the stream that this one was made from: what its column ``index`` holds, else its own row ids."""
        if "index" in self.columns():
            return [r["index"] for r in self.frame().select("row_id", "index").orderBy("row_id").toLocalIterator()]
        return list(range(self.num_rows()))


class ExternalSink:
    """A place outside the catalog that a stream's elements go to: anything that a DataFrameWriter can write.

    ``format`` may be a Python data source. Rows are row_id and column; those whose kernel failed are left out. It has
    no commit flags and no cache modes: ``mode`` is the writer's.
    """

    def __init__(self, name: str, format: str, path: str | None = None, mode: str = "error", **options: Any):
        self.name, self.format, self.path, self.mode, self.options = name, format, path, mode, options

    def write(self, df: DataFrame) -> None:
        df.write.format(self.format).mode(self.mode).options(**self.options).save(self.path)


class FrameStream(StoredStream):
    """A column of any DataFrame with a dense row id."""

    def __init__(self, df: DataFrame, row_id: str, column: str, rows: int | None = None):
        self.df, self.row_id, self.column, self._rows = df, row_id, column, rows

    def length(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    def read(self) -> DataFrame:
        return self.df.select(F.col(self.row_id).cast("long").alias("row_id"), F.col(self.column).alias("column"))


class StreamBatch:
    """Many streams in one DataFrame: ids of streams (0..n-1), dense row ids within each, and value columns.

    It is read as one scan, however many streams there are. ``lengths`` are counted if they are not given.
    """

    def __init__(self, df: DataFrame, stream_id: str, row_id: str, columns: list[str], lengths: list[int] | None = None):
        self.columns = columns
        self.df = df.select(F.col(stream_id).cast("int").alias("stream_id"), F.col(row_id).cast("long").alias("row_id"), *columns)
        self._lengths = lengths

    @property
    def lengths(self) -> list[int]:
        if self._lengths is None:
            found = {r["stream_id"]: r["count"] for r in self.df.groupBy("stream_id").count().collect()}
            self._lengths = [found.get(i, 0) for i in range(max(found, default=-1) + 1)]
        return self._lengths
