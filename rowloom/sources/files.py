"""Streams over files: one element a file, packed files, and any Spark data source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rowloom.sources.catalog import Catalog, Entry, NamedStream, StoredStream
from rowloom.types import encode_frame, unpack_rows


class FilesStream(StoredStream):
    """One element for each file of a list, in its order; files are read by the executors."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark, self.paths = spark, paths

    def length(self) -> int:
        return len(self.paths)

    def read(self) -> DataFrame:
        if not self.paths:
            return self.spark.createDataFrame([], "row_id long, column binary")
        files = self.spark.read.format("binaryFile").load(sorted(set(self.paths)))
        listed = self.spark.createDataFrame([(i, p.split("://")[-1].lstrip("/").removeprefix("file:")) for i, p in enumerate(self.paths)], "row_id long, name string")
        named = files.select(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", ""), "^/+", "").alias("name"), F.col("content").alias("column"))
        return named.join(listed, "name").select("row_id", "column")


class PackedFileStream(StoredStream):
    """The values of one packed file: their number, sizes and bytes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for content in pdf["content"]:
                    values = unpack_rows(bytes(content))
                    yield pd.DataFrame({"row_id": range(len(values)), "column": values})

        return self.spark.read.format("binaryFile").load(self.path).select("content").mapInPandas(run, "row_id long, column binary")

    def length(self) -> int:
        return self.read().count()


class SourceStream(StoredStream):
    """A column of anything that spark.read can read, with a dense row id."""

    def __init__(self, spark: SparkSession, format: str, row_id: str, column: str, path: str | None = None, **options: Any):
        self.spark, self.format, self.row_id, self.column, self.path, self.options = spark, format, row_id, column, path, options

    def read(self) -> DataFrame:
        df = self.spark.read.format(self.format).options(**self.options).load(self.path)
        return df.select(F.col(self.row_id).cast("long").alias("row_id"), F.col(self.column).alias("column"))

    def length(self) -> int:
        return self.read().count()


class ElementSource(DataSource):
    """Base for sources written in Python: ``total(options)`` elements, read by ``element(options, index)``.

    Register a subclass with spark.dataSource.register; its reader cuts the indices into partitions.
    """

    @classmethod
    def name(cls) -> str:
        return cls.__name__.lower()

    def schema(self) -> str:
        return "row_id long, column binary"

    def total(self) -> int:
        raise NotImplementedError

    def element(self, index: int) -> Any:
        raise NotImplementedError

    def reader(self, schema: Any) -> DataSourceReader:
        return _ElementReader(self)


class _Slice(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _ElementReader(DataSourceReader):
    def __init__(self, source: ElementSource):
        self.source = source

    def partitions(self) -> list[_Slice]:
        n, size = self.source.total(), int(self.source.options.get("rowsPerPartition", 1000))
        return [_Slice(i, min(i + size, n)) for i in range(0, n, size)] or [_Slice(0, 0)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for i in range(partition.start, partition.end):
            yield i, self.source.element(i)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    rows: int
    result: Any


class ElementSink(DataSource):
    """Base for sinks written in Python: in a task ``new_stream(options)`` opens it, ``write(row_id, value)`` takes every
    element and ``close()`` may return a result; ``finished(options, results)`` runs once, on the driver, when all tasks
    are done, or ``failed(options, results)`` if one isn't.

    Register a subclass with spark.dataSource.register, and name it in an ExternalSink.
    """

    @classmethod
    def name(cls) -> str:
        return cls.__name__.lower()

    def new_stream(self, options: dict[str, str]) -> None:
        pass

    def write(self, row_id: int, value: Any) -> None:
        raise NotImplementedError

    def close(self) -> Any:
        return None

    def finished(self, options: dict[str, str], results: list[Any]) -> None:
        pass

    def failed(self, options: dict[str, str], results: list[Any]) -> None:
        pass

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return _ElementWriter(self)


class _ElementWriter(DataSourceWriter):
    def __init__(self, sink: ElementSink):
        self.sink = sink

    def write(self, iterator: Iterator[Any]) -> Written:
        self.sink.new_stream(dict(self.sink.options))
        rows = 0
        for row in iterator:
            self.sink.write(row["row_id"], row["column"])
            rows += 1
        return Written(rows, self.sink.close())

    def commit(self, messages: list[Written | None]) -> None:
        self.sink.finished(dict(self.sink.options), [m.result for m in messages if m is not None])

    def abort(self, messages: list[Written | None]) -> None:
        self.sink.failed(dict(self.sink.options), [m.result for m in messages if m is not None])


def ingest_images(catalog: Catalog, name: str, stream: StoredStream, force: bool = False) -> tuple[NamedStream, DataFrame]:
    """A frame stream out of PNG, PGM and PPM files, and a table of those that could not be read (row_id, error).

    Rows keep their ids; a file that can't be read is a null element. If none can, it is an error.
    """
    from rowloom.functions.images import decode_image

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            frames, errors = [], []
            for content in pdf["column"]:
                try:
                    frames.append(encode_frame(decode_image(bytes(content))))
                    errors.append(None)
                except Exception as e:
                    frames.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"row_id": pdf["row_id"], "frame": frames, "error": errors})

    schema = "row_id long, frame struct<shape:array<int>,dtype:string,data:binary>, error string"
    decoded = stream.read().mapInPandas(run, schema)
    made = catalog.ingest(name, decoded, "row_id", ["frame", "error"], force)
    entry: Entry = catalog.get(name)
    failed = catalog.spark.read.parquet(entry.path).where("error IS NOT NULL").select("row_id", "error")
    if entry.rows and failed.count() == entry.rows:
        catalog.delete(name)
        raise ValueError(f"none of {entry.rows} files could be read")
    entry.types["frame"] = "frame"
    catalog.put(entry)
    return made, failed
