"""What the operators of this package share: session set-up, word splitting and cutting lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of anything but these: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Spark's setting by which the shuffle files of a query go when it is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Least time between two runs of the garbage collectors.
RELEASE_SECONDS = 3.0
_released = 0.0
_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure that there is a checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own.
    """
    context = spark.sparkContext
    path = context.environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(":"):
        context.environment["PYTHONPATH"] = f"{_ROOT}:{path}" if path else _ROOT
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="rowloom-")
        context.setCheckpointDir(folder)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: short lineage that outlives executors.

    The shuffle files that it took are deleted as soon as it is written, whenever the garbage collectors run.
    """
    spark = prepare(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df = df.select("*")  # a frame keeps the setting that it was made under
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    written = df.checkpoint(eager=True)
    del df
    release(spark)
    return written


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle and checkpoint files of frames that nothing refers to any more.

    It learns of them from the garbage collectors of Python and the driver, which else run too seldom for large files.
    Small tables follow each other fast, so the collectors run once in a few seconds.
    """
    global _released
    if time.monotonic() - _released < RELEASE_SECONDS:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _released = time.monotonic()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a new folder beside the checkpoints, and read it from there."""
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the folder of a table that stored() has written, once nothing reads it any more."""
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("stored-") and folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame) -> DataFrame:
    """The same with each text, in the last column as binary, compressed, since it is about to be shuffled."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = pa.array([None if t is None else pack(t) for t in batch.column(len(names) - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names)

    return df.mapInArrow(run, df.schema)


def unpacked(column: pa.Array) -> Iterator[bytes | None]:
    unpack = zstandard.ZstdDecompressor().decompress
    for value in column:
        text = value.as_py()
        yield None if text is None else unpack(text)


def words(text: str | bytes | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() splits at exactly the six ASCII white-space characters."""
    if text is None:
        return []
    return (text.encode("utf-8") if isinstance(text, str) else text).split()


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables of a folder."""
    prepare(spark)
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]
