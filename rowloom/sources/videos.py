"""Video streams: ingest of files, key frames, metadata, and export."""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import video
from rowloom.functions.images import encode_png
from rowloom.session import importable
from rowloom.sources.catalog import Catalog, NamedStream, StoredStream, Table
from rowloom.sources.files import FilesStream
from rowloom.types import FRAME, decode_frame, encode_frame

_SCHEMA = f"video long, row_id long, frame {FRAME.simpleString()}, keyframe boolean, codec string, width int, height int, fps double, error string"


def _frames(files: DataFrame, decode: bool) -> DataFrame:
    """A row for every frame of files (row_id: number of the file, column: bytes), and one with the error of a file that
    can't be read. Without ``decode`` frames are null."""
    decoders = dict(video.DECODERS)

    def rows(number: int, data: bytes) -> Iterator[dict[str, Any]]:
        at = 0
        try:
            index = video.index_video(data)
            head = {"video": number, "codec": index.codec, "width": index.width, "height": index.height, "fps": index.fps, "error": None}
            keys = set(index.keyframes)
            if not len(index):
                raise ValueError("the file has no frames")
            made = video.decode_frames(index, data) if decode else (None for _ in range(len(index)))
            for at, frame in enumerate(made):
                yield head | {"row_id": at, "frame": None if frame is None else encode_frame(frame), "keyframe": at in keys}
        except Exception as e:  # a file that can't be read is reported; the others are read
            yield {"video": number, "row_id": at, "frame": None, "keyframe": None, "codec": None, "width": None, "height": None, "fps": None, "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video.DECODERS.update(decoders)
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[dict[str, Any]] = []
                for row in rows(number, data):
                    held.append(row)
                    if len(held) == 64:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    frame = pa.struct([("shape", pa.list_(pa.field("element", pa.int32()))), ("dtype", pa.string()), ("data", pa.binary())])
    schema = pa.schema([("video", pa.int64()), ("row_id", pa.int64()), ("frame", frame), ("keyframe", pa.bool_()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("fps", pa.float64()), ("error", pa.string())])
    return files.select("row_id", "column").mapInArrow(run, _SCHEMA)


def ingest_videos(catalog: Catalog, videos: list[tuple[str, str]], force: bool = False) -> tuple[list[Table], list[tuple[str, str]]]:
    """Frame streams (columns index, frame, keyframe) out of (name, path) of video files, and (path, error) of those that
    can't be read. It is an error if a name is given twice or taken, unless forced, or if no file can be read."""
    names = [n for n, _ in videos]
    if len(set(names)) < len(names):
        raise ValueError("a name is given twice")
    if taken := [n for n in names if catalog.has(n)]:
        if not force:
            raise ValueError(f"stream {taken[0]} exists")
        catalog.delete(taken)
    spark = importable(catalog.spark)
    root = catalog.new_folder()
    _frames(FilesStream(spark, [p for _, p in videos]).read(), True).withColumn("index", F.col("row_id")).write.partitionBy("video").parquet(root)
    written = spark.read.parquet(root)
    errors = {r["video"]: r["e"] for r in written.where("error IS NOT NULL").groupBy("video").agg(F.min("error").alias("e")).collect()}
    known = {r["video"]: r for r in written.where("error IS NULL").groupBy("video").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("codec", "width", "height", "fps"))).collect()}
    for i in range(len(videos)):
        if i not in known and i not in errors:
            errors[i] = "FileNotFoundError: no such file"
    failed = [(videos[i][1], e) for i, e in sorted(errors.items())]
    if len(failed) == len(videos):
        catalog.remove(root)
        raise ValueError(f"no video could be read: {failed}")
    tables = []
    for i, (name, _) in enumerate(videos):
        if i not in errors:
            told = {c: known[i][c] for c in ("codec", "width", "height", "fps")}
            catalog.put_new(name, f"{root}/video={i}", {"index": "bigint", "frame": FRAME.simpleString(), "keyframe": "boolean"}, {"frame": "frame"}, known[i]["n"], told)
            tables.append(Table(catalog, name))
    return tables, failed


def video_metadata(catalog: Catalog, names: list[str]) -> list[dict[str, Any]]:
    """Codec, size, frame rate and rows of many video streams; names that aren't those of videos are left out."""
    found = [catalog.get(n) for n in names]
    return [{"name": e.name, "rows": e.rows, **e.video} for e in found if e is not None and e.video]


def export_mp4(frames: StoredStream, path: str, fps: float | None = None) -> int:
    """Write the frames of a stream, in order, as an MP4 file of PNG frames, compressed by the executors; their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode_png(decode_frame(f)) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["row_id", "png"])

    df = frames.read().where("column IS NOT NULL")
    first = df.orderBy("row_id").select("column.shape").first()
    if first is None:
        raise ValueError("the stream has no frames")
    height, width = first["shape"][:2]
    rows = df.select("row_id", "column").mapInArrow(run, "row_id long, png binary").orderBy("row_id").toLocalIterator()
    with open(path, "wb") as f:
        return video.write_mp4(f, (bytes(r["png"]) for r in rows), width, height, fps or 25.0)


class VideoFileStream(StoredStream):
    """The frames of a video file, read where it is."""

    def __init__(self, spark: Any, path: str):
        self.spark, self.path = importable(spark), path

    def _rows(self, decode: bool) -> DataFrame:
        return _frames(FilesStream(self.spark, [self.path]).read(), decode)

    def length(self) -> int:
        found = self._rows(False).agg(F.count("*"), F.min("error")).first()
        if found[1] or not found[0]:
            raise ValueError(f"{self.path}: {found[1] or 'no such file'}")
        return found[0]

    def read(self) -> DataFrame:
        df = self._rows(True)
        broken = F.raise_error(F.concat(F.lit(f"{self.path}: "), "error")).cast(FRAME)
        return df.select("row_id", F.when(F.col("error").isNull(), F.col("frame")).otherwise(broken).alias("column"))

    def keyframes(self) -> list[int]:
        return [r["row_id"] for r in self._rows(False).where("keyframe").orderBy("row_id").select("row_id").toLocalIterator()]

    def save_mp4(self, path: str, fps: float | None = None) -> int:
        return export_mp4(self, path, fps)


class NamedVideoStream(NamedStream):
    """A video in the catalog; with ``path`` its file is ingested if the name isn't taken."""

    def __init__(self, catalog: Catalog, name: str, path: str | None = None):
        super().__init__(catalog, name, "frame")
        if path is not None and not catalog.has(name):
            ingest_videos(catalog, [(name, path)])

    def keyframes(self) -> list[int]:
        """Rows that can be decoded by themselves; all rows of a stream that is no ingested video."""
        df = self.catalog.spark.read.parquet(self._entry().path)
        df = df.where("keyframe") if "keyframe" in df.columns else df
        return [r["row_id"] for r in df.select("row_id").orderBy("row_id").toLocalIterator()]

    def metadata(self) -> dict[str, Any]:
        return dict(self._entry().video)

    def save_mp4(self, path: str, fps: float | None = None) -> int:
        return export_mp4(self, path, fps or self.metadata().get("fps"))


def encoded_mp4(frames: list[Any], fps: float = 25.0) -> bytes:
    """An MP4 file of frames in memory."""
    out = io.BytesIO()
    write = [encode_png(f) for f in frames]
    video.write_mp4(out, iter(write), frames[0].shape[1], frames[0].shape[0], fps)
    return out.getvalue()
