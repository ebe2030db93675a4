"""Image and video files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from test_engine import client  # noqa: F401

from rowloom.functions import images, video
from rowloom.sources.videos import NamedVideoStream, VideoFileStream, encoded_mp4, ingest_videos, video_metadata


def clip(n=6, h=9, w=13, seed=1):
    return list(np.random.default_rng(seed).integers(0, 256, (n, h, w, 3)).astype(np.uint8))


def filtered_png(frame, depth, colour, interlaced=False, palette=b"", alpha=b""):
    """A PNG file whose rows go through all filters in turn; ``frame`` holds samples h x w x channels."""
    h, w, c = frame.shape
    step = max(1, c * depth // 8)

    def packed(rows):
        if depth == 16:
            return [r.astype(">u2").tobytes() for r in rows]
        if depth == 8:
            return [r.astype(np.uint8).tobytes() for r in rows]
        bits = [np.unpackbits(r.astype(np.uint8).reshape(-1, 1), axis=1)[:, 8 - depth :].ravel() for r in rows]
        return [np.packbits(b).tobytes() for b in bits]

    def body(part):
        out, above = b"", b""
        for y, line in enumerate(packed(part.reshape(len(part), -1))):
            above, kind, made = above or bytes(len(line)), y % 5, bytearray()
            for i, v in enumerate(line):
                a, b, k = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                p = a + b - k
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - k), 2, k))[2]
                made.append((v - (0, a, b, (a + b) // 2, near)[kind]) & 255)
            out, above = out + bytes((kind,)) + bytes(made), line
        return out

    passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if interlaced else ((0, 0, 1, 1),)
    raw = b"".join(body(frame[y::dy, x::dx]) for x, y, dx, dy in passes if frame[y::dy, x::dx].size)
    chunk = lambda k, v: struct.pack(">I", len(v)) + k + v + struct.pack(">I", zlib.crc32(k + v))
    more = (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"tRNS", alpha) if alpha else b"")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)) + more + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("depth, colour, channels", [(1, 0, 1), (2, 0, 1), (4, 0, 1), (8, 0, 1), (16, 0, 1), (8, 2, 3), (16, 2, 3), (8, 4, 2), (8, 6, 4), (16, 6, 4)])
def test_png_files_of_all_kinds(depth, colour, channels, interlaced):
    rng = np.random.default_rng(depth + colour)
    for h, w in ((11, 13), (1, 1), (3, 2)):
        frame = rng.integers(0, 1 << depth, (h, w, channels))
        got = images.decode_png(filtered_png(frame, depth, colour, interlaced))
        assert (got == frame * (255 // ((1 << depth) - 1) if depth < 8 else 1)).all() and got.dtype == (np.uint16 if depth == 16 else np.uint8)


def test_palettes_and_other_images():
    rng = np.random.default_rng(2)
    colours = rng.integers(0, 256, (16, 3)).astype(np.uint8)
    at = rng.integers(0, 16, (7, 5, 1))
    assert (images.decode_png(filtered_png(at, 4, 3, palette=colours.tobytes())) == colours[at[:, :, 0]]).all()
    assert (images.decode_png(filtered_png(at, 8, 3, palette=colours.tobytes(), alpha=b"\x07"))[:, :, 3] == np.where(at[:, :, 0] == 0, 7, 255)).all()
    frame = clip(1)[0]
    assert (images.decode_image(b"P6\n# made\n13 9\n255\n" + frame.tobytes()) == frame).all()
    for bad in (b"no", images.encode_png(frame)[:40], b"P6 4 4 255 x", filtered_png(at, 4, 3)):
        with pytest.raises((ValueError, zlib.error)):
            images.decode_image(bad)


def y4m(frames, chroma):
    h, w = frames[0].shape[:2]
    planes = {"mono": 0, "444": 2 * h * w, "420": 2 * ((h + 1) // 2) * ((w + 1) // 2)}[chroma]
    return f"YUV4MPEG2 W{w} H{h} F30:1 C{chroma}\n".encode() + b"".join(b"FRAME\n" + f[:, :, 0].tobytes() + b"\x80" * planes for f in frames)


def test_mp4_and_y4m_files():
    frames = clip()
    data = encoded_mp4(frames, 30.0)
    index = video.index_video(data)
    assert (index.codec, index.width, index.height, len(index), index.keyframes) == ("png", 13, 9, 6, list(range(6))) and abs(index.fps - 30) < 1e-9
    assert all((a == b).all() for a, b in zip(video.decode_frames(index, data), frames))
    for chroma in ("mono", "444", "420"):
        data = y4m(frames, chroma)
        made = list(video.decode_frames(video.index_video(data), data))
        grey = np.rint(np.clip((frames[0][:, :, 0].astype(float) - 16) * 255 / 219, 0, 255))
        assert len(made) == 6 and (made[0][:, :, 0] == (frames[0][:, :, 0] if chroma == "mono" else grey)).all()
    for bad in (b"", b"nothing", data[:-3], encoded_mp4(frames)[:-30]):
        with pytest.raises((ValueError, struct.error)):
            video.index_video(bad)


def test_ingest_key_frames_and_export(spark, client, tmp_path):  # noqa: F811
    frames = clip()
    files = {"a.mp4": encoded_mp4(frames, 30.0), "b.y4m": y4m(frames, "444"), "broken.mp4": encoded_mp4(frames)[:200], "h264.mp4": encoded_mp4(frames).replace(b"mp4v", b"avc1")}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    path = lambda n: str(tmp_path / n)
    tables, failed = ingest_videos(client.catalog, [("a", path("a.mp4")), ("bad", path("broken.mp4")), ("b", path("b.y4m")), ("c", path("h264.mp4"))])
    assert [t.name for t in tables] == ["a", "b"] and [p for p, _ in failed] == [path("broken.mp4"), path("h264.mp4")] and "avc1" in failed[1][1]
    assert client.table("a").parent_rows() == list(range(6)) and client.table("a").columns() == ["index", "frame", "keyframe"]
    a = NamedVideoStream(client.catalog, "a")
    assert a.length() == 6 and a.keyframes() == list(range(6)) and all((x == y).all() for x, y in zip(a.load(), frames))
    assert video_metadata(client.catalog, ["a", "b", "none"]) == [{"name": "a", "rows": 6, "codec": "png", "width": 13, "height": 9, "fps": 30.0}, {"name": "b", "rows": 6, "codec": "y4m-444", "width": 13, "height": 9, "fps": 30.0}]
    with pytest.raises(ValueError):
        ingest_videos(client.catalog, [("a", path("a.mp4"))])
    with pytest.raises(ValueError):
        ingest_videos(client.catalog, [("d", path("broken.mp4"))])
    client.run(client.io.Output(client.ops.Histogram(frame=client.streams.Stride(client.io.Input([a]), [2])), [client.stream("counts")]))
    assert [np.array(h).sum() for h in client.stream("counts").load()] == [3 * 9 * 13] * 3
    assert a.save_mp4(path("out.mp4")) == 6
    inplace = VideoFileStream(spark, path("out.mp4"))
    assert inplace.length() == 6 and inplace.keyframes() == list(range(6))
    assert all((np.frombuffer(bytes(r["column"]["data"]), np.uint8).reshape(9, 13, 3) == f).all() for r, f in zip(inplace.read().orderBy("row_id").collect(), frames))
    assert NamedVideoStream(client.catalog, "again", path("out.mp4")).metadata()["fps"] == 30.0


def test_colours_boxes_and_flow():
    rng = np.random.default_rng(4)
    frame = clip(1)[0]
    assert images.convert(frame, "grey")[2, 3, 0] == round(float(frame[2, 3] @ np.array([0.299, 0.587, 0.114])))
    assert (images.convert(images.convert(frame, "swap"), "swap") == frame).all() and images.convert(images.convert(frame, "grey"), "rgb").shape == frame.shape
    with pytest.raises(ValueError):
        images.convert(frame, "none")
    drawn = images.draw_boxes(frame, [[2, 1, 6, 5, 0.9], [-5, -5, 50, 50, 0.1], [90, 90, 99, 99, 1]])
    edge = np.zeros(frame.shape[:2], bool)
    edge[1, 2:7] = edge[5, 2:7] = edge[1:6, 2] = edge[1:6, 6] = True
    assert (drawn[edge] == (255, 0, 0)).all() and (drawn[~edge] == frame[~edge]).all()
    y, x = np.mgrid[:48, :64].astype(float)
    phase = rng.uniform(0, 6, 6)
    scene = lambda dx, dy: sum(np.sin((x - dx) * k * 0.09 + p) * np.cos((y - dy) * k * 0.07 + p) for k, p in enumerate(phase, 1))[:, :, None] * 20 + 100
    flow = images.optical_flow(scene(0, 0), scene(0.6, -0.4))
    assert flow.shape == (48, 64, 2) and np.abs(flow[8:-8, 8:-8] - (0.6, -0.4)).mean() < 0.05


def test_boxes_on_frames(spark, client):  # noqa: F811
    from rowloom.sources.catalog import StreamBatch

    frames = clip(3)
    box = lambda x: {"x1": x, "y1": 1.0, "x2": x + 3, "y2": 5.0, "score": 0.5, "track_id": None, "track_score": None, "label": None}
    from rowloom.types import BOX, FRAME, encode_frame

    rows = [(0, i, encode_frame(f), [box(float(i))]) for i, f in enumerate(frames)]
    df = spark.createDataFrame(rows, f"s int, i long, frame {FRAME.simpleString()}, boxes array<{BOX.simpleString()}>")
    frame, found = client.io.columns(StreamBatch(df, "s", "i", ["frame", "boxes"]))
    grey = client.ops.ConvertColor(frame=client.ops.DrawBoxes(frame=frame, found=found, color=(9, 9, 9)), to="grey")
    client.run([client.io.Output(grey, [client.stream("drawn")]), client.io.Output(client.ops.OpticalFlow(frame=frame), [client.stream("flow")])])
    drawn = list(client.stream("drawn").load())
    assert all((d[1, i : i + 4] == 9).all() for i, d in enumerate(drawn)) and [f.shape for f in client.stream("flow").load()] == [(9, 13, 2)] * 3


def test_streams_of_one_job_are_one_scan(spark, client):  # noqa: F811
    from test_engine import numbers, values

    x = client.io.Input([numbers(spark, n) for n in (4, 0, 7, 5)])
    client.run(client.io.Output(x, [client.stream(f"t{i}") for i in range(4)]))
    for order in ([0, 1, 2, 3], [3, 0, 2]):
        df = client.frame(client.io.Input([client.stream(f"t{i}") for i in order]))
        got = {i: [] for i in range(len(order))}
        for r in df.orderBy("stream_id", "row_id").collect():
            got[r["stream_id"]].append(r["value"])
        assert [got[i] for i in range(len(order))] == [list(range((4, 0, 7, 5)[k])) for k in order]
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert values(client.frame(client.io.Input([client.stream("t2")]))) == list(range(7))
