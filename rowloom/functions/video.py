"""Video files without a codec library: MP4 files are indexed whatever their codec, and written with PNG frames; PNG frames
and Y4M files are decoded. Other codecs need a decoder registered by the caller."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from rowloom.functions.images import decode_png

#: Boxes that hold boxes.
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}
#: The object type of PNG in an elementary stream descriptor.
_PNG_OBJECT = 0x6D


@dataclass
class VideoIndex:
    """Where the frames of a file are, and which of them can be decoded by themselves."""

    codec: str
    width: int
    height: int
    fps: float
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    keyframes: list[int] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.sizes)


#: Decoders by codec: from the file's index and the bytes of one frame after the other to frames.
DECODERS: dict[str, Callable[[VideoIndex, Iterator[bytes]], Iterator[np.ndarray]]] = {}


def register_decoder(codec: str, decode: Callable[[VideoIndex, Iterator[bytes]], Iterator[np.ndarray]]) -> None:
    """Decode frames of a codec, named as in the file (avc1, hev1, ...), with a function. Frames come in stored order."""
    DECODERS[codec] = decode


def _boxes(data: bytes, at: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of the contents of all boxes."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError("the file is cut off")
        yield (*path, kind), at + head, at + size
        if kind in _NESTED:
            yield from _boxes(data, at + head, at + size, (*path, kind))
        at += size


def _table(data: bytes, at: int, fields: int, kind: str = "I") -> list[tuple[int, ...]]:
    """Rows of a full box that holds their number and then numbers."""
    (n,) = struct.unpack_from(">I", data, at + 4)
    size = struct.calcsize(f">{kind * fields}")
    if at + 8 + n * size > len(data):
        raise ValueError("the file is cut off")
    return [struct.unpack_from(f">{kind * fields}", data, at + 8 + i * size) for i in range(n)]


def _mp4_codec(data: bytes, start: int, end: int) -> tuple[str, int, int]:
    """Codec, width and height from a sample description."""
    (size, kind) = struct.unpack_from(">I4s", data, start + 8)
    width, height = struct.unpack_from(">HH", data, start + 8 + 32)
    codec = kind.decode("latin-1").strip()
    if codec == "mp4v" and (at := data.find(b"esds", start, min(end, start + 8 + size))) >= 0:
        at += 8
        while at < end and data[at] in (3, 4):  # descriptors: tag, length in groups of seven bits, contents
            tag, at = data[at], at + 1
            while data[at] & 0x80:
                at += 1
            at += 1
            if tag == 4:
                return ("png" if data[at] == _PNG_OBJECT else codec), width, height
            at += 3
    return codec, width, height


def index_mp4(data: bytes) -> VideoIndex:
    """The index of the first video track of an MP4 or QuickTime file."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, start, end in _boxes(data, 0, len(data)):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak") and tracks:
            tracks[-1].setdefault(path[-1], (start, end))
    track = next((t for t in tracks if b"hdlr" in t and data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12] == b"vide"), None)
    if track is None or not {b"stsd", b"stts", b"stsc", b"stsz", b"mdhd"} <= set(track) or not {b"stco", b"co64"} & set(track):
        raise ValueError("the file has no video track")
    codec, width, height = _mp4_codec(data, *track[b"stsd"])
    at = track[b"mdhd"][0]
    (scale,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
    durations = _table(data, track[b"stts"][0], 2)
    ticks = sum(n * d for n, d in durations)
    at = track[b"stsz"][0]
    same, n = struct.unpack_from(">II", data, at + 4)
    sizes = [same] * n if same else [s for (s,) in _table(data, at + 4, 1)]
    chunks = [c for (c,) in (_table(data, track[b"co64"][0], 1, "Q") if b"co64" in track else _table(data, track[b"stco"][0], 1))]
    runs = _table(data, track[b"stsc"][0], 3)
    offsets: list[int] = []
    for i, (first, count, _) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunks)
        for chunk in chunks[first - 1 : last]:
            for _ in range(count):
                if len(offsets) < n:
                    offsets.append(chunk)
                    chunk += sizes[len(offsets) - 1]
    if len(offsets) != n or any(o + s > len(data) for o, s in zip(offsets, sizes)):
        raise ValueError("the file is cut off")
    keyframes = [k - 1 for (k,) in _table(data, track[b"stss"][0], 1)] if b"stss" in track else list(range(n))
    return VideoIndex(codec, width, height, n * scale / ticks if ticks else 0.0, offsets, sizes, keyframes)


def index_y4m(data: bytes) -> VideoIndex:
    """The index of a YUV4MPEG2 file of eight bits."""
    end = data.find(b"\n")
    fields = {f[:1]: f[1:].decode() for f in data[:end].split(b" ")[1:] if f}
    w, h = int(fields.get(b"W", 0)), int(fields.get(b"H", 0))
    chroma = fields.get(b"C", "420")
    if not w or not h or not (chroma.startswith("420") or chroma in ("444", "422", "mono")) or "p1" in chroma:
        raise ValueError(f"no Y4M of {w} x {h} and chroma {chroma}")
    half = lambda x: (x + 1) // 2
    size = w * h + {"4": 2 * half(w) * half(h) if chroma.startswith("420") else 2 * half(w) * h if chroma == "422" else 2 * w * h, "m": 0}[chroma[0]]
    top, _, bottom = fields.get(b"F", "25:1").partition(":")
    found = VideoIndex(f"y4m-{chroma}", w, h, int(top) / max(1, int(bottom or 1)))
    at = end + 1
    while at < len(data):
        if data[at : at + 5] != b"FRAME":
            raise ValueError("a frame has no head")
        at = data.index(b"\n", at) + 1
        if at + size > len(data):
            raise ValueError("the file is cut off")
        found.offsets.append(at)
        found.sizes.append(size)
        at += size
    found.keyframes = list(range(len(found)))
    return found


def index_video(data: bytes) -> VideoIndex:
    """The index of a file, by its first bytes."""
    if data[:10] == b"YUV4MPEG2 ":
        return index_y4m(data)
    if data[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide", b"skip"):
        return index_mp4(data)
    raise ValueError("no MP4 or Y4M file")


def _y4m_frame(index: VideoIndex, part: bytes) -> np.ndarray:
    w, h, chroma = index.width, index.height, index.codec[4:]
    y = np.frombuffer(part, np.uint8, w * h).reshape(h, w)
    if chroma == "mono":
        return np.repeat(y[:, :, None], 3, axis=2)
    cw, ch = (w if chroma == "444" else (w + 1) // 2), ((h + 1) // 2 if chroma.startswith("420") else h)
    planes = np.frombuffer(part, np.uint8, 2 * cw * ch, w * h).reshape(2, ch, cw)
    u, v = (p.repeat(-(-h // ch), axis=0).repeat(-(-w // cw), axis=1)[:h, :w].astype(float) - 128 for p in planes)
    luma = (y.astype(float) - 16) * (255 / 219)
    red, blue = luma + 1.402 * (255 / 224) * v, luma + 1.772 * (255 / 224) * u
    green = luma - (0.299 * 1.402 * v + 0.114 * 1.772 * u) * (255 / 224) / 0.587
    return np.clip(np.rint(np.stack((red, green, blue), axis=2)), 0, 255).astype(np.uint8)


def decode_frames(index: VideoIndex, data: bytes) -> Iterator[np.ndarray]:
    """The frames of a file in order."""
    parts = (data[o : o + s] for o, s in zip(index.offsets, index.sizes))
    if index.codec in DECODERS:
        yield from DECODERS[index.codec](index, parts)
    elif index.codec.startswith("y4m-"):
        yield from (_y4m_frame(index, p) for p in parts)
    elif index.codec == "png":
        yield from map(decode_png, parts)
    else:
        raise ValueError(f"there is no decoder of {index.codec}; register one")


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write_mp4(target: Any, frames: Iterator[bytes], width: int, height: int, fps: float = 25.0) -> int:
    """An MP4 file of PNG files of one size, written in order to a seekable file; the number of frames."""
    target.write(_box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42"))
    head = target.tell()
    target.write(struct.pack(">I4sQ", 1, b"mdat", 0))
    sizes: list[int] = []
    for part in frames:
        target.write(part)
        sizes.append(len(part))
    end = target.tell()
    target.seek(head + 8)
    target.write(struct.pack(">Q", end - head))
    target.seek(end)
    n, scale = len(sizes), round(fps * 1000)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    decoder = bytes((_PNG_OBJECT, 0x11)) + bytes(3 + 4 + 4)
    stream = b"\x00\x01\x00" + bytes((4, len(decoder))) + decoder + bytes((6, 1, 2))
    entry = _box(b"mp4v", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", width, height), struct.pack(">III", 0x480000, 0x480000, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 24, -1), _full(b"esds", bytes((3, len(stream))), stream))
    table = _box(
        b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, 1000)), _full(b"stsc", struct.pack(">IIII", 1, 1, max(1, n), 1)),
        _full(b"stsz", struct.pack(">II", 0, n), struct.pack(f">{n}I", *sizes)), _full(b"co64", struct.pack(">IQ", 1, head + 16)),
    )
    media = _box(
        b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, scale, n * 1000, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
        _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
    )
    track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * 1000), bytes(16), matrix, struct.pack(">II", width << 16, height << 16), flags=3), media)
    movie = _full(b"mvhd", struct.pack(">IIII", 0, 0, scale, n * 1000), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    target.write(_box(b"moov", movie, track))
    return n
