"""Frames as numpy arrays: PNG files, resizing and blurring, without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_COLOUR = {1: 0, 2: 4, 3: 2, 4: 6}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(frame: np.ndarray) -> bytes:
    """A PNG file of a frame with 1 to 4 channels of 8 or 16 bits."""
    frame = frame[:, :, None] if frame.ndim == 2 else frame
    if frame.ndim != 3 or frame.shape[2] not in _COLOUR or frame.dtype not in (np.uint8, np.uint16):
        raise ValueError(f"no PNG of {frame.shape} {frame.dtype}")
    h, w, c = frame.shape
    rows = frame.astype(frame.dtype.newbyteorder(">")).reshape(h, -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8 * frame.dtype.itemsize, _COLOUR[c], 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


#: First column and row, and steps, of the passes of interlaced files.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def _unfiltered(raw: bytes, h: int, size: int, step: int) -> tuple[np.ndarray, int]:
    """h rows of ``size`` bytes, each behind the number of its filter, and the bytes read; ``step`` is that of a pixel."""
    out = np.zeros((h, size), np.uint8)
    above = np.zeros(size, np.uint8)
    if len(raw) < h * (size + 1):
        raise ValueError("the file is cut off")
    for y in range(h):
        kind, line = raw[y * (size + 1)], np.frombuffer(raw, np.uint8, size, y * (size + 1) + 1)
        if kind == 0:
            out[y] = line
        elif kind == 1:
            padded = np.pad(line, (0, -size % step)).reshape(-1, step)
            out[y] = np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[:size]
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            made, up = bytearray(line.tobytes()), above.tolist()
            for i in range(size):
                left, corner = (made[i - step], up[i - step]) if i >= step else (0, 0)
                made[i] = (made[i] + ((left + up[i]) >> 1 if kind == 3 else _paeth(left, up[i], corner))) & 255
            out[y] = np.frombuffer(made, np.uint8)
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[y]
    return out, h * (size + 1)


def _samples(rows: np.ndarray, w: int, depth: int, channels: int) -> np.ndarray:
    """The numbers of unfiltered rows: h x w x channels."""
    if depth == 16:
        return rows.view(">u2").astype(np.uint16).reshape(len(rows), w, channels)
    if depth < 8:
        each = 8 // depth
        shifts = np.arange(each)[::-1] * depth
        rows = ((rows[:, :, None] >> shifts.astype(np.uint8)) & ((1 << depth) - 1)).reshape(len(rows), -1)[:, : w * channels]
    return rows.reshape(len(rows), w, channels)


def decode_png(data: bytes) -> np.ndarray:
    """A frame from a PNG file of any kind: all depths, colours, palettes (with transparency: four channels), filters and
    interlacing. Grey of less than eight bits is spread over them."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, parts, head, palette, alpha = 8, [], None, None, b""
    while at + 8 <= len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = part
        elif kind == b"IDAT":
            parts.append(part)
        at += 12 + n
    if head is None:
        raise ValueError("the file has no header")
    w, h, depth, colour, _, _, interlaced = head
    channels = 1 if colour == 3 else next((c for c, k in _COLOUR.items() if k == colour), 0)
    if not channels or depth not in (1, 2, 4, 8, 16) or colour == 3 and palette is None:
        raise ValueError(f"no PNG of colour {colour} and depth {depth}")
    raw, step = zlib.decompress(b"".join(parts)), max(1, channels * depth // 8)
    out = np.zeros((h, w, channels), np.uint16 if depth == 16 else np.uint8)
    for x0, y0, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        columns, lines = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if columns > 0 and lines > 0:
            rows, used = _unfiltered(raw, lines, (columns * channels * depth + 7) // 8, step)
            out[y0::dy, x0::dx] = _samples(rows, columns, depth, channels)
            raw = raw[used:]
    if colour == 3:
        colours = palette
        if alpha:
            opaque = np.full((len(palette), 1), 255, np.uint8)
            opaque[: len(alpha), 0] = np.frombuffer(alpha, np.uint8)[: len(palette)]
            colours = np.concatenate((palette, opaque), axis=1)
        return colours[out[:, :, 0]]
    return out * np.uint8(255 // ((1 << depth) - 1)) if depth < 8 else out


def decode_pnm(data: bytes) -> np.ndarray:
    """A frame from a binary PGM or PPM file of 8 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("the file is cut off")
        fields.append(data[at:end])
        at = end
    channels, (w, h, most) = {b"P5": 1, b"P6": 3}[fields[0]], map(int, fields[1:])
    if most != 255:
        raise ValueError("only files of eight bits are read")
    return np.frombuffer(data, np.uint8, w * h * channels, at + 1).reshape(h, w, channels)


def decode_image(data: bytes) -> np.ndarray:
    """A frame from a PNG, PGM or PPM file."""
    return decode_pnm(data) if data[:2] in (b"P5", b"P6") else decode_png(data)


def resize(frame: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    h, w = frame.shape[:2]
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    f = frame.reshape(h, w, -1).astype(float)
    out = f[y0][:, x0] * (1 - fy) * (1 - fx) + f[y0][:, x1] * (1 - fy) * fx + f[y1][:, x0] * fy * (1 - fx) + f[y1][:, x1] * fy * fx
    out = np.rint(out) if np.issubdtype(frame.dtype, np.integer) else out
    return out.astype(frame.dtype).reshape((height, width, *frame.shape[2:]))


def blur(frame: np.ndarray, size: int) -> np.ndarray:
    """Means over size x size windows; pixels without a whole window stay 0."""
    h, w = frame.shape[:2]
    left = (size + 1) // 2 - 1
    out = np.zeros_like(frame)
    if h < size or w < size:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(frame.astype(float), (size, size), axis=(0, 1))
    out[left : left + windows.shape[0], left : left + windows.shape[1]] = windows.mean(axis=(-2, -1)).astype(frame.dtype)
    return out


#: Shares of red, green and blue in grey.
_GREY = np.array([0.299, 0.587, 0.114])


def convert(frame: np.ndarray, kind: str) -> np.ndarray:
    """Colours of a frame: ``grey`` (one channel out of three or four), ``rgb`` (three out of one, or without the fourth) or
    ``swap`` (red and blue exchanged)."""
    c = frame.shape[2]
    if kind == "grey":
        if c == 1:
            return frame
        grey = frame[:, :, :3].astype(float) @ _GREY
        return (np.rint(grey) if np.issubdtype(frame.dtype, np.integer) else grey).astype(frame.dtype)[:, :, None]
    if kind == "rgb":
        return np.repeat(frame, 3, axis=2) if c == 1 else frame[:, :, :3]
    if kind == "swap" and c >= 3:
        return np.concatenate((frame[:, :, 2::-1], frame[:, :, 3:]), axis=2)
    raise ValueError(f"no {kind} of {c} channels")


def draw_boxes(frame: np.ndarray, boxes: np.ndarray, colour: tuple[int, ...] = (255, 0, 0), width: int = 1) -> np.ndarray:
    """A copy of a frame with the edges of boxes (x1, y1, x2, y2, ...) in a colour; what lies outside is left out."""
    out, (h, w) = frame.copy(), frame.shape[:2]
    paint = np.asarray(colour[: frame.shape[2]], frame.dtype)
    for x1, y1, x2, y2 in np.rint(np.asarray(boxes, float).reshape(len(boxes), -1)[:, :4]).astype(int):
        for top, bottom, left, right in ((y1, y1 + width, x1, x2 + 1), (y2 - width + 1, y2 + 1, x1, x2 + 1), (y1, y2 + 1, x1, x1 + width), (y1, y2 + 1, x2 - width + 1, x2 + 1)):
            out[max(0, top) : max(0, min(h, bottom)), max(0, left) : max(0, min(w, right))] = paint
    return out


def _box_sums(x: np.ndarray, size: int) -> np.ndarray:
    """Sums over size x size windows around each pixel, edges repeated."""
    half = size // 2
    sums = np.cumsum(np.cumsum(np.pad(x, ((half + 1, half), (half + 1, half)), mode="edge"), axis=0), axis=1)
    return sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]


def optical_flow(before: np.ndarray, after: np.ndarray, size: int = 9) -> np.ndarray:
    """Where the pixels of a frame go: (x, y) offsets as float32, by least squares of brightness changes over windows.

    Windows without texture have offsets near 0. Motions of more than a pixel or two are beyond it.
    """
    a, b = (convert(f, "grey")[:, :, 0].astype(float) for f in (before, after))
    dy, dx = np.gradient((a + b) / 2)
    dt = b - a
    xx, xy, yy, xt, yt = (_box_sums(v, size) for v in (dx * dx, dx * dy, dy * dy, dx * dt, dy * dt))
    xx, yy = xx + 1e-3, yy + 1e-3
    scale = xx * yy - xy * xy
    return np.stack(((xy * yt - yy * xt) / scale, (xy * xt - xx * yt) / scale), axis=2).astype(np.float32)
