"""Operations that come with the engine."""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions import boxes, images, vectors
from rowloom.operators.kernels import register_op
from rowloom.types import Boxes, Floats, Frame


@register_op(name="Histogram", outputs={"ret0": "histogram"})
def frame_histogram(config, frame: Frame):
    """Counts in 16 bins of each of three 8-bit channels."""
    return [np.bincount(frame[:, :, c].ravel() // 16, minlength=16) for c in range(3)]


@register_op(name="VectorHistogram", expression=True)
def vector_histogram(config, vector: Column):
    return vectors.histogram(vector, config.args.get("bins", 16), config.args.get("low", -1.0), config.args.get("high", 1.0))


@register_op(name="Difference", expression=True, stencil=[-1, 0])
def neighbour_difference(config, value):
    """A number less the one before it; 0 in the first row."""
    return value[1] - value[0]


@register_op(name="VectorDifference", expression=True, stencil=[0, 1])
def vector_difference(config, vector):
    """The next vector less this one."""
    return vectors.difference(*vector)


@register_op(name="HistogramDistance", expression=True, stencil=[-1, 0])
def histogram_distance(config, histogram):
    """The largest change of a bin since the row before."""
    return vectors.chebyshev(*histogram)


@register_op(name="Neighbours", expression=True, stencil=[-1, 0, 1])
def neighbours(config, value):
    """The values in the window, as an array."""
    return F.array(*value)


@register_op(name="CloneChannels", expression=True)
def clone_channels(config, vector: Column):
    return vectors.clone_channels(vector, config.args.get("times", 3))


@register_op(name="SlidingMean", expression=True)
def sliding_mean(config, vector: Column):
    return vectors.sliding_mean(vector, config.args.get("width", 3))


@register_op(name="Concat", expression=True)
def concat(config, *value: Column):
    """All inputs as text, joined."""
    return F.concat_ws(config.args.get("separator", " "), *value)


@register_op(name="Sum", expression=True)
def total(config, *value: Column):
    out = value[0]
    for v in value[1:]:
        out = out + v
    return out


@register_op(name="Statistics", expression=True, outputs={"low": "double", "high": "double", "mean": "double"})
def statistics(config, vector: Column):
    """Least, largest and mean element of an array."""
    wide = vector.cast("array<double>")
    return F.array_min(wide), F.array_max(wide), F.aggregate(wide, F.lit(0.0), lambda s, x: s + x) / F.size(wide)


@register_op(name="Resize")
class Resize:
    """Frames resized to a width and height by stream; 0 follows the other by aspect."""

    def __init__(self, config, preserve_aspect: bool = False, minimum: bool = False):
        self.preserve_aspect, self.minimum = preserve_aspect, minimum

    def new_stream(self, width: int, height: int) -> None:
        self.width, self.height = width, height

    def execute(self, frame: Frame) -> Frame:
        h, w = frame.shape[:2]
        to_w = self.width or int(self.height * (w / h))
        to_h = self.height or int(self.width / (w / h))
        if self.preserve_aspect:
            scale = min(to_w / w, to_h / h)
            to_w, to_h = int(w * scale), int(h * scale)
        if self.minimum and w <= to_w and h <= to_h:
            return frame
        return images.resize(frame, max(1, to_w), max(1, to_h))


@register_op(name="Blur")
def blur(config, frame: Frame) -> Frame:
    return images.blur(frame, config.args.get("kernel_size", 3))


@register_op(name="ImageEncoder", outputs={"ret0": "image"})
def image_encoder(config, frame: Frame):
    if config.args.get("format", "png") != "png":
        raise ValueError("only PNG files are made")
    return images.encode_png(frame)


@register_op(name="ImageDecoder")
def image_decoder(config, image: bytes) -> Frame:
    return images.decode_image(image)


@register_op(name="FrameDifference", stencil=[0, 1])
def frame_difference(config, frame: Sequence[Frame]) -> Frame:
    """The next frame less this one, as floats: the place of a motion estimate where no vision library is installed."""
    return frame[1].astype(np.float32) - frame[0].astype(np.float32)


@register_op(name="OpticalFlow", stencil=[0, 1])
def optical_flow(config, frame: Sequence[Frame]) -> Frame:
    """The offsets (x, y) of each pixel from this frame to the next one."""
    return images.optical_flow(frame[0], frame[1], config.args.get("size", 9))


@register_op(name="ConvertColor")
def convert_color(config, frame: Frame) -> Frame:
    return images.convert(frame, config.args.get("to", "grey"))


@register_op(name="DrawBoxes")
def draw_boxes(config, frame: Frame, found: Boxes) -> Frame:
    """A frame with the edges of boxes."""
    return images.draw_boxes(frame, _rows(found), tuple(config.args.get("color", (255, 0, 0))), config.args.get("width", 1))


class _Counter:
    """Rows since the last reset."""

    def __init__(self, config):
        self.n = 0

    def reset(self) -> None:
        self.n = 0

    def execute(self, ignore: float) -> int:
        self.n += 1
        return self.n - 1


register_op(name="CounterBounded", bounded_state=3, accepts_null=True)(type("CounterBounded", (_Counter,), {}))
register_op(name="CounterUnbounded", unbounded_state=True, accepts_null=True)(type("CounterUnbounded", (_Counter,), {}))


@register_op(name="MovingAverage", bounded_state=60)
class MovingAverage:
    """An exponential moving average, the background of a stream of numbers."""

    def __init__(self, config, alpha: float = 0.05):
        self.alpha, self.state = alpha, None

    def reset(self) -> None:
        self.state = None

    def execute(self, value: float) -> float:
        self.state = value if self.state is None else (1 - self.alpha) * self.state + self.alpha * value
        return self.state


@register_op(name="Sleep", accepts_null=True)
def sleep(config, ignore: bytes) -> bytes:
    time.sleep(config.args.get("seconds", 2.0))
    return b"\0"


def _rows(listed: list) -> np.ndarray:
    return np.array([[b["x1"], b["y1"], b["x2"], b["y2"], b["score"]] for b in listed], float).reshape(-1, 5)


def _boxes(rows: np.ndarray) -> list:
    return [{"x1": r[0], "y1": r[1], "x2": r[2], "y2": r[3], "score": r[4], "track_id": None, "track_score": None, "label": None} for r in rows.tolist()]


@register_op(name="BestBoxes", outputs={"ret0": "box_list"})
def best_boxes(config, found: Boxes):
    """The best of each group of overlapping boxes, the best first."""
    return _boxes(boxes.best_nms(_rows(found), config.args.get("overlap", 0.3)))


@register_op(name="AverageBoxes", outputs={"ret0": "box_list"})
def average_boxes(config, found: Boxes):
    """The mean box, weighted by score, of each group of overlapping boxes."""
    return _boxes(boxes.average_nms(_rows(found), config.args.get("overlap", 0.3)))


@register_op(name="SmoothBoxes", stencil=[-1, 0, 1], outputs={"ret0": "box_list"})
def smooth_boxes(config, found: Sequence[Boxes]):
    """Boxes averaged with those of the rows before and after that overlap them most."""
    before, here, after = map(_rows, found)
    return _boxes(boxes.smooth(here, before, after, config.args.get("overlap", 0.5)))


@register_op(name="Overlap", expression=True)
def overlap(config, first: Column, second: Column):
    """Intersection over union of two boxes; 0 where they don't meet."""
    width = F.least(first["x2"], second["x2"]) - F.greatest(first["x1"], second["x1"])
    height = F.least(first["y2"], second["y2"]) - F.greatest(first["y1"], second["y1"])
    area = lambda b: (b["x2"] - b["x1"]).cast("double") * (b["y2"] - b["y1"])
    both = width.cast("double") * height
    return F.when((width > 0) & (height > 0), both / (area(first) + area(second) - both)).otherwise(F.lit(0.0))


@register_op(name="ToFrame")
def to_frame(config, vector: Floats) -> Frame:
    """An array of numbers from -1 to 1 as an 8-bit frame of a width."""
    level = np.clip(np.floor((np.asarray(vector, float) + 1) * 127.5), 0, 255).astype(np.uint8)
    return np.repeat(level.reshape(-1, config.args.get("width", 8), 1), config.args.get("channels", 1), axis=2)


@register_op(name="ToNumbers", outputs={"ret0": "ints"})
def to_numbers(config, frame: Frame):
    """The numbers of a frame row by row."""
    return frame.ravel()


@register_op(name="Widen", expression=True)
def widen(config, vector: Column):
    """An array of numbers as doubles."""
    return vector.cast("array<double>")


@register_op(name="TextLength")
def text_length(config, text: str) -> int:
    return len(text)


@register_op(name="TextLengths", batch=64)
def text_lengths(config, text: Sequence[str]) -> Sequence[int]:
    """Lengths of texts, a batch at a time."""
    return [len(t) for t in text]


@register_op(name="WindowSpread", stencil=[-1, 0, 1], batch=32)
def window_spread(config, value: Sequence[Sequence[float]]) -> Sequence[float]:
    """The largest less the smallest number of each window."""
    return [max(w) - min(w) for w in value]


@register_op(name="AtMost")
def at_most(config, value: float) -> float:
    """The numbers themselves; one above the limit is an error."""
    if value > config.args["limit"]:
        raise ValueError(f"{value} is more than {config.args['limit']}")
    return value
