"""Element types: how Python values of a stream map to Spark types, and how registered types are encoded."""

from __future__ import annotations

import pickle
import struct
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import types as T


class NullElement:
    """A missing element of a stream, as opposed to a stored None."""

    def __repr__(self) -> str:
        return "NullElement()"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, NullElement)

    def __hash__(self) -> int:
        return 0


@dataclass(frozen=True)
class ElementType:
    """A named type: its Spark type, and functions between Python values and what Spark stores."""

    name: str
    spark: T.DataType
    encode: Callable[[Any], Any] = lambda v: v
    decode: Callable[[Any], Any] = lambda v: v


_REGISTRY: dict[str, ElementType] = {}
_BY_PYTHON: dict[Any, str] = {}


def register_type(element: ElementType, python: Any = None) -> ElementType:
    """Make a type known by its name and, if given, by the Python annotation that stands for it."""
    if element.name in _REGISTRY:
        raise ValueError(f"type {element.name} is registered already")
    _REGISTRY[element.name] = element
    if python is not None:
        _BY_PYTHON[python] = element.name
    return element


def find_type(wanted: Any) -> ElementType:
    """By name, by annotation, or by a Spark type."""
    if isinstance(wanted, ElementType):
        return wanted
    if isinstance(wanted, T.DataType):
        return ElementType(wanted.simpleString(), wanted)
    name = wanted if isinstance(wanted, str) else _BY_PYTHON.get(wanted)
    if name not in _REGISTRY:
        raise KeyError(f"unknown element type {wanted!r}")
    return _REGISTRY[name]


def variable_list(name: str, inner: Any) -> ElementType:
    """A list of any number of elements."""
    kind = find_type(inner)
    return ElementType(name, T.ArrayType(kind.spark), lambda v: [kind.encode(x) for x in v], lambda v: [kind.decode(x) for x in v])


def uniform_list(name: str, inner: Any, parts: int | None = None, size: int | None = None) -> ElementType:
    """A list of elements of equal size: exactly one of the number of parts and their size is given."""
    if (parts is None) == (size is None):
        raise ValueError("give either parts or size")
    kind = find_type(inner)

    def encode(values: list) -> list:
        out = [kind.encode(x) for x in values]
        if parts is not None and out and len(out) != parts:
            raise ValueError(f"{name} needs {parts} parts, not {len(out)}")
        if size is not None and any(len(x) != size for x in out):
            raise ValueError(f"{name} needs elements of size {size}")
        return out

    return ElementType(name, T.ArrayType(kind.spark), encode, lambda v: [kind.decode(x) for x in v])


#: A frame: height, width and channels, the name of the number type, and the numbers row by row.
FRAME = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("dtype", T.StringType()), T.StructField("data", T.BinaryType())])
FRAME_DTYPES = {"uint8", "uint16", "float32", "float64"}
BOX = T.StructType([
    T.StructField("x1", T.FloatType()), T.StructField("y1", T.FloatType()), T.StructField("x2", T.FloatType()), T.StructField("y2", T.FloatType()),
    T.StructField("score", T.FloatType()), T.StructField("track_id", T.IntegerType()), T.StructField("track_score", T.DoubleType()), T.StructField("label", T.IntegerType()),
])
POINT = T.StructType([T.StructField("x", T.FloatType()), T.StructField("y", T.FloatType()), T.StructField("score", T.FloatType())])


class Frame:
    """Annotation for frames, which kernels see as numpy arrays."""


class Boxes:
    """Annotation for lists of boxes, which kernels see as dicts."""


class Floats:
    """Annotation for arrays of floats."""


def encode_frame(value: np.ndarray) -> dict:
    value = np.asarray(value)
    if value.ndim > 3 or str(value.dtype) not in FRAME_DTYPES:
        raise ValueError(f"no frame: {value.ndim} dimensions of {value.dtype}")
    return {"shape": list(value.shape), "dtype": str(value.dtype), "data": np.ascontiguousarray(value).tobytes()}


def decode_frame(value: Any) -> np.ndarray:
    get = value.get if isinstance(value, dict) else value.__getitem__
    return np.frombuffer(bytes(get("data")), get("dtype")).reshape(list(get("shape")))


BYTES = register_type(ElementType("bytes", T.BinaryType(), bytes, bytes), bytes)
ANY = register_type(ElementType("any", T.BinaryType(), pickle.dumps, lambda v: pickle.loads(bytes(v))), Any)
FRAME_TYPE = register_type(ElementType("frame", FRAME, encode_frame, decode_frame), Frame)
LONG = register_type(ElementType("long", T.LongType(), int, int), int)
DOUBLE = register_type(ElementType("double", T.DoubleType(), float, float), float)
STRING = register_type(ElementType("string", T.StringType()), str)
BOOLEAN = register_type(ElementType("boolean", T.BooleanType(), bool, bool), bool)
BOX_TYPE = register_type(ElementType("box", BOX))
BOX_LIST = register_type(variable_list("box_list", "box"), Boxes)
POINT_TYPE = register_type(ElementType("point", POINT))
FLOATS = register_type(ElementType("floats", T.ArrayType(T.FloatType()), lambda v: np.asarray(v, np.float32).tolist(), lambda v: np.asarray(v, np.float32)), Floats)
INTS = register_type(ElementType("ints", T.ArrayType(T.IntegerType()), lambda v: np.asarray(v, np.int32).tolist(), lambda v: np.asarray(v, np.int32)))
HISTOGRAM = register_type(uniform_list("histogram", "ints", parts=3))
IMAGE = register_type(ElementType("image", T.BinaryType(), bytes, bytes))


def pack_rows(values: list[bytes]) -> bytes:
    """Values as one block: their number, their sizes (64-bit little-endian each), and their bytes."""
    return struct.pack(f"<{len(values) + 1}Q", len(values), *map(len, values)) + b"".join(values)


def unpack_rows(block: bytes) -> list[bytes]:
    """The values of a block made by pack_rows."""
    (n,) = struct.unpack_from("<Q", block)
    sizes = struct.unpack_from(f"<{n}Q", block, 8)
    out, at = [], 8 * (n + 1)
    for size in sizes:
        out.append(block[at : at + size])
        at += size
    return out
