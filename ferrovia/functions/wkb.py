"""Geometry blobs to coordinates: a GP header (its envelope of 0, 32, 48 or 64 bytes) and WKB points,
lines and multilines in either byte order, as Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType())])
LINE = T.ArrayType(POINT)

#: Bytes of the envelope by the code in bits 1 to 3 of the flags.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def _body(blob: bytes | None) -> bytes | None:
    if blob is None or len(blob) < 8 or blob[:2] != b"GP":
        return None
    size = ENVELOPE.get((blob[3] >> 1) & 7)
    return None if size is None else bytes(blob[8 + size :])


def _head(data: bytes, at: int) -> tuple[str, int, int] | None:
    """(byte order, type, place after)."""
    if len(data) < at + 5:
        return None
    order = "<" if data[at] else ">"
    return order, struct.unpack_from(order + "I", data, at + 1)[0] & 0xFFFF, at + 5


def _line(data: bytes, at: int, order: str) -> tuple[np.ndarray, int]:
    if len(data) < at + 4:
        return np.zeros((0, 2)), len(data)
    n = struct.unpack_from(order + "I", data, at)[0]
    n = min(n, (len(data) - at - 4) // 16)  # a blob that is cut off gives the points that are there
    return np.round(np.frombuffer(data, order + "f8", 2 * n, at + 4), 6).reshape(n, 2).astype(float), at + 4 + 16 * n


def point_of(blob: bytes | None) -> tuple[float, float] | None:
    data = _body(blob)
    head = _head(data, 0) if data else None
    if head is None or head[1] != 1 or len(data) < head[2] + 16:
        return None
    lng, lat = struct.unpack_from(head[0] + "2d", data, head[2])
    return round(lng, 6), round(lat, 6)


def lines_of(blob: bytes | None) -> list[np.ndarray]:
    """The lines of types 2 and 5, an (n, 2) array each; a member that is no line ends them."""
    data = _body(blob)
    head = _head(data, 0) if data else None
    out = []
    if head and head[1] == 2:
        out.append(_line(data, head[2], head[0])[0])
    elif head and head[1] == 5 and len(data) >= head[2] + 4:
        at = head[2] + 4
        for _ in range(struct.unpack_from(head[0] + "I", data, head[2])[0]):
            member = _head(data, at)
            if member is None or member[1] != 2:
                break
            points, at = _line(data, member[2], member[0])
            out.append(points)
    return [line for line in out if len(line)]


def _blobs(geom: pa.Array) -> Iterator[bytes | None]:
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in geom)


@F.arrow_udf(POINT)
def decode_point(geom: pa.Array) -> pa.Array:
    """(lng, lat) of a point; null for anything else."""
    found = [point_of(x) for x in _blobs(geom)]
    xy = [pa.array([None if p is None else p[i] for p in found], pa.float64()) for i in (0, 1)]
    return pa.StructArray.from_arrays(xy, ["lng", "lat"], mask=pa.array([p is None for p in found], pa.bool_()))


@F.arrow_udf(T.ArrayType(LINE))
def decode_lines(geom: pa.Array) -> pa.Array:
    """The lines of each geometry, none for anything else."""
    found = [lines_of(x) for x in _blobs(geom)]
    lines = [line for lines in found for line in lines]
    xy = np.concatenate([np.zeros((0, 2)), *lines])
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["lng", "lat"])
    ends = [np.cumsum([0, *map(len, x)]).astype(np.int32) for x in (lines, found)]
    return pa.ListArray.from_arrays(pa.array(ends[1]), pa.ListArray.from_arrays(pa.array(ends[0]), points))
