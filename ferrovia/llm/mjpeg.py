"""Payloads as motion-JPEG in AVI files, and timed clips of shots.

Each byte of a payload is a grey 8x8 block of a baseline JPEG frame. The DC table gives category c
a code of 13 - c bits and the AC table gives end-of-block 3 bits, so every block takes 16 bits
and a frame of these tables is coded and decoded as an array; a flat block of quantizer 8 decodes exactly. Any
other baseline frame is decoded by its own tables to its luma (see jpeg.py). Frames are found through the RIFF
index; shots begin where the difference of histograms passes an adaptive threshold, and give timed clip rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jpeg import luma

SIDE = 32  # blocks in a row and in a column of a frame
FRAME = SIDE * SIDE
FPS = 25
BINS = 16
#: A shot begins where the difference is above mean + SPREAD deviations of the last WINDOW ones, and above LEAST.
WINDOW, SPREAD, LEAST = 8, 2.0, 0.05
UNIT = 64


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference + 255 to its 16 bits, and back (-999 where no code is)."""
    codes, code = {}, 0
    for category in range(8, -1, -1):  # canonical: 5 bits for 8, one more for each below
        codes[category] = code
        code = (code + 1) << 1
    to_bits = np.zeros(511, np.uint16)
    back = np.full(1 << 16, -999, np.int16)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        bits = d if d > 0 else d + (1 << category) - 1
        to_bits[d + 255] = (codes[category] << category | bits) << 3
        back[to_bits[d + 255]] = d
    return to_bits, back


TO_BITS, FROM_BITS = _tables()
_DC = bytes([0] * 4 + [1] * 9 + [0] * 3) + bytes(range(8, -1, -1))
_AC = bytes([0, 0, 1] + [0] * 13) + b"\0"
HEADER = (
    b"\xff\xd8" + _segment(0xDB, b"\0" + bytes([8] * 64)) + _segment(0xC0, struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + b"\1\x11\0")
    + _segment(0xC4, b"\0" + _DC) + _segment(0xC4, b"\x10" + _AC) + _segment(0xDA, b"\1\1\0\0\x3f\0")
)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """samples: (frames, FRAME) bytes."""
    level = samples.astype(np.int16) - 128
    level[:, 1:] -= level[:, :-1].copy()
    bits = TO_BITS[level + 255].astype(">u2")
    return [HEADER + x.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for x in bits]


def decode_frame(frame: bytes) -> np.ndarray:
    """The luma of an intra frame; of one with the tables of encode_frames, in blocks of 8 x 8, a value for each."""
    if not frame.startswith(HEADER):
        return luma(frame)
    bits = np.frombuffer(frame[len(HEADER) : -2].replace(b"\xff\0", b"\xff"), ">u2")
    differences = FROM_BITS[bits]
    if not frame.endswith(b"\xff\xd9") or len(bits) != FRAME or (differences == -999).any():
        raise ValueError("a frame is damaged")
    return (np.cumsum(differences, dtype=np.int32) + 128).astype(np.uint8).reshape(SIDE, SIDE)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def to_avi(payload: bytes) -> bytes:
    """payload as an AVI file; its length stands in the INFO list."""
    frames = -(-len(payload) // FRAME)
    samples = np.zeros(frames * FRAME, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    coded = encode_frames(samples.reshape(frames, FRAME))
    size = SIDE * 8
    most = max(map(len, coded), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, frames, 0, 1, most, size, size, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, frames, most, 0xFFFFFFFF, 0, 0, 0, size, size)
    strf = struct.pack("<IiiHH4sIiiII", 40, size, size, 1, 24, b"MJPG", size * size * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", str(len(payload)).encode() + b"\0"))
    at, movi, index = 4, [], []
    for x in coded:
        chunk = _chunk(b"00dc", x)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(x)))
        movi.append(chunk)
        at += len(chunk)
    body = b"AVI " + head + info + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _children(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= end:
        kind, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        yield kind, start + 8, start + 8 + size
        start += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[list[np.ndarray], int | None, float]:
    """(luma of the frames in the order of the index, payload length if the INFO list has one, seconds a frame)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    length, movi, index, usec = None, None, None, None
    for kind, a, b in _children(data, 12, len(data)):
        form = data[a : a + 4]
        if kind == b"LIST" and form == b"hdrl":
            usec = next((struct.unpack_from("<I", data, x)[0] for k, x, _ in _children(data, a + 4, b) if k == b"avih"), None)
        elif kind == b"LIST" and form == b"INFO":
            length = next((int(data[x:y].rstrip(b"\0")) for k, x, y in _children(data, a + 4, b) if k == b"ICMT" and data[x:y].rstrip(b"\0").isdigit()), None)
        elif kind == b"LIST" and form == b"movi":
            movi = a
        elif kind == b"idx1":
            index = [struct.unpack_from("<4sIII", data, x) for x in range(a, b - 15, 16)]
    if movi is None or index is None or usec is None:
        raise ValueError("an AVI file without a header, frames or their index")
    frames = []
    for kind, flags, at, size in index:
        if kind[2:] not in (b"dc", b"db") or not flags & 0x10 or not size:
            continue
        start = (movi + at if data[movi + at : movi + at + 4] == kind else at) + 8  # some writers count from the start of the file
        frames.append(decode_frame(data[start : start + size]))
    return frames, length, usec / 1e6


def histograms(frames: list[np.ndarray], length: int | None = None) -> np.ndarray:
    """Shares of BINS grey levels in each frame, of the first `length` values of all if that is given."""
    out = np.zeros((len(frames), BINS))
    if frames and len({x.size for x in frames}) == 1:
        values = np.stack([x.ravel() for x in frames])
        bins = (values >> 4).astype(np.int64) + np.arange(len(frames))[:, None] * BINS
        real = np.arange(values.size).reshape(values.shape) < (values.size if length is None else length)
        out = np.bincount(bins[real], minlength=len(frames) * BINS).reshape(len(frames), BINS).astype(float)
    else:
        for i, x in enumerate(frames):
            out[i] = np.bincount(x.ravel() >> 4, minlength=BINS)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def shots(frames: list[np.ndarray], length: int | None = None) -> list[tuple[int, int]]:
    """First and last frame of each shot. The first difference has none before it: only LEAST decides."""
    n = len(frames)
    if not n:
        return []
    difference = np.abs(np.diff(histograms(frames, length), axis=0)).sum(1) / 2
    starts = [0]
    for i in range(n - 1):
        past = difference[max(0, i - WINDOW) : i]
        if difference[i] > (max(LEAST, past.mean() + SPREAD * past.std()) if i else LEAST):
            starts.append(i + 1)
    return list(zip(starts, [*(s - 1 for s in starts[1:]), n - 1], strict=True))


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_media(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_bytes, media): each whole text as UTF-8, followed by
    zeros up to a positive multiple of 64, as an AVI file. A null text is empty; ids may be null and rows repeat."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(i, 256)
                media = [to_avi(payload_of(x.as_py())) for x in texts]
                sizes = [0 if not x.is_valid else x.as_buffer().size for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


CLIP = pa.struct([("clip", pa.int64()), ("first_frame", pa.int64()), ("last_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())])
DECODED = (
    "doc_id {id}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, frames bigint, "
    "clips array<struct<clip:bigint,first_frame:bigint,last_frame:bigint,start_s:double,end_s:double>>"
)


def decoded(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media) to a row each: what is read back of the payload (null for a file that to_media
    didn't write), of the file, its number of frames and its timed clips, one for each shot."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "clips"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            rows, edges, found = [], [0], []
            for data in batch.column(2):
                data = data.as_buffer().to_pybytes()
                frames, length, step = read_avi(data)
                payload = None if length is None else b"".join(x.tobytes() for x in frames)[:length]
                read = (None, None, None) if payload is None else (length, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]))
                rows.append((*read, len(data), hashlib.sha256(data).hexdigest(), len(frames)))
                found += [(i, a, b, a * step, (b + 1) * step) for i, (a, b) in enumerate(shots(frames, length))]
                edges.append(len(found))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)]
            fields = [pa.array(c, f.type) for c, f in zip(list(zip(*found, strict=True)) or [[]] * CLIP.num_fields, CLIP, strict=True)]
            clips = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, [f.name for f in CLIP]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, clips], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DECODED.format(id=kind))


def clips(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) to timed clips: doc_id, clip, first_frame, last_frame, start_s, end_s."""
    return decoded(media).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) to one row each: the payload as read back, and a feature that sums up its clips."""
    read = decoded(media)
    starts = F.array_join(F.transform("clips", lambda c: c["first_frame"].cast("string")), ",")
    seconds = F.coalesce(F.array_max(F.transform("clips", lambda c: c["end_s"])), F.lit(0.0))
    feature = F.format_string("frames=%d;seconds=%.2f;shots=%d;starts=%s", "frames", seconds, F.size("clips"), starts)
    return read.select(*read.columns[:7], feature.alias("feature"))
