"""Words and hashes of many texts at once, from the bytes of an Arrow string column.

A word is a run of bytes other than space and \\x09 to \\x0D. It is hashed 8 bytes at a time to 64
bits; a run of words is hashed from the hashes of its words. Different words are told apart by that
hash alone: among n of them two collide with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; a longer text is worked on alone.
SLICE = 1 << 20

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Segments of more bytes than this are hashed by BLAKE2b, one by one.
LONG = 128
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = _STEP * np.arange(2, LONG // 8 + 2, dtype=np.uint64)


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair.

    The length, then every 8 bytes, are mixed in by exclusive or and scrambled. It is no polynomial, for
    which long words such as those of Thue and Morse collide; of one length, segments of up to 8 bytes never do.
    """
    rest = (ends - starts).astype(np.int64)
    out = scramble(rest.astype(np.uint64) * _STEP + np.uint64(1))
    if not len(rest):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    loads = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    live, at = np.flatnonzero(rest <= LONG), starts
    if len(live) < len(rest):
        for i in np.flatnonzero(rest > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8).digest(), "little")
        rest, at = rest[live], at[live]
    whole, h = len(live) == len(out), out[live]
    places = live
    for i in range(LONG // 8):
        if i:
            more = np.flatnonzero(rest > 8 * i)
            if not len(more):
                break
            rest, at, places = rest[more], at[more], places[more]
            h = out[places]
        chunk = loads[at + 8 * i] & _MASK[np.minimum(rest - 8 * i, 8)]
        h = scramble(h ^ scramble(chunk + _STEPS[i]))
        if whole and not i:
            out = h
        else:
            out[places] = h
    return out


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) in slices of about SLICE bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words' places in data, and for each text the number of its
    first word (one more entry than texts)."""
    return runs(IS_WORD[data], offsets)


def runs(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words(), a word being a run of bytes that is_word marks."""
    inside = np.zeros(len(is_word) + 2, bool)
    inside[1:-1] = is_word
    begins = inside[1:] & ~inside[:-1]
    stops = inside[:-1] & ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(is_word))]
    both = edges[inside[edges] & inside[edges + 1]]  # a word of one text touches one of the next
    begins[both] = True
    stops[both] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(word_hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted hashes. A text of fewer words has
    its whole sequence as one shingle, a text without words has none."""
    n = len(word_hashes)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        rolled = scramble(rolled + word_hashes[i : n - k + 1 + i] + np.uint64(i + 1)) if n >= k else rolled
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(rolled[a : b - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for x in word_hashes[a:b]:
                h = scramble(h + x + np.uint64(77))
            out.append(h ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
