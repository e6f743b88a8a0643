"""Document fingerprints as invertible Bloom lookup sketches.

A text is the set of digests of its paragraphs; long paragraphs are cut after words that a
hash picks, so an edit changes few of them. Each digest goes to three cells of a sketch. The
sketch of one version minus that of another holds what differs; peeling recovers those digests.
Fingerprints are sketches of a fixed number of cells as text; they are read back to be compared, and only
the pairs that fail to peel are sketched again, with twice the cells each time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import written
from .ranges import first_keys, hash_key, range_of, sort_key

#: Cells of a fingerprint, a multiple of 3; sketches grow from there.
CELLS = 12
#: A space ends a piece of a paragraph after one word in so many.
CUT = 8
BUCKET_BYTES = 8 << 20
GROUP_BYTES = 1 << 20


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of the distinct pieces of texts, by text and digest."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    before = np.zeros(n, np.uint32)
    before[1:] = data[:-1]
    earlier = np.zeros(n, np.uint32)
    earlier[2:] = data[:-2]
    heads = offsets[:-1][np.diff(offsets) > 0]  # what stands before a text doesn't count
    before[heads] = earlier[heads] = 0
    earlier[np.minimum(heads + 1, n - 1)] = 0
    mix = before * np.uint32(2654435761) + earlier * np.uint32(40503)
    stop = (data == 10) | ((data == 32) & ((mix >> np.uint32(13)) % np.uint32(CUT) == 0))
    inside = ~stop
    begins, ends_at = inside.copy(), inside.copy()
    begins[1:] &= stop[:-1]
    ends_at[:-1] &= stop[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    ends_at[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends_at) + 1
    own = np.searchsorted(offsets, starts, "right") - 1
    hashed = tv.segment_hashes(data, starts, ends)
    order = np.lexsort((hashed, own))
    own, hashed = own[order], hashed[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (hashed[1:] != hashed[:-1])
    return own[fresh], hashed[fresh]


class Sketches:
    """Sketches of several sets side by side: set i has cells[i] of them from base[i] on."""

    def __init__(self, cells: np.ndarray):
        self.third = cells // 3
        self.base = np.concatenate(([0], np.cumsum(cells)))
        n = int(self.base[-1])
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint32)

    def places(self, own: np.ndarray, keys: np.ndarray) -> Iterator[np.ndarray]:
        third = self.third[own].astype(np.uint64)
        for i in range(3):
            at = tv.scramble(keys ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % third
            yield self.base[own] + i * self.third[own] + at.astype(np.int64)

    def add(self, own: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        unsigned = sign.astype(np.uint64)
        checks = check(keys) * sign.astype(np.uint32)
        for at in self.places(own, keys):
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, keys * unsigned)
            np.add.at(self.checks, at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(np.diff(self.base))
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whether each set is empty at the end, and own, key, sign of what was recovered)."""
        owner = np.repeat(np.arange(len(self.third)), np.diff(self.base))
        got = []
        look = np.arange(len(self.count))
        while len(look):
            one = look[np.abs(self.count[look]) == 1]
            sign = self.count[one]
            keys = self.keys[one] * sign.astype(np.uint64)
            pure = check(keys) == self.checks[one] * sign.astype(np.uint32)
            one, sign, keys = one[pure], sign[pure], keys[pure]
            if not len(one):
                break
            own = owner[one]
            order = np.lexsort((keys, own))
            own, keys, sign = own[order], keys[order], sign[order]
            fresh = np.ones(len(own), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])
            own, keys, sign = own[fresh], keys[fresh], sign[fresh]
            got.append((own, keys, sign))
            self.add(own, keys, -sign)
            look = np.unique(np.concatenate(list(self.places(own, keys))))
        left = np.zeros(len(self.third) + 1, np.int64)
        np.add.at(left, owner, (self.count != 0) | (self.keys != 0) | (self.checks != 0))
        parts = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return left[:-1] == 0, *parts

    def text(self, i: int) -> str:
        """The sketch of set i as text, to be read by Sketches.read."""
        a, b = int(self.base[i]), int(self.base[i + 1])
        return base64.b64encode(self.count[a:b].astype("<u4").tobytes() + self.keys[a:b].astype("<u8").tobytes() + self.checks[a:b].astype("<u4").tobytes()).decode()

    @classmethod
    def read(cls, fingerprints: list[str]) -> Sketches:
        raw = [base64.b64decode(x) for x in fingerprints]
        out = cls(np.array([len(x) // 16 for x in raw], np.int64))
        for x, a, b in zip(raw, out.base[:-1].tolist(), out.base[1:].tolist(), strict=True):
            n = b - a
            out.count[a:b], out.keys[a:b], out.checks[a:b] = np.frombuffer(x, "<u4", n), np.frombuffer(x, "<u8", n, 4 * n), np.frombuffer(x, "<u4", n, 12 * n)
        return out

    def sizes(self) -> np.ndarray:
        """The number of digests in each set: each is in three cells."""
        return np.add.reduceat(self.count, self.base[:-1]) // 3 if len(self.third) else np.zeros(0, np.int64)


def check(keys: np.ndarray) -> np.ndarray:
    return tv.scramble(keys + np.uint64(0xC0FFEE)).astype(np.uint32)


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, digest, sign) of the digests in which n pairs of sets differ: sign 1 where a has
    it, -1 where b has. Each of a and b is (number of the set, digest). Pairs that fail to peel are
    sketched again with twice the cells."""
    sizes = np.abs(np.bincount(a[0], minlength=n) - np.bincount(b[0], minlength=n))
    todo, out = np.arange(n), []
    wanted = cells + sizes * 3 // 2 // 3 * 3
    while len(todo):
        new = np.full(n, -1)
        new[todo] = np.arange(len(todo))
        first, second = Sketches(wanted[todo]), Sketches(wanted[todo])
        for sketch, (own, keys) in ((first, a), (second, b)):
            here = new[own] >= 0
            sketch.add(new[own[here]], keys[here])
        done, own, keys, sign = first.minus(second).peel()
        keep = done[own]
        out.append((todo[own[keep]], keys[keep], sign[keep]))
        todo = todo[~done]
        wanted[todo] *= 2
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def fingerprints(sets: tuple[np.ndarray, np.ndarray], n: int) -> list[str]:
    """The fingerprint of each of n sets (number of the set, digest)."""
    sketch = Sketches(np.full(n, CELLS))
    sketch.add(*sets)
    return [sketch.text(i) for i in range(n)]


def likeness(a: list[str], b: list[str], sets) -> np.ndarray:
    """Shared pieces of all pieces of each pair of fingerprints, from the number that differ; 1 for two empty sets.

    sets gives the pieces of both sides as differing() takes them; the pairs whose fingerprints differ by more than
    their cells can tell are sketched again from those, with twice the cells at least."""
    first, second = Sketches.read(a), Sketches.read(b)
    both = first.sizes() + second.sizes()
    done, own, _, _ = first.minus(second).peel()
    d = np.bincount(own, minlength=len(a))
    left = np.flatnonzero(~done)
    if len(left):
        place = np.full(len(a), -1)
        place[left] = np.arange(len(left))
        again = [(place[own][place[own] >= 0], keys[place[own] >= 0]) for own, keys in sets]
        d[left] = np.bincount(differing(*again, len(left), 2 * CELLS)[0], minlength=len(left))
    return np.where(both > 0, (both - d) / np.maximum(both + d, 1), 1.0)


def _pieces_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    return pieces(np.frombuffer(b"".join(texts), np.uint8), offsets)


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _rows(ids: list, texts: list[str], last: str, id_type) -> pa.RecordBatch:
    """Results of texts that follow each other; last follows the last of them."""
    n = len(texts)
    after = [*texts[1:], last]
    changed = [edited(a, b).encode() for a, b in zip(texts, after, strict=True)]
    own, keys = _pieces_of([x.encode() for x in [*texts, last]])
    here, there = own < n, own > 0
    a, following, e = (own[here], keys[here]), (own[there] - 1, keys[there]), _pieces_of(changed)
    prints = fingerprints((own, keys), n + 1)
    prints_e = fingerprints(e, n)
    arrays = [
        pa.array(ids, id_type), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in changed]),
        pa.array(prints[:n]), pa.array(prints_e), pa.array(likeness(prints[:n], prints_e, (a, e))), pa.array(likeness(prints[:n], prints[1:], (a, following))),
    ]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])


SCHEMA = "doc_id {id}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_versions(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """For each row of docs (doc_id, text) its fingerprint, that of its edited text, and the
    likeness of both and of it and the next document's.

    doc_id is a whole number. Documents follow in descending doc_id, null last; rows of equal id go by a hash of
    their text. After the last comes the first; a lone row follows itself. The edited text has its last
    third replaced by the head of the next text. A null text is empty, an empty text has an
    empty sketch, and two empty ones are alike (1.0). Ranges of that order are dealt to buckets, each
    with a copy of the first row of the next; a bucket is read as a stream.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", sort_key(F.col("doc_id"), hash_key(F.col("text")), descending=True))
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not rows:
        return spark.createDataFrame([], SCHEMA.format(id=kind))
    firsts = first_keys(docs.select("key", F.octet_length("text").cast("long").alias("size")), rows, size, bucket_bytes)
    dealt = docs.select(range_of(F.col("key"), firsts).alias("bucket"), F.lit(0).alias("extra"), "doc_id", "key", "text")
    heads = dealt.groupBy("bucket").agg(F.min("key").alias("key"))  # a row for each bucket: ranges.MOST_RANGES at most
    before = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy()))
    heads = F.broadcast(written(heads.select(before.alias("bucket"), "key"), "heads"))
    extra = docs.join(heads, "key").select("bucket", F.lit(1).alias("extra"), "doc_id", "key", "text")
    ordered = dealt.union(extra).repartitionById(len(firsts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "extra", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, at, ended = [], 0, [], None, False
        for batch in batches:
            id_type = batch.column(2).type
            for number, is_extra, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
                if number != at:
                    ids, texts, held, at, ended = [], [], 0, number, False
                if ended:  # a repeat of the next bucket's first row
                    continue
                text = text.as_py()
                if texts and (is_extra or held >= GROUP_BYTES):
                    yield _rows(ids, texts, text, id_type)
                    ids, texts, held = [], [], 0
                if is_extra:
                    ended = True
                else:
                    ids.append(doc_id)
                    texts.append(text)
                    held += len(text)

    return ordered.mapInArrow(run, SCHEMA.format(id=kind))
