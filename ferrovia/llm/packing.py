"""Cost-balanced packing of tokenized documents into sequences of bounded length.

A piece of n tokens costs linear * n + quadratic * n * n (attention). A task packs its
documents in groups of bounded size: whole sequences are cut off a document first, what is
left goes, longest first, to the sequence of lowest cost that has room; where none has room
for the whole, it is cut. Nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Tokens of document ends that are packed together: 8 MB.
GROUP_TOKENS = 1 << 21
PIECES = "doc_id {id}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, cost double"
#: The special tokens of byte_bpe_50k.json, which its rank file lacks.
SPECIAL = {"<|endoftext|>": 50256}

_encoders: dict[str, object] = {}


def encoder(path: str):
    """text to token ids, special strings being their own tokens. A .json file is read by
    tokenizers; a .tiktoken file holds the same vocabulary as ranks, gives the same ids
    (a test in tests/llm holds them equal) and takes about a third of the time."""
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
            _encoders[path] = lambda text: ranked.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _encoders[path] = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return _encoders[path]


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items of the given lengths.

    As few sequences as hold all of them; longest item first (ties by place), to the
    sequence of lowest cost with room for it (ties by number). Where no sequence has room for
    a whole item, the one of lowest cost that has any takes what fits.
    """
    n = -(-sum(lengths) // capacity)
    cost, room = np.zeros(n), np.full(n, capacity, np.int64)
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            open_to = np.where(room >= left, cost, np.inf)
            s = int(open_to.argmin())
            if open_to[s] == np.inf:
                s = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(left, int(room[s]))
            out.append((item, start, take, s, capacity - int(room[s])))
            cost[s] += linear * take + quadratic * take * take
            room[s] -= take
            start, left = start + take, left - take
    return out


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """Pieces of documents (doc_id, text): doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset and cost.

    A document is the ids of its text and end_id; a null or empty text is end_id alone. Every
    id is in one piece, offsets in a sequence are gapless from 0. Each group leaves less than
    one sequence of padding. sequence_id is the task's number and a count in it, so it is
    unique, and it stays the same as long as the input's partitions do. A null doc_id is
    kept; rows that repeat are packed each. An empty table has no pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"]
        sequence = TaskContext.get().partitionId() << 40
        id_type = None
        rows: list[tuple] = []
        ends: list[tuple] = []  # doc_id, start, ids, doc_tokens
        held = 0

        def flushed() -> pa.RecordBatch:
            nonlocal rows
            columns = list(zip(*rows, strict=True))
            lengths = np.array(columns[2], np.float64)
            arrays = [pa.array(columns[0], id_type), *(pa.array(columns[i], pa.int64()) for i in (1, 2)), pa.array(columns[3], pa.binary())]
            arrays += [pa.array(columns[i], pa.int64()) for i in (4, 5, 6)] + [pa.array(linear * lengths + quadratic * lengths * lengths)]
            rows = []
            return pa.RecordBatch.from_arrays(arrays, names)

        def settle() -> None:
            nonlocal ends, held, sequence
            pieces = assign([len(x[2]) for x in ends], capacity, linear, quadratic)
            for item, start, length, s, offset in pieces:
                doc_id, base, ids, total = ends[item]
                rows.append((doc_id, base + start, length, ids[start : start + length].tobytes(), total, sequence + s, offset))
            sequence += 1 + max((p[3] for p in pieces), default=-1)
            ends, held = [], 0

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                whole = len(ids) // capacity * capacity
                for at in range(0, whole, capacity):
                    rows.append((doc_id, at, capacity, ids[at : at + capacity].tobytes(), len(ids), sequence, 0))
                    sequence += 1
                if whole < len(ids):
                    ends.append((doc_id, whole, ids[whole:], len(ids)))
                    held += len(ids) - whole
                if held >= group_tokens:
                    settle()
                if len(rows) >= 2000:
                    yield flushed()
        settle()
        if rows:
            yield flushed()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(id=kind))
