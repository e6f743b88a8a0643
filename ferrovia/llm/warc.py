"""A deterministic, sharded writer of WARC archives, and their reader.

Records are range-sorted by page; each task writes the files of its range, rolls them by
compressed size, makes headers and digests anew, and moves every file from a temporary name to
its own. A manifest, written after all tasks, names the files that count. Ranges, names and bytes
depend on the records alone, so a task that runs again, and another run, writes the same files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, new_path, written
from .ranges import first_keys, range_of, sort_key

ROLL_BYTES = 16 << 20
RANGE_BYTES = 32 << 20
BROADCAST_DIGESTS = 200_000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6f1f2d0c-3f43-5d0b-9d5e-0d6f8c7a1e55")
_HTTP_END = b"\r\n\r\n"
MANIFEST = "file string, records bigint, bytes bigint, sha1 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}:{copy}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: tuple | None, copy: int) -> bytes:
    """A record as one gzip member. refers_to: None for a response, else (page_id,)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, copy)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to[0], digest, 0)}"]
        if refers_to[0] is not None:
            lines.append(f"Refers-To-Page-ID: {refers_to[0]}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + _HTTP_END + block + _HTTP_END) + packer.flush()


class _Roll:
    """Files of one range: NAME-RANGE-NUMBER.warc.gz, each first under a temporary name."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, attempt: int):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.attempt = shard, roll_bytes, attempt
        self.number, self.out = 0, None

    def add(self, data: bytes) -> tuple | None:
        if self.out is None:
            self.temp = f"{self.path}/_temporary/{self.shard:06d}-{self.number:05d}-{self.attempt}"
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out, self.records, self.bytes, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha1()
        self.out.write(data)
        self.sha.update(data)
        self.records += 1
        self.bytes += len(data)
        return self.close() if self.bytes >= self.roll_bytes else None

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        name = f"pages-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.number += 1
        final = f"{self.path}/{name}"
        there = self.fs.get_file_info(final)
        if there.type == pafs.FileType.NotFound:
            self.fs.move(self.temp, final)
        elif there.size == self.bytes:
            self.fs.delete_file(self.temp)  # an earlier run of this task has put the same bytes there
        else:
            raise FileExistsError(f"{final} holds other records")
        return name, self.records, self.bytes, self.sha.hexdigest()


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) under folder and return the manifest.

    page_id is a whole number. Of records with equal payloads of at least min_revisit_bytes, the one with the largest
    page_id is the response; the others revisit it. Rows that repeat that page_id revisit their
    first, in the order of their urls. A null html is an empty payload, a null url gives no target, null ids
    count as less than any other. Rows of one page_id and payload are in one range; there are at most
    ranges.MOST_RANGES ranges. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.sha1(data).alias("digest"), F.octet_length(data).cast("long").alias("size"))
    per_digest = narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("owner"), F.max("size").alias("size"))
    per_digest = written(per_digest.withColumn("shared", (F.col("n") > 1) & (F.col("size") >= min_revisit_bytes)), "warc-digests")
    total, rows = per_digest.agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).first()
    shared = per_digest.where("shared").select("digest", "owner", "shared")
    records = pages.select("page_id", "url", "html", F.sha1(data).alias("digest"))
    records = records.join(F.broadcast(shared) if fits(shared, BROADCAST_DIGESTS) else shared, "digest", "left")
    key = sort_key(F.col("page_id"), F.col("digest"))
    firsts = first_keys(narrow.select(key.alias("key"), "size"), rows or 0, total or 0, range_bytes)
    ordered = records.withColumn("range", range_of(key, firsts)).repartitionById(len(firsts) + 1, F.col("range")).sortWithinPartitions("range", "page_id", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, roll = TaskContext.get().taskAttemptId(), None
        done, last, copy = [], None, 0
        for batch in batches:
            for page_id, url, html, hexed, owner, is_shared, number in zip(*(batch.column(i) for i in range(7)), strict=True):
                page_id, owner, hexed, number = page_id.as_py(), owner.as_py(), hexed.as_py(), number.as_py()
                if roll is None or roll.shard != number:
                    done += [roll.close()] if roll else []
                    roll = _Roll(folder, number, roll_bytes, attempt)
                copy = copy + 1 if last == (page_id, hexed) else 0
                last = (page_id, hexed)
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                revisit = (owner,) if is_shared.as_py() and (page_id != owner or copy) else None
                done.append(roll.add(record(page_id, url.as_py(), (html.as_py() or "").encode(), digest, revisit, copy)))
        done = [x for x in [*done, roll and roll.close()] if x]
        columns = list(zip(*done, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "records", "bytes", "sha1"])

    found = ordered.select("page_id", "url", "html", "digest", "owner", "shared", "range").mapInArrow(run, MANIFEST)
    found.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def members(data: memoryview) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    at = 0
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(data):
                raise ValueError("a record is cut off")
            part = data[at : at + 65536]
            parts.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield b"".join(parts)


def parsed(member: bytes) -> dict:
    """The fields of a record, its digests checked against its bytes."""
    head, _, rest = member.partition(_HTTP_END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(_HTTP_END)
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    return {
        "page_id": int(fields["Page-ID"]) if "Page-ID" in fields else None, "url": _unquoted(fields.get("WARC-Target-URI")), "record_type": fields["WARC-Type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": int(fields["Refers-To-Page-ID"]) if "Refers-To-Page-ID" in fields else None,
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _unquoted(uri: str | None) -> str | None:
    from urllib.parse import unquote

    return None if uri is None else unquote(uri)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names: page_id, url, record_type,
    payload_bytes, payload_digest, refers_to and, if wanted, payload (null for a revisit)."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    if not payloads:
        del kinds["payload"]
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for member in members(memoryview(content.as_buffer())):
                    rows.append({k: v for k, v in parsed(member).items() if k in kinds})
                    held += len(member)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    names = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    if not names.limit(1).count():
        return spark.createDataFrame([], _ddl(kinds))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).withColumn("file", F.substring_index("path", "/", -1))
    return files.join(names.select("file"), "file", "left_semi").select("content").mapInArrow(run, _ddl(kinds))


def _ddl(kinds: dict) -> str:
    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{k} {names[v]}" for k, v in kinds.items())


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, **how) -> DataFrame:
    """Pages written to a new folder and read back, without their payloads."""
    folder = new_path(pages.sparkSession, "warc")
    write_warc(pages, folder, min_revisit_bytes, **how)
    return read_warc(pages.sparkSession, folder, payloads=False)
