"""WARC archives of pages: a deterministic sharded writer, and a reader.

Pages are range-sorted by id, each task writes the files of its range and starts a new one once the
compressed size is reached. Headers and digests are made anew from the payload; the date is a parameter, so
the same pages give the same bytes. A file gets its name when it is complete, and only files in the manifest,
which Spark commits as a table, are read.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest id is a response, the
others are revisits that refer to it and keep only the length in their HTTP header.

Rows: a null html is an empty payload; a null url is written as ``urn:none``; control characters in a url are
percent-encoded; a null id sorts first and is written as ``none``; of repeated ids with equal payloads one is
the response; other columns are ignored. An empty table gives no file and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparselin.llm.store import opened
from sparselin.llm.token_files import commit, range_partitions
from sparselin.session import ship_package

MIN_REVISIT = 100
ROLL_BYTES = 64 << 20
MANIFEST = "part long, file long, path string, n_records long, n_bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` in ranges of the id, with the id a page refers to and whether it is a revisit.

    Only ids and digests are grouped and ranked; the pages themselves move once, to their range, where their
    verdicts, sorted before them, meet them.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    long_enough = F.octet_length(payload) >= MIN_REVISIT
    keyed = pages.where(long_enough).select("page_id", F.sha2(payload, 256).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    verdict = keyed.join(first, "digest")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("html"),
                        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind"))
    both = rows.unionByName(verdict.select(
        "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first", F.lit(0).alias("kind")))
    order = ["page_id", "kind", "url", "html"]
    return both.repartitionByRange(range_partitions(pages), "page_id").sortWithinPartitions(*order)


def clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url: str | None, html: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record; headers and digests follow from the payload."""
    payload = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {clean(url)}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    """A gzip member of its own, without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Rolled:
    """Files of one range, each closed at ``limit`` compressed bytes."""

    def __init__(self, folder: str, part: int, limit: int):
        self._files, self._root = opened(folder)
        self._part, self._limit, self._file = part, limit, -1
        self._out, self.done = None, []

    def write(self, data: bytes) -> None:
        if self._out is None:
            self._files.create_dir(self._root, recursive=True)
            self._file += 1
            self._temporary = f"{self._root}/.tmp-{self._part:06d}-{self._file:04d}-{uuid.uuid4().hex}"
            self._out, self._n = self._files.open_output_stream(self._temporary, compression=None), 0
        self._out.write(data)
        self._n += 1
        if self._out.tell() >= self._limit:
            self.close()

    def close(self) -> None:
        if self._out is None:
            return
        size, name = self._out.tell(), f"part-{self._part:06d}-{self._file:04d}.warc.gz"
        self._out.close()
        commit(self._files, self._temporary, f"{self._root}/{name}")
        self.done.append({"part": self._part, "file": self._file, "path": name, "n_records": self._n, "n_bytes": size})
        self._out = None


def write_warc(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives; one row of ``MANIFEST`` for each file."""
    ship_package(pages.sparkSession)

    def write(batches):
        out = Rolled(folder, TaskContext.get().partitionId(), roll_bytes)
        # Verdicts of the page id at hand by digest; the id itself answers once for each digest it owns.
        here, verdicts, answered = object(), {}, set()
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                page_id, url, html, digest, first, kind = row
                if page_id != here:
                    here, verdicts, answered = page_id, {}, set()
                if kind == 0:
                    verdicts[digest] = first
                    continue
                first, revisit = None, False
                if verdicts:
                    own = hashlib.sha256(html.encode()).hexdigest()
                    if own in verdicts:
                        first = verdicts[own]
                        revisit = first != page_id or own in answered
                        answered.add(own)
                out.write(gzipped(record(page_id, url, html, first, revisit, date)))
        out.close()
        if out.done:
            yield pa.RecordBatch.from_pylist(out.done)

    return with_revisits(pages).mapInArrow(write, MANIFEST)


def members(stream, chunk: int = 1 << 20):
    """Contents of the gzip members of a stream, one at a time."""
    packed, reader, parts = b"", zlib.decompressobj(31), []
    while True:
        if not packed and not (packed := stream.read(chunk)):
            if parts:
                raise ValueError("an archive ends within a record")
            return
        parts.append(reader.decompress(packed))
        packed = reader.unused_data if reader.eof else b""
        if reader.eof:
            yield b"".join(parts)
            reader, parts = zlib.decompressobj(31), []


def parse(data: bytes) -> dict:
    """Fields of a record; the digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != stated):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    return fields | {"payload": payload, "payload_bytes": length, "payload_digest": stated}


def page_of(uri: str) -> int | None:
    name = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Records of the files in the manifest, a file to a task, as ``SCHEMA``."""
    ship_package(spark)
    numbered = manifest.select("path", (F.row_number().over(Window.orderBy("part", "file")) - 1).cast("long").alias("id"))
    n = manifest.count()

    def read(batches):
        files, root = opened(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for member in members(stream):
                        got = parse(member)
                        revisit = got["WARC-Type"] == "revisit"
                        rows.append((page_of(got["WARC-Record-ID"]), got["payload_bytes"], got["payload_digest"], got["WARC-Type"],
                                     page_of(got["WARC-Refers-To"]) if revisit else None))
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return spark.range(0, n, 1, max(n, 1)).join(F.broadcast(numbered), "id").select("path").mapInArrow(read, SCHEMA)
