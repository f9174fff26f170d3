"""Token ids of documents in Simple-8b files, in ascending document order.

A file holds segments, each of some documents: ``SEGMENT`` header (magic, documents, ids, blocks, words),
then document ids, whether each is null, ids per document, the block table and the coded words, all
little-endian. ``part-<k>.s8`` holds the k-th range of document ids.

Rows: a null text is empty, a null document id sorts first and stays null, repeated document ids follow
each other in the order of their texts; other columns are ignored. An empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparselin.llm import simple8b
from sparselin.llm.store import give_back, input_bytes, map_batches, opened, partitions, slices, text_column
from sparselin.llm.tokens import Encoder, tokenizer_path
from sparselin.session import ship_package

MAGIC = b"SIMPLE8B"
SEGMENT = "<8s4Q"
# Input bytes of a file, about.
FILE_BYTES = 64 << 20
# Input bytes a task encodes at once.
SLICE = 1 << 21
MANIFEST = "part long, n_docs long, n_ids long, n_bytes long"


def range_partitions(df: DataFrame, size: int = FILE_BYTES) -> int:
    """Partitions of about ``size`` bytes of input, as many as the session's at least."""
    return max(partitions(df.sparkSession), input_bytes(df) // size)


def with_end(flat: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id behind each document, and the bounds."""
    return np.insert(flat, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


def commit(files, temporary: str, final: str) -> None:
    """Give a finished file its name. Another attempt may have done so with the same content."""
    try:
        files.move(temporary, final)
    except OSError:
        if files.get_file_info(final).type.name != "File":
            raise
        files.delete_file(temporary)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files; one row of ``MANIFEST`` for each. ``tokenizer`` names an installed tokenizer file."""
    ship_package(docs.sparkSession)
    docs = docs.select("doc_id", text_column())

    def write(batches):
        part = TaskContext.get().partitionId()
        files, root = opened(folder)
        temporary, out, n_docs, n_ids = f"{root}/.tmp-{part:06d}-{uuid.uuid4().hex}", None, 0, 0
        encoder = Encoder.of(tokenizer_path(tokenizer))
        for batch in batches:
            for rows in slices(batch, SLICE):
                if out is None:
                    files.create_dir(root)
                    out = files.open_output_stream(temporary)
                ids, bounds = with_end(*encoder.batch(rows.column(1)), end_id)
                words, offsets = simple8b.encode(ids)
                doc_ids = rows.column(0)
                out.write(struct.pack(SEGMENT, MAGIC, rows.num_rows, len(ids), len(offsets), len(words)))
                out.write(doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes())
                out.write(doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                out.write(np.diff(bounds).astype("<u8").tobytes())
                out.write(offsets.astype("<u4").tobytes())
                out.write(words.astype("<u8").tobytes())
                n_docs, n_ids = n_docs + rows.num_rows, n_ids + len(ids)
        if out is not None:
            size = out.tell()
            out.close()
            commit(files, temporary, f"{root}/part-{part:06d}.s8")
            give_back()
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [size]})

    ordered = docs.repartitionByRange(range_partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, MANIFEST)


def segments(stream):
    """Document ids, their null flags, ids and their bounds of each segment of a file."""
    while head := stream.read(struct.calcsize(SEGMENT)):
        magic, n_docs, n_ids, n_blocks, n_words = struct.unpack(SEGMENT, head)
        if magic != MAGIC:
            raise ValueError("not a token file")
        doc_ids = np.frombuffer(stream.read(8 * n_docs), "<i8")
        missing = np.frombuffer(stream.read(n_docs), np.uint8).astype(bool)
        counts = np.frombuffer(stream.read(8 * n_docs), "<u8").astype(np.int64)
        offsets = np.frombuffer(stream.read(4 * n_blocks), "<u4")
        words = np.frombuffer(stream.read(8 * n_words), "<u8")
        ids = simple8b.decode(words, offsets, n_ids).astype(np.uint32)
        yield doc_ids, missing, ids, np.concatenate([[0], np.cumsum(counts)])


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, task, schema: str) -> DataFrame:
    """``task(doc_ids, missing, ids, bounds, start)`` over the segments of every file, a file to a task.

    ``start`` is the number of ids in all files and segments before. The manifest holds a row per file.
    """
    ship_package(spark)
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = manifest.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    last = manifest.agg(F.max("part")).first()[0]
    n = 0 if last is None else last + 1

    def read(batches):
        files, root = opened(folder)
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_stream(f"{root}/part-{part:06d}.s8") as stream:
                    for doc_ids, missing, ids, bounds in segments(stream):
                        yield task(doc_ids, missing, ids, bounds, start)
                        start += len(ids)

    places = spark.range(0, n, 1, max(n, 1)).withColumnRenamed("id", "part")
    return places.join(F.broadcast(starts), "part").select("part", "start").mapInArrow(read, schema)


def crcs(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw, at = memoryview(ids.astype("<u4").tobytes()), (4 * bounds).tolist()
    return np.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], np.int64)


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def digest(doc_ids, missing, ids, bounds, start) -> pa.RecordBatch:
    """One row per document: where its ids start among all, how many they are, and their checksum."""
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64(), mask=missing), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)),
         pa.array(crcs(ids, bounds))],
        names=["doc_id", "start", "n_tokens", "ids_crc32"])


def piece_table(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Pieces of at most ``size`` ids of every document: ``doc_id, piece, start, length, ids_crc32``.

    Only a document of more than ``size`` ids, end id included, is cut; its first piece takes what is left
    of whole pieces.
    """
    def cut(rows):
        ids, bounds = with_end(*Encoder.of(tokenizer_path(tokenizer)).batch(rows.column(1)), end_id)
        counts = np.diff(bounds)
        pieces = -(-counts // size)
        owner = np.repeat(np.arange(len(counts)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = counts - (pieces - 1) * size
        start = np.where(piece == 0, 0, first[owner] + (piece - 1) * size)
        length = np.where(piece == 0, first[owner], size)
        edges = np.concatenate([bounds[:-1][owner] + start, [len(ids)]])
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start),
             pa.array(length), pa.array(crcs(ids, edges))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select("doc_id", text_column()), cut,
                       "doc_id long, piece int, start long, length long, ids_crc32 long", SLICE)
