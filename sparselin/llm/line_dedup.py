"""Drop lines that other documents have as well, all but in the document with the smallest id.

A line's key is the line without white space at its ends, in lower case (A to Z only); keys shorter than
``MIN_POINTS`` code points are never dropped. Keys are told apart by 128-bit hashes.

The distinct hashes are counted with the smallest document id of each, and cut into shards of about
``SHARD_KEYS``. Each shard becomes a minimal perfect hash with arrays of fingerprints, saturated counts and
owners, some 15 bytes a key. Documents send the hashes of their lines to the shards and get back those to drop;
the lines themselves are not joined. A line with more documents than ``HOT_ROWS`` or several times a shard's
share is answered in place from a broadcast table, which has at most (lines / ``HOT_ROWS`` + shards / 4) rows.

Rows: a null or empty text is one empty line; a row without an id keeps its lines and is no document to
others; rows with one id are one document; ties cannot occur, since ids are compared; other columns stay as
they are. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.llm.mph import PerfectHash
from sparselin.llm.store import Scratch, extended, map_batches, named, others, partitions, unused
from sparselin.llm.words import LOWER, U64

MIN_POINTS = 10
SHARD_KEYS = 1 << 18
HOT_ROWS = 1 << 20
STRIP = b" \t\n\x0b\x0c\r"
FOLD = LOWER.tobytes()
COUNTS = "n_lines long, n_dropped long"
INDEX = "shard long, words binary, starts binary, fingerprints binary, counts binary, owners binary"


def line_hashes(lines: list[bytes], min_points: int) -> list[bytes | None]:
    """128-bit hashes of the lines' keys; none for keys that are too short."""
    out = []
    for line in lines:
        key = line.strip(STRIP)
        if len(key) >= 4 * min_points or len(key) >= min_points and len(key.decode()) >= min_points:
            out.append(xxhash.xxh3_128_digest(key.translate(FOLD)))
        else:
            out.append(None)
    return out


def hashed(docs: DataFrame, min_points: int) -> DataFrame:
    """``doc_id, a, b``: each line hash of a document once."""
    def task(part):
        ids, found, own = part.column(0).to_numpy(), [], []
        for text in part.column(1).to_pylist():
            mine = {h for h in line_hashes((text or "").encode().split(b"\n"), min_points) if h}
            found.extend(mine)
            own.append(len(mine))
        pairs = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, own)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc_id", "a", "b"])

    return map_batches(docs.where("doc_id is not null").select("doc_id", "text"), task, "doc_id long, a long, b long")


def build_shard(key, table):
    """One row: the index of a shard's keys."""
    a, b = (table.column(n).to_numpy().view(U64) for n in ("a", "b"))
    index = PerfectHash.build(a, b)
    number = index.number(a, b)
    fingerprints, counts, owners = np.empty(len(a), np.uint32), np.empty(len(a), np.uint8), np.empty(len(a), np.int64)
    fingerprints[number] = b.astype(np.uint32)
    counts[number] = np.minimum(table.column("n").to_numpy(), 255)
    owners[number] = table.column("owner").to_numpy()
    return pa.table({"shard": [key[0].as_py()], **{
        name: pa.array([x.tobytes()], pa.binary()) for name, x in
        (("words", index.words), ("starts", index.starts), ("fingerprints", fingerprints), ("counts", counts), ("owners", owners))}})


def probe_shard(key, lines, index):
    """Lines of the shard that other documents have and a smaller one owns."""
    if not len(lines) or not len(index):
        return lines.select(["doc_id", "a", "b"]).slice(0, 0)
    row = index.to_pylist()[0]
    a, b = (lines.column(n).to_numpy().view(U64) for n in ("a", "b"))
    number = PerfectHash(np.frombuffer(row["words"], U64), np.frombuffer(row["starts"], np.int64)).number(a, b)
    known = (number >= 0) & (np.frombuffer(row["fingerprints"], np.uint32)[number] == b.astype(np.uint32))
    drop = known & (np.frombuffer(row["counts"], np.uint8)[number] > 1)
    drop &= np.frombuffer(row["owners"], np.int64)[number] != lines.column("doc_id").to_numpy()
    return lines.select(["doc_id", "a", "b"]).filter(pa.array(drop))


def repeated_lines(docs: DataFrame, scratch: Scratch, min_points: int) -> DataFrame:
    """``doc_id, drops``: hashes of the lines each document loses."""
    spark = docs.sparkSession
    lines = scratch.table(hashed(docs, min_points), "lines")
    # Rows of one document id are one document.
    n = F.when(F.min("doc_id") == F.max("doc_id"), 1).otherwise(F.count("*"))
    counts = scratch.table(lines.groupBy("a", "b").agg(n.alias("n"), F.min("doc_id").alias("owner")), "counts")
    total, keys = lines.count(), counts.count()
    shards = max(partitions(spark), -(-keys // SHARD_KEYS))
    shard = F.pmod(F.xxhash64("a"), F.lit(shards)).alias("shard")
    index = scratch.table(counts.select(shard, "a", "b", "n", "owner").groupBy("shard").applyInArrow(build_shard, INDEX), "index")
    # Both bounds limit how many lines can be hot.
    hot = counts.where(F.col("n") > min(HOT_ROWS, max(1000, 4 * total // shards))).select("a", "b", "owner")
    routed = lines.join(F.broadcast(hot.drop("owner")), ["a", "b"], "left_anti").select(shard, "doc_id", "a", "b")
    cold = routed.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe_shard, "doc_id long, a long, b long")
    in_place = lines.join(F.broadcast(hot), ["a", "b"]).where("doc_id <> owner").select("doc_id", "a", "b")
    return cold.unionByName(in_place).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("_drops"))


def drop_repeated_lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """``docs`` (``doc_id, text`` and more) with the repeated lines gone, ``n_lines`` before and ``n_dropped``.

    Columns of those names are replaced.
   """
    scratch = Scratch(docs.sparkSession, "lines")
    drops = repeated_lines(docs, scratch, min_points)
    names, gone_here = others(docs, COUNTS), unused(docs, "_drops")
    joined = docs.join(drops.withColumnRenamed("_drops", gone_here).hint("shuffle_hash"), "doc_id", "left").select(*named([*names, gone_here]))

    def task(part):
        at = names.index("text")
        texts, n_lines, n_dropped = [], [], []
        for text, drop in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist()):
            lines = (text or "").encode().split(b"\n")
            kept = lines
            if drop:
                gone = {np.array([d["a"], d["b"]], np.int64).tobytes() for d in drop}
                kept = [x for x, h in zip(lines, line_hashes(lines, min_points)) if h not in gone]
            texts.append(b"\n".join(kept).decode())
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        columns = [*part.columns[:at], pa.array(texts, pa.string()), *part.columns[at + 1:len(names)]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                         names=[*names, "n_lines", "n_dropped"])

    return map_batches(joined, task, extended(docs, names, COUNTS))
