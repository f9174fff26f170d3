"""Alignment of two tokenizations of whole texts, by byte offsets.

A text is encoded, with one blank before it, by a byte-level file of the tokenizers library (A) and, without it, by a
sentencepiece file (B), which adds one. Byte offsets at which tokens of both end cut the tokens into groups; tokens
whose byte ranges overlap are linked.

Groups come from fragments, which are a monoid. The fragment of a byte range has the tokens that end in it, those of
either kind up to the first common end (its open head), the groups between common ends, and what follows the last one (its
open tail). Putting two fragments after each other joins the tail of the first and the head of the second into one
group, or into what stays open where a side has no common end. That is associative, so the ranges of a very long
text become fragments in different tasks, and rounds of ``FAN`` neighbours put them together, each round a shuffle of the
fragments that are left; a text of one range is whole at once and never moves.

The count of an id pair is the number of rows that hold it linked. Counts are added up within tasks before they are
shuffled. They return to the rows as broadcasts of at most ``PAIRS`` pairs, cut by A id; with more pairs the rows are
read once for each, and what the reads give is added up.

Rows: texts that are null or empty, or whose tokens of either kind do not spell the text again, have no tokens. Null and
repeated ids are rows of their own; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.llm.near_dup import grouped
from sparselin.llm.store import Scratch, map_batches, partitions, slices, text_column
from sparselin.llm.tokens import Encoder, byte_letters, tokenizer_path
from sparselin.llm.words import spread_runs, text_bytes
from sparselin.session import ship_package

# Bytes of a range.
RANGE = 1 << 18
# Neighbouring fragments put together in one round.
FAN = 8
# Pairs of a broadcast: some 20 bytes each.
PAIRS = 1 << 21
# Input bytes a task encodes at once, and bytes of ids it aligns at once.
SLICE, IDS = 1 << 20, 1 << 20

# Ids are little-endian numbers of 16 bits where both vocabularies allow, counts bytes (255: the next one is added).
# A row's lists are a few bytes a token that way, and Spark moves them without looking into them.
_SIDES = "a_ids binary, b_ids binary, a_counts binary, b_counts binary"
FRAGMENTS = f"row long, doc_id long, part long, parts long, {_SIDES}, a_head int, b_head int"
ALIGNED = f"row long, doc_id long, {_SIDES}"
SUMMARY = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level file."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    of = {c: b for b, c in byte_letters().items()}
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
    return out


class Pieces:
    """A sentencepiece file; made once per Python worker."""

    _made: dict[str, Pieces] = {}

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self._model = SentencePieceProcessor(model_file=path)

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def bytes(self) -> list[bytes]:
        """The bytes of each id; of a byte piece that byte, and U+2581 is a blank."""
        model = self._model
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._model.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), np.concatenate([[0], np.cumsum(counts)])


class Spelling:
    """Bytes of ids."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self._heads = np.cumsum(self.sizes) - self.sizes
        self._pool = np.frombuffer(b"".join(pieces), np.uint8)

    def spelled(self, ids: np.ndarray, bounds: np.ndarray, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text spell its bytes ``body[at[k]:at[k + 1]]``."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        same = np.diff(ends) == np.diff(at)
        use = np.repeat(same, np.diff(bounds))
        got = self._pool[spread_runs(self._heads[ids[use]], sizes[use])]
        want = body[np.repeat(same, np.diff(at))]
        owner = np.repeat(np.flatnonzero(same), np.diff(at)[same])
        same[owner[got != want]] = False
        return same


@lru_cache
def level_spelling(path: str) -> Spelling:
    return Spelling(level_bytes(path))


@lru_cache
def piece_spelling(path: str) -> Spelling:
    return Spelling(Pieces.of(path).bytes())


@dataclass
class Fragment:
    """Tokens of a byte range and the groups among them.

    The first ``a_head`` and ``b_head`` tokens are the open head, then come the groups with ``a_counts`` and ``b_counts``
    tokens, and the rest is the open tail. Without a common end, ``cut`` is false and all tokens are open.
    """

    a_ids: list | np.ndarray = field(default_factory=list)
    b_ids: list | np.ndarray = field(default_factory=list)
    a_counts: list | np.ndarray = field(default_factory=list)
    b_counts: list | np.ndarray = field(default_factory=list)
    a_head: int = 0
    b_head: int = 0
    cut: bool = False

    @classmethod
    def of(cls, a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray) -> Fragment:
        """From the tokens that end in a range, and where they end."""
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not len(common):
            return cls(a_ids, b_ids)
        a, b = (np.searchsorted(x, common, "right") for x in (a_ends, b_ends))
        return cls(a_ids, b_ids, np.diff(a), np.diff(b), int(a[0]), int(b[0]), True)

    def open_tail(self) -> tuple[int, int]:
        return (len(self.a_ids) - self.a_head - int(np.sum(self.a_counts)), len(self.b_ids) - self.b_head - int(np.sum(self.b_counts)))

    def __add__(self, other: Fragment) -> Fragment:
        """The fragment of both ranges, ``other`` behind this one."""
        ids = [np.concatenate([x, y]).astype(np.int64) for x, y in ((self.a_ids, other.a_ids), (self.b_ids, other.b_ids))]
        if not self.cut and not other.cut:
            return Fragment(*ids)
        if not self.cut:
            return Fragment(*ids, other.a_counts, other.b_counts, len(self.a_ids) + other.a_head, len(self.b_ids) + other.b_head, True)
        if not other.cut:
            return Fragment(*ids, self.a_counts, self.b_counts, self.a_head, self.b_head, True)
        a_tail, b_tail = self.open_tail()
        return Fragment(*ids, np.concatenate([self.a_counts, [a_tail + other.a_head], other.a_counts]).astype(np.int64),
                        np.concatenate([self.b_counts, [b_tail + other.b_head], other.b_counts]).astype(np.int64),
                        self.a_head, self.b_head, True)

    def whole(self) -> Fragment:
        """Of a whole text: its start is a common end as well, so the head is its first group."""
        if not self.cut:
            return self
        return Fragment(self.a_ids, self.b_ids, np.concatenate([[self.a_head], self.a_counts]).astype(np.int64),
                        np.concatenate([[self.b_head], self.b_counts]).astype(np.int64), 0, 0, True)


def put_together(parts: list[Fragment]) -> Fragment:
    """Neighbouring fragments in order, by halves."""
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def id_type(*sizes: int) -> np.dtype:
    """The type ids of vocabularies of these sizes are stored in."""
    return np.dtype("<u2" if max(sizes) <= 1 << 16 else "<u4")


def id_lists(ids: np.ndarray, bounds: np.ndarray, kind: np.dtype) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [
        None, pa.py_buffer(bounds.astype(np.int64) * kind.itemsize), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())


def ids_of(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, one row after the other, and the bounds of each."""
    body, at = text_bytes(column)
    return body.view(kind).astype(np.int64), at // kind.itemsize


def count_lists(counts: np.ndarray, bounds: np.ndarray) -> pa.Array:
    counts = counts.astype(np.int64)
    if counts.max(initial=0) >= 255:
        extra = counts // 255
        bytes_ = np.full(len(counts) + int(extra.sum()), 255, np.uint8)
        ends = np.cumsum(extra + 1)
        bytes_[ends - 1] = counts % 255
        bounds = np.concatenate([[0], ends])[bounds]
    else:
        bytes_ = counts.astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(bytes_)]).cast(pa.binary())


def counts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    body, at = text_bytes(column)
    last = body < 255
    if last.all():
        return body.astype(np.int64), at
    ends = np.flatnonzero(last) + 1
    return np.add.reduceat(body.astype(np.int64), np.concatenate([[0], ends[:-1]])), np.concatenate([[0], np.cumsum(last)])[at]


def fragment_rows(rows: list, fragments: list[Fragment], kind: np.dtype) -> pa.RecordBatch:
    """``rows`` are ``(row, doc_id, part, parts)``; a fragment without a common end has a head of -1."""
    made = [pa.array(x, pa.int64()) for x in zip(*rows)]
    for name in ("a_ids", "b_ids", "a_counts", "b_counts"):
        values = [np.asarray(getattr(f, name), np.int64) for f in fragments]
        flat, bounds = np.concatenate(values), np.concatenate([[0], np.cumsum([len(v) for v in values])])
        made.append(id_lists(flat, bounds, kind) if "ids" in name else count_lists(flat, bounds))
    made += [pa.array([getattr(f, n) if f.cut else -1 for f in fragments], pa.int32()) for n in ("a_head", "b_head")]
    return pa.RecordBatch.from_arrays(made, names=["row", "doc_id", "part", "parts", "a_ids", "b_ids", "a_counts", "b_counts", "a_head", "b_head"])


def fragments(docs: DataFrame, level_file: str, piece_file: str, size: int) -> DataFrame:
    """A row per byte range of ``size`` of each text; a text of one range is whole, with all of its groups."""
    def task(part):
        paths = tokenizer_path(level_file), tokenizer_path(piece_file)
        pieces = Pieces.of(paths[1])
        spelling = {"a": level_spelling(paths[0]), "b": piece_spelling(paths[1])}
        kind = id_type(*(len(x.sizes) for x in spelling.values()))
        texts = part.column(2)
        body, at = text_bytes(pa.array([" " + t if t else "" for t in texts.to_pylist()], pa.large_string()))
        a_ids, a_bounds = Encoder.of(paths[0]).batch(texts, lead=True)
        b_ids, b_bounds = pieces.batch([t or "" for t in texts.to_pylist()])
        good = (np.diff(at) > 0) & spelling["a"].spelled(a_ids, a_bounds, body, at) & spelling["b"].spelled(b_ids, b_bounds, body, at)
        a_ids, b_ids = a_ids[np.repeat(good, np.diff(a_bounds))], b_ids[np.repeat(good, np.diff(b_bounds))]
        a_bounds, b_bounds = (np.concatenate([[0], np.cumsum(np.diff(x) * good)]) for x in (a_bounds, b_bounds))
        # All texts stand one after the other, and the end of each is a common one.
        total = np.concatenate([[0], np.cumsum(np.diff(at) * good)])
        a_ends, b_ends = np.cumsum(spelling["a"].sizes[a_ids]), np.cumsum(spelling["b"].sizes[b_ids])
        rows, doc_ids = part.column(0).to_pylist(), part.column(1).to_pylist()
        parts = np.maximum(1, -(-np.diff(total) // size))
        once = np.flatnonzero(parts == 1)
        a_mark, b_mark = (np.zeros(int(total[-1]) + 1, bool) for _ in range(2))
        a_mark[a_ends], b_mark[b_ends] = True, True
        cuts = np.flatnonzero(a_mark & b_mark)
        a_at, b_at = np.cumsum(a_mark)[cuts], np.cumsum(b_mark)[cuts]
        a_counts, b_counts = np.diff(a_at, prepend=0), np.diff(b_at, prepend=0)
        c_bounds = np.searchsorted(cuts, total, "right")
        made = [pa.array([rows[i] for i in once], pa.int64()), pa.array([doc_ids[i] for i in once], pa.int64()),
                pa.array(np.zeros(len(once), np.int64)), pa.array(np.ones(len(once), np.int64))]
        made += [id_lists(f, b, kind).take(pa.array(once)) for f, b in ((a_ids, a_bounds), (b_ids, b_bounds))]
        made += [count_lists(f, c_bounds).take(pa.array(once)) for f in (a_counts, b_counts)]
        made += [pa.array(np.zeros(len(once), np.int32))] * 2
        yield pa.RecordBatch.from_arrays(made, names=["row", "doc_id", "part", "parts", "a_ids", "b_ids", "a_counts", "b_counts", "a_head", "b_head"])
        for i in np.flatnonzero(parts > 1).tolist():
            a, b = slice(a_bounds[i], a_bounds[i + 1]), slice(b_bounds[i], b_bounds[i + 1])
            a_end, b_end = a_ends[a] - total[i], b_ends[b] - total[i]
            edges = np.arange(1, parts[i]) * size
            pieces_of = [np.split(x, np.searchsorted(ends, edges, "right")) for x, ends in
                         ((a_ids[a], a_end), (a_end, a_end), (b_ids[b], b_end), (b_end, b_end))]
            for k, tokens in enumerate(zip(*pieces_of)):
                yield fragment_rows([(rows[i], doc_ids[i], k, int(parts[i]))], [Fragment.of(*tokens)], kind)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_column())
    return map_batches(numbered, task, FRAGMENTS, SLICE)


def reduced(parts: DataFrame, fan: int, kind: np.dtype) -> DataFrame:
    """Each ``fan`` neighbouring fragments of a text put together; the last one of a text is whole."""
    spark = parts.sparkSession
    ship_package(spark)

    def task(batches):
        for table in grouped(batches, ["row", "node"]):
            table = table.sort_by("part")
            flags = [table.column(n).to_pylist() for n in ("a_head", "b_head")]
            columns = []
            for name in ("a_ids", "b_ids", "a_counts", "b_counts"):
                column = table.column(name).combine_chunks()
                flat, bounds = ids_of(column, kind) if "ids" in name else counts_of(column)
                columns.append([flat[x:y] for x, y in zip(bounds, bounds[1:])])
            found = put_together([Fragment(*x, max(h, 0), max(k, 0), h >= 0) for *x, h, k in zip(*columns, *flags)])
            left = -(-table.column("parts")[0].as_py() // fan)
            head = tuple(table.column(n)[0].as_py() for n in ("row", "doc_id", "node"))
            yield fragment_rows([(*head, left)], [found.whole() if left == 1 else found], kind)

    dealt = parts.withColumn("node", F.floor(F.col("part") / fan)).repartition(partitions(spark), "row", "node").sortWithinPartitions("row", "node")
    return dealt.mapInArrow(task, FRAGMENTS)


def align(docs: DataFrame, scratch: Scratch, level_file: str = "byte_bpe_50k.json", piece_file: str = "piece_bpe_32k.model",
          size: int = RANGE, fan: int = FAN) -> DataFrame:
    """``ALIGNED``: of every row of ``docs`` (``doc_id, text``) the ids of both kinds, and how many of each a group has.

    ``row`` numbers the rows. The result is a written table.
    """
    kind = id_type(len(level_spelling(tokenizer_path(level_file)).sizes), len(piece_spelling(tokenizer_path(piece_file)).sizes))
    found = scratch.table(fragments(docs, level_file, piece_file, size), "fragments-0")
    columns = ["row", "doc_id", "a_ids", "b_ids", "a_counts", "b_counts"]
    done, left, round_ = found.where("parts = 1").select(*columns), found.where("parts > 1"), 0
    while not left.isEmpty():
        round_ += 1
        found = scratch.table(reduced(left, fan, kind), f"fragments-{round_}")
        done = done.unionAll(found.where("parts = 1").select(*columns))
        left = found.where("parts > 1")
    return done


def linked(part: pa.RecordBatch, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row of the batch, A id, B id`` of all links, in order.

    Between two neighbouring ends of either kind lie bytes of one A token and one B token, and any two that overlap do
    so in one such place.
    """
    kind = id_type(len(a_sizes), len(b_sizes))
    (a_ids, a_bounds), (b_ids, _) = ids_of(part.column("a_ids"), kind), ids_of(part.column("b_ids"), kind)
    a_ends, b_ends = np.cumsum(a_sizes[a_ids]), np.cumsum(b_sizes[b_ids])
    a_mark, b_mark = (np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 0, bool) for _ in range(2))
    a_mark[a_ends], b_mark[b_ends] = True, True
    ends = np.flatnonzero(a_mark | b_mark)
    a, b = (np.cumsum(m[ends]) - m[ends] for m in (a_mark, b_mark))
    return np.searchsorted(a_bounds, a, "right") - 1, a_ids[a], b_ids[b]


def pair_counts(aligned: DataFrame, a_sizes: np.ndarray, b_sizes: np.ndarray, bound: int = 1 << 20) -> DataFrame:
    """``a, b, n``: in how many rows the ids are linked. A task holds ``bound`` pairs and those of a slice at most."""
    width = len(b_sizes)

    def added(parts):
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        keys, slot = np.unique(keys, return_inverse=True)
        return keys, np.bincount(slot, weights=counts, minlength=len(keys)).astype(np.int64)

    def rows(keys, counts):
        for at in range(0, len(keys), 1 << 16):
            some = keys[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some // width), pa.array(some % width), pa.array(counts[at:at + (1 << 16)])], names=["a", "b", "n"])

    def task(batches):
        held = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for batch in batches:
            for part in slices(batch, IDS):
                row, a, b = linked(part, a_sizes, b_sizes)
                once = np.unique(row * (len(a_sizes) * width) + a * width + b) % (len(a_sizes) * width)
                held = [added([*held, (once, np.ones(len(once), np.int64))])]
                if len(held[0][0]) > bound:
                    yield from rows(*held.pop())
                    held = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        yield from rows(*held[0])

    ship_package(aligned.sparkSession)
    return aligned.select("a_ids", "b_ids").mapInArrow(task, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


@lru_cache
def decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How long the numbers below ``n`` are, where each stands in a table of bytes, and the table, with ``,|;`` at its end."""
    shown = [str(i).encode() for i in range(n)]
    width = np.fromiter(map(len, shown), np.int64, n)
    return width, np.cumsum(width) - width, np.frombuffer(b"".join(shown) + b",|;", np.uint8)


def group_texts(part: pa.RecordBatch, kind: np.dtype) -> tuple[bytes, np.ndarray]:
    """The groups of all rows as ``a1,a2|b1;a3|b2,b3``, one row after the other, and the bounds of each."""
    a_ids, b_ids = (ids_of(part.column(n), kind)[0] for n in ("a_ids", "b_ids"))
    (a_counts, bounds), (b_counts, _) = (counts_of(part.column(n)) for n in ("a_counts", "b_counts"))
    n = len(a_counts)
    sizes = np.stack([a_counts, b_counts], axis=1).ravel()
    ids = np.empty(int(sizes.sum()), np.int64)
    of_a = np.repeat(np.tile([True, False], n), sizes)
    ids[of_a], ids[~of_a] = a_ids, b_ids
    sign = np.full(len(ids), ord(","), np.uint8)
    ends = np.cumsum(sizes) - 1
    sign[ends[0::2]], sign[ends[1::2]] = ord("|"), ord(";")
    # Nothing stands behind the last group of a row.
    last = bounds[1:][np.diff(bounds) > 0] - 1
    signs = np.ones(len(ids), np.int64)
    signs[ends[1::2][last]] = 0
    width, heads, pool = decimals(1 << max(16, int(ids.max(initial=0)).bit_length()))
    place = np.searchsorted(np.array([ord(","), ord(";"), ord("|")]), sign)
    at = np.array([len(pool) - 3, len(pool) - 1, len(pool) - 2])[place]
    flat = pool[spread_runs(np.stack([heads[ids], at], axis=1).ravel(), np.stack([width[ids], signs], axis=1).ravel())].tobytes()
    edge = np.concatenate([[0], np.cumsum(width[ids] + signs)])
    tokens = np.concatenate([[0], np.cumsum(a_counts + b_counts)])
    return flat, edge[tokens[bounds]]


def summary(aligned: DataFrame, counts: DataFrame, a_sizes: np.ndarray, b_sizes: np.ndarray, pairs: int = PAIRS) -> DataFrame:
    """``SUMMARY`` of each row of ``ALIGNED``; ``counts`` is a written table ``a, b, n``.

    ``n_best`` are the links whose count no other pair of their A id exceeds, ``count_sum`` adds up the counts of all links.
    """
    spark = aligned.sparkSession
    ship_package(spark)
    width = len(b_sizes)
    # A row for each id of A at most.
    per_id = counts.groupBy("a").agg(F.count("*").alias("k"), F.max("n").alias("top")).orderBy("a").toArrow()
    ids, filled = per_id["a"].to_numpy(), np.cumsum(per_id["k"].to_numpy())
    area = (filled - 1) // pairs if len(filled) else np.empty(0, np.int64)
    edges = [0, *ids[np.flatnonzero(np.diff(area)) + 1].tolist(), len(a_sizes)]
    top = np.zeros(len(a_sizes), np.int64)
    top[ids] = per_id["top"].to_numpy()
    reads = [read(aligned, counts.where((F.col("a") >= low) & (F.col("a") < high)), top, a_sizes, b_sizes, width, low, high)
             for low, high in zip(edges, edges[1:])]
    if len(reads) == 1:
        return reads[0]
    both = reads[0]
    for more in reads[1:]:
        both = both.unionAll(more.withColumns({n: F.lit(None).cast(t) for n, t in both.dtypes if n not in ("row", "n_best", "count_sum")}))
    names = [n for n in both.columns if n != "row"]
    return both.groupBy("row").agg(*(F.sum(n).alias(n) if n in ("n_best", "count_sum") else F.max(n).alias(n) for n in names))


def read(aligned: DataFrame, counts: DataFrame, top: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, width: int, low: int, high: int) -> DataFrame:
    """``SUMMARY`` with the counts of the A ids from ``low`` to ``high - 1`` only."""
    table = counts.toArrow()
    keys, n = table["a"].to_numpy() * width + table["b"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(keys)
    # No more than ``PAIRS`` and those of one id.
    sent = aligned.sparkSession.sparkContext.broadcast((keys[order], n[order]))

    def task(part):
        keys, n = sent.value
        row, a, b = linked(part, a_sizes, b_sizes)
        total = np.bincount(row, minlength=part.num_rows)
        mine = (a >= low) & (a < high)
        row, a, b = row[mine], a[mine], b[mine]
        count = n[np.searchsorted(keys, a * width + b)] if len(a) else np.empty(0, np.int64)
        best = np.bincount(row[count == top[a]], minlength=part.num_rows)
        ends = np.concatenate([[0], np.cumsum(count)])
        sums = np.diff(ends[np.searchsorted(row, np.arange(part.num_rows + 1))])
        kind = id_type(len(a_sizes), len(b_sizes))
        flat, bounds = group_texts(part, kind)
        shown = memoryview(flat)
        marks = [hashlib.sha256(shown[x:y]).hexdigest() if y > x else "" for x, y in zip(bounds.tolist(), bounds[1:].tolist())]
        sizes = [pa.array(np.diff(x)) for x in (ids_of(part.column("a_ids"), kind)[1], ids_of(part.column("b_ids"), kind)[1],
                                                counts_of(part.column("a_counts"))[1])]
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("doc_id"), *sizes, pa.array(total), pa.array(best), pa.array(sums), pa.array(marks, pa.string())],
            names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return map_batches(aligned, task, SUMMARY, IDS)


def groups(aligned: DataFrame, level_file: str = "byte_bpe_50k.json", piece_file: str = "piece_bpe_32k.model") -> DataFrame:
    """``row, doc_id, groups``: each row's groups as ``a1,a2|b1;a3|b2,b3``, empty without tokens."""
    kind = id_type(len(level_spelling(tokenizer_path(level_file)).sizes), len(piece_spelling(tokenizer_path(piece_file)).sizes))

    def task(part):
        flat, bounds = group_texts(part, kind)
        edges = bounds.tolist()
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("doc_id"), pa.array([flat[x:y].decode() for x, y in zip(edges, edges[1:])], pa.string())],
            names=["row", "doc_id", "groups"])

    return map_batches(aligned, task, "row long, doc_id long, groups string", IDS)


def align_and_count(docs: DataFrame, level_file: str = "byte_bpe_50k.json", piece_file: str = "piece_bpe_32k.model", size: int = RANGE,
                    fan: int = FAN, pairs: int = PAIRS) -> DataFrame:
    """``SUMMARY`` of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "alignment")
    aligned = align(docs, scratch, level_file, piece_file, size, fan)
    a_sizes, b_sizes = level_spelling(tokenizer_path(level_file)).sizes, piece_spelling(tokenizer_path(piece_file)).sizes
    counts = scratch.table(pair_counts(aligned, a_sizes, b_sizes), "counts")
    return summary(aligned, counts, a_sizes, b_sizes, pairs)
