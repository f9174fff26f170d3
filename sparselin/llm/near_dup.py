"""Near-duplicate documents: MinHash bands for candidates, odd sketches to screen them, full sets to confirm.

A document is its set of distinct shingles of lower-cased (A to Z) words; with fewer words than a shingle the
whole sequence is the one shingle. Two documents are linked if 100 * intersection >= percent * union.

Equal sets are one class, found by a 128-bit fingerprint, and only its smallest id goes on. ``BANDS`` bands of
``BAND_ROWS`` MinHash samples put classes into buckets; at a similarity of 0.8 a pair shares no bucket with a
probability of 5e-5, at 0.85 of 8e-7. The samples are also folded into an odd sketch of ``SKETCH_BITS`` bits:
each flips a bit, so the bits in which two sketches differ tell in how many samples the documents do. Pairs
whose estimate lies more than ``SLACK``, six standard errors, below the threshold are not looked at further.

Links are found in two steps, neither of which has all pairs as rows. First each class is compared with the
smallest id among its buckets. Then, where classes that share buckets are still of several components, those
outside the largest one meet all others in blocks of about ``BLOCK`` classes, which spread over tasks. A meeting
compares sketches, then full sets, of members of different components, and gives only links that join two of
them, fewer than it has members. After that every pair of a bucket is linked, refuted or joined already, so
components are what all links would give.

Rows: a null or wordless text has an empty set, which is linked with nothing; a null id keeps a null component
and stays; repeated rows are of one class, and rows of one id count as one document; other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.llm.components import components
from sparselin.llm.store import Scratch, map_batches, partitions
from sparselin.llm.words import LOWER, U64, chain, join, mix, spread_runs, words_of
from sparselin.session import ship_package

BANDS, BAND_ROWS = 24, 5
SKETCH_BITS = 512
SLACK = 0.22
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
SIGNATURES = "doc_id long, n_shingles long, f long, g long, bands array<bigint>, sketch binary"


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, shingle hash)`` of each distinct shingle, in that order."""
    words = words_of(texts, LOWER)
    hashes = words.hashes()
    counts, owner = words.counts(), words.owner()
    found = words.windows(size)
    texts_of, shingles = [owner[found]], [chain(hashes, size)[found]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            texts_of.append(short)
            shingles.append(chain(hashes, n, salt=n)[words.bounds[short]])
    owner, values = np.concatenate(texts_of), np.concatenate(shingles)
    order = np.argsort(values)
    order = order[np.argsort(owner[order], kind="stable")]
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[new], values[new]


def seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Set size, fingerprint, bucket of each band and odd sketch of every document."""
    def task(part):
        n = part.num_rows
        owner, values = shingle_sets(part.column(1), size)
        counts = np.bincount(owner, minlength=n)
        filled = np.flatnonzero(counts)
        starts = np.searchsorted(owner, filled)
        least = np.empty((BANDS * BAND_ROWS, len(filled)), U64)
        f = np.zeros((2, n), U64)
        bands = np.zeros((n, BANDS), U64)
        parity = np.zeros((n, SKETCH_BITS), np.uint8)
        if len(filled):
            for k, seed in enumerate(seeds(BANDS * BAND_ROWS)):
                least[k] = np.minimum.reduceat((values ^ seed) * (seed | U64(1)), starts)
            for i in range(2):
                f[i, filled] = np.add.reduceat(mix(values + U64(i + 1)), starts)
            for band in range(BANDS):
                key = np.full(len(filled), band, U64)
                for row in range(BAND_ROWS):
                    key = join(key, least[band * BAND_ROWS + row])
                bands[filled, band] = key
            bit = (mix(least + seeds(len(least))[:, None]) % U64(SKETCH_BITS)).astype(np.int64)
            hits = np.bincount((np.arange(len(filled)) * SKETCH_BITS + bit).ravel(), minlength=len(filled) * SKETCH_BITS)
            parity[filled] = (hits & 1).reshape(-1, SKETCH_BITS)
        flat = pa.array(bands.ravel().view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(counts), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)),
             pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), flat),
             pa.array([x.tobytes() for x in np.packbits(parity, axis=1)], pa.binary())],
            names=["doc_id", "n_shingles", "f", "g", "bands", "sketch"])

    return map_batches(docs.select("doc_id", "text"), task, SIGNATURES, 1 << 21)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of bits in which two odd sketches differ."""
    samples = BANDS * BAND_ROWS
    left = np.maximum(1 - 2 * differing / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * samples) * np.log(left)


def bits_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(-1, SKETCH_BITS // 64)


def screened(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sketches allow the threshold."""
    def task(part):
        differing = np.bitwise_count(bits_of(part.column(2)) ^ bits_of(part.column(3))).sum(axis=1)
        yield part.select(["a", "b"]).filter(pa.array(estimate(differing) >= percent / 100 - SLACK))

    one, other = (sketches.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    return map_batches(pairs.join(one, "a").join(other, "b").select("a", "b", "sa", "sb"), task, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are links by their full sets."""
    def task(part):
        both = [shingle_sets(part.column(k), size) for k in (2, 3)]
        n = part.num_rows
        sizes = [np.bincount(o, minlength=n) for o, _ in both]
        owner, values = (np.concatenate(x) for x in zip(*both))
        order = np.argsort(values)
        order = order[np.argsort(owner[order], kind="stable")]
        owner, values = owner[order], values[order]
        common = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (values[1:] == values[:-1])], minlength=n)
        yield part.select(["a", "b"]).filter(pa.array(100 * common >= percent * (sizes[0] + sizes[1] - common)))

    one, other = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return map_batches(pairs.join(one, "a").join(other, "b").select("a", "b", "ta", "tb"), task, "a long, b long", 1 << 21)


def grouped(batches, keys: list[str]):
    """Tables of the rows with equal keys, from batches sorted by them; a group may span batches."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        values = np.stack([table.column(c).to_numpy() for c in keys])
        edges = np.concatenate([[0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield table.slice(a, b - a)
        held = table.slice(int(edges[-1]))
    if held is not None and len(held):
        yield held


def meeting(table: pa.Table, size: int, percent: int) -> list[tuple[int, int]]:
    """Links that join components within one meeting of queries and targets, by their full sets."""
    ids, names, asks = (table.column(c).to_numpy() for c in ("doc_id", "component", "asks"))
    names, bits = names.copy(), bits_of(table.column("sketch"))
    owner, values = shingle_sets(table.column("text").combine_chunks(), size)
    sizes = np.bincount(owner, minlength=len(ids))
    starts = np.cumsum(sizes) - sizes
    distinct, place = np.unique(values, return_inverse=True)
    mark = np.zeros(len(distinct), bool)
    targets, out = np.flatnonzero(asks == 0), []
    for i in np.flatnonzero(asks == 1).tolist():
        others = targets[names[targets] != names[i]]
        # No intersection is larger than the smaller set, nor a union smaller than the larger one.
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
        differing = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1)
        others = others[estimate(differing) >= percent / 100 - SLACK]
        if not len(others):
            continue
        mine = place[starts[i]:starts[i] + sizes[i]]
        mark[mine] = True
        hits = mark[place[spread_runs(starts[others], sizes[others])]]
        common = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        mark[mine] = False
        linked = others[100 * common >= percent * (sizes[others] + sizes[i] - common)]
        for name in np.unique(names[linked]).tolist():
            other = linked[names[linked] == name][0]
            out.append((int(min(ids[i], ids[other])), int(max(ids[i], ids[other]))))
            names[names == name] = names[i]
    return out


def remaining_links(members: DataFrame, standing: DataFrame, texts: DataFrame, names: DataFrame, scratch: Scratch,
                    size: int, percent: int) -> DataFrame:
    """``a, b``: links that join the components of a family, as far as the stars have left it in several.

    A family is what shares buckets, directly or over others, so it holds every pair of a bucket. The members
    outside its largest component are the queries, all members the targets, both in blocks.
    """
    spark = members.sparkSession
    ship_package(spark)
    families = components(members.select(F.col("doc_id").alias("a"), F.col("first").alias("b")), scratch, "families")
    placed = (families.select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
              .join(names.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
              .join(standing.select("doc_id", "n_shingles"), "doc_id")
              .select("doc_id", "family", F.coalesce("component", "doc_id").alias("component"), "n_shingles"))
    parts = placed.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    large = F.max(F.struct("n", "component", "s"))
    mixed = parts.groupBy("family").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), large.alias("large")).where("k > 1")

    def blocks(n, s):
        return F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES, F.lit(1.0))).cast("long")

    mixed = mixed.select("family", F.col("large.component").alias("large"), blocks(F.col("n"), F.col("s")).alias("target_blocks"),
                         blocks(F.col("n") - F.col("large.n"), F.col("s") - F.col("large.s")).alias("query_blocks"))
    met = placed.join(mixed, "family").withColumn("h", F.xxhash64("doc_id"))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = met.where("component <> large").select(
        "doc_id", "component", "family", F.pmod("h", "query_blocks").alias("q"), everywhere("target_blocks").alias("t"), F.lit(1).alias("asks"))
    targets = met.select(
        "doc_id", "component", "family", everywhere("query_blocks").alias("q"), F.pmod("h", "target_blocks").alias("t"), F.lit(0).alias("asks"))
    dealt = queries.unionAll(targets).join(standing.select("doc_id", "sketch"), "doc_id").join(texts, "doc_id")

    def task(batches):
        for table in grouped(batches, ["family", "q", "t"]):
            if links := meeting(table, size, percent):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])

    dealt = dealt.repartition(partitions(spark), "family", "q", "t").sortWithinPartitions("family", "q", "t")
    return dealt.mapInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest id reachable over links, ``kept`` whether it is the own one.
    """
    scratch = Scratch(docs.sparkSession, "near-dup")
    signed = scratch.table(signatures(docs, shingle), "signatures")
    usable = signed.where("doc_id is not null and n_shingles > 0")
    # One class for each set; its smallest id stands for it.
    classes = scratch.table(usable.groupBy("f", "g", "n_shingles").agg(F.min("doc_id").alias("doc_id")), "classes")
    standing = scratch.table(usable.join(classes.select("doc_id", "f", "g"), ["doc_id", "f", "g"], "left_semi")
                             .select("doc_id", "n_shingles", "bands", "sketch"), "standing")
    exploded = standing.select("doc_id", F.explode("bands").alias("bucket"))
    full = exploded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").drop("n")
    members = scratch.table(exploded.join(full, "bucket"), "members")
    wanted = members.select("doc_id").distinct()
    texts = scratch.table(docs.where("doc_id is not null").select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), "texts")
    stars = members.where("doc_id <> first").groupBy("doc_id").agg(F.min("first").alias("a")).select("a", F.col("doc_id").alias("b"))
    links = scratch.table(confirmed(screened(stars, standing, percent), texts, shingle, percent), "links-1")
    names = components(links, scratch, "stars")
    more = scratch.table(remaining_links(members, standing, texts, names, scratch, shingle, percent), "links-2")
    names = components(links.unionAll(more), scratch, "all")
    scratch.drop("members", "texts")
    named = classes.join(names.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "f", "g", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    return signed.select("doc_id", "n_shingles", "f", "g").join(named, ["f", "g", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
