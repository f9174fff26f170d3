"""Similarity join of documents by word n-grams: parity sketches, joined by pieces, confirmed on full sets.

A document is its set of distinct shingles of lower-cased (A to Z) words; with fewer words than a shingle the whole
sequence is the one shingle. Two documents link if 100 * intersection >= percent * union, that is if at most
floor((100 - percent) * (n + m) / (100 + percent)) shingles are in one of them only, for sets of n and m.

The parity sketch of a set has a bit for each value of the shingle hashes' upper bits, flipped by every shingle that has
it. The sketches of two sets differ in no more bits than there are shingles in one set only.

Sizes are cut into bands, each ``100 / percent`` times as wide as it starts, so that linked sets lie in one band or in
neighbouring ones. A scheme joins a band and the next: by the largest difference of a link in it, sketches are cut
into so many pieces that a link leaves ``spare + 1`` pieces untouched, whose hashes are the join keys. A piece of few
shingles is light, and many sets share it by chance; a set with no more than ``spare`` light pieces leaves them out, and
still shares a piece with each of its links, since an untouched piece is as light in both. A set with more keeps all.

Equal sets are one class, found by a 128-bit fingerprint, whose smallest id goes on. Links are then found without
listing the pairs of a piece: all classes of a piece are first compared with its smallest and its largest id, by
sketches, then by full sets; that settles pieces of up to three classes. Pieces whose other classes are then of
several components are open, and the open pieces of one smallest id are a star. Stars that share classes are a family, which
meets whole, by scheme, if that compares fewer pairs than its stars do by themselves. In a large table pieces shared by
chance tie most open classes to one family, while a star has no more than the classes that share a piece with one.
They meet in blocks of ``BLOCK`` classes with their sketches only. A meeting
compares those outside the largest component with the others, and proposes for each class and foreign component the
closest pair that the sketches allow. Proposals are confirmed on full sets. Where a proposal is refuted, the classes meet
again, with more proposals each time, until none is refuted: then every pair that shares a piece is linked, refuted,
or joined by others, and the components are those of all links. Texts are read again for proposed pairs only.

Rows: a null or wordless text has an empty set, which is linked with nothing; a null id keeps a null component; rows of
one id count as one document, and equal rows are of one class; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.llm.components import components
from sparselin.llm.near_dup import confirmed, shingle_sets
from sparselin.llm.store import Scratch, map_batches, partitions
from sparselin.llm.words import U64, join, mix, spread_runs
from sparselin.session import is_small, ship_package

# Bits of a sketch for each shingle of the largest set it serves, about: between this and twice as many.
BITS = 4
# Classes of a block.
BLOCK = 4096
# Meetings of at most so many rows are looked through together for pairs that the sketches allow.
ALONE = 64
# Proposals a class makes to a foreign component grow by this from round to round.
MORE = 16
SIGNED = "doc_id long, n_shingles long, f long, g long, sketch binary, keys array<bigint>"


def largest_difference(total, percent: int):
    """How many shingles two linked sets of ``total`` shingles together have in one of them only, at most."""
    return (100 - percent) * total // (100 + percent)


@dataclass
class Schemes:
    """Scheme ``i`` serves the sizes ``low[i]`` to ``high[i + 1]``, two bands."""

    low: np.ndarray
    high: np.ndarray
    pieces: np.ndarray
    spare: np.ndarray
    light: np.ndarray
    log_bits: np.ndarray

    @classmethod
    def of(cls, percent: int, largest: int) -> Schemes:
        low, high = [1], [100 // percent]
        while len(high) < 2 or high[-2] < largest:
            low.append(high[-1] + 1)
            high.append(low[-1] * 100 // percent)
        rows = []
        for i in range(len(low) - 1):
            needed = int(largest_difference(high[i] + high[i + 1], percent)) + 1
            mean = low[i] / needed
            light = max(1, int(mean / 4))
            expected = needed * exp(-mean) * sum(mean ** k / factorial(k) for k in range(light))
            spare = 1 + ceil(expected + 3 * sqrt(expected)) if needed > 1 else 0
            rows.append((needed + spare, spare, light, max(6, ceil(np.log2(BITS * high[i + 1])))))
        return cls(np.array(low[:-1]), np.array(high[:-1]), *(np.array(x, np.int64) for x in zip(*rows)))

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, sizes)


def positions(values: np.ndarray, log_bits: np.ndarray) -> np.ndarray:
    return (values >> (64 - log_bits).astype(U64)).astype(np.int64)


def piece_keys(schemes: Schemes, scheme: np.ndarray, owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(set, key)`` of the pieces of ``n`` sets by one scheme each; shingles are sorted by set and value, -1 is no scheme."""
    served = scheme[owner] >= 0
    owner, values = owner[served], values[served]
    own = scheme[owner]
    at = positions(values, schemes.log_bits[own])
    piece = at * schemes.pieces[own] >> schemes.log_bits[own]
    heads = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0))
    # A bit that is flipped twice adds nothing, so this is a function of the sketch.
    content = np.bitwise_xor.reduceat(mix(at.astype(U64) + U64(1)), heads) if len(heads) else np.empty(0, U64)
    size = np.diff(np.append(heads, len(owner)))
    owner, piece = owner[heads], piece[heads]
    # Pieces without a shingle are light as well.
    used = np.flatnonzero(scheme >= 0)
    pieces = np.zeros(n, np.int64)
    pieces[used] = schemes.pieces[scheme[used]]
    heavy = size >= schemes.light[scheme[owner]]
    n_light = pieces - np.bincount(owner[heavy], minlength=n)
    spare = np.zeros(n, np.int64)
    spare[used] = schemes.spare[scheme[used]]
    all_kept = (n_light > spare) & (pieces > 0)
    if all_kept.any():
        whole = np.flatnonzero(all_kept)
        absent = np.repeat(whole, pieces[whole])
        place = np.arange(len(absent)) - np.repeat(np.cumsum(pieces[whole]) - pieces[whole], pieces[whole])
        there = np.isin(absent * (pieces.max() + 1) + place, owner * (pieces.max() + 1) + piece)
        owner, piece = np.concatenate([owner, absent[~there]]), np.concatenate([piece, place[~there]])
        content = np.concatenate([content, np.zeros(int((~there).sum()), U64)])
        heavy = np.concatenate([heavy, np.zeros(int((~there).sum()), bool)])
        heavy |= all_kept[owner]
    key = join(content, scheme[owner].astype(U64) << U64(32) | piece.astype(U64), salt=11)
    return owner[heavy], key[heavy]


def parity_bits(owner: np.ndarray, values: np.ndarray, log_bits: np.ndarray) -> list[bytes]:
    """The sketch of each set; shingles are sorted by set and value."""
    sizes = np.int64(1) << log_bits
    starts = np.cumsum(sizes) - sizes
    at = starts[owner] + positions(values, log_bits[owner])
    heads = np.flatnonzero(np.diff(at, prepend=-1))
    odd = np.diff(np.append(heads, len(at))) % 2 == 1
    bits = np.zeros(int(sizes.sum()), np.uint8)
    bits[at[heads[odd]]] = 1
    raw, edges = np.packbits(bits).tobytes(), (starts // 8).tolist()
    return [raw[a:b] for a, b in zip(edges, [*edges[1:], len(raw)])]


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of ``size`` bytes; of a longer one neighbouring bits are joined by parity."""
    out = np.empty((len(sketches), size), np.uint8)
    lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        bits = np.frombuffer(b"".join([sketches[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), length)
        if length > size:
            bits = np.packbits(np.bitwise_xor.reduce(np.unpackbits(bits, axis=1).reshape(len(rows), 8 * size, -1), axis=2), axis=1)
        out[rows] = bits
    return out.view(U64)


def signed_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Set size, fingerprint, sketch and join keys of every document."""
    def task(part):
        n = part.num_rows
        owner, values = shingle_sets(part.column(1), size)
        counts = np.bincount(owner, minlength=n)
        schemes = Schemes.of(percent, int(counts.max(initial=1)))
        filled = np.flatnonzero(counts)
        f = np.zeros((2, n), U64)
        if len(filled):
            starts = np.searchsorted(owner, filled)
            for i in range(2):
                f[i, filled] = np.add.reduceat(mix(values + U64(i + 1)), starts)
        band = np.where(counts > 0, schemes.band(counts), -1)
        keyed = [piece_keys(schemes, scheme, owner, values, n) for scheme in (band, np.where(band > 0, band - 1, -1))]
        holder, key = (np.concatenate(x) for x in zip(*keyed))
        order = np.argsort(holder, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(holder, minlength=n))])
        # An empty set has a sketch of the least size.
        sketch = parity_bits(owner, values, np.where(band >= 0, schemes.log_bits[band], 6))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(counts), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), pa.array(sketch, pa.binary()),
             pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(key[order].view(np.int64)))],
            names=["doc_id", "n_shingles", "f", "g", "sketch", "keys"])

    return map_batches(docs.select("doc_id", "text"), task, SIGNED, 1 << 21)


def distances(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """In how many bits the sketches of pairs differ."""
    out = np.empty(len(one), np.int64)
    widths = np.fromiter((min(len(a), len(b)) for a, b in zip(one, other)), np.int64, len(one))
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width).tolist()
        a, b = folded([one[i] for i in rows], width), folded([other[i] for i in rows], width)
        out[rows] = np.bitwise_count(a ^ b).sum(axis=1)
    return out


def allowed(pairs: DataFrame, standing: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sketches do not rule a link out."""
    def task(part):
        total = part.column(4).to_numpy() + part.column(5).to_numpy()
        apart = distances(part.column(2).to_pylist(), part.column(3).to_pylist())
        yield part.select(["a", "b"]).filter(pa.array(apart <= largest_difference(total, percent)))

    one, other = (standing.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}")) for c in "ab")
    met = pairs.join(one, "a").join(other, "b")
    met = met.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return map_batches(met.select("a", "b", "sa", "sb", "na", "nb"), task, "a long, b long")


def whole_groups(batches, keys: list[str]):
    """Tables of whole groups of rows with equal keys and the bounds of the groups, from batches sorted by the keys."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        values = np.stack([table.column(c).to_numpy() for c in keys])
        edges = np.concatenate([[0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1])
        last = int(edges[-1])
        if last:
            yield table.slice(0, last), edges
        held = table.slice(last)
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def promising(table: pa.Table, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Which meetings ``bounds[k]:bounds[k + 1]`` have a pair that the sketches allow, or more than ``ALONE`` rows."""
    names, asks, sizes = (table.column(c).to_numpy() for c in ("component", "asks", "n_shingles"))
    sketches = table.column("sketch").to_pylist()
    length = np.fromiter(map(len, sketches), np.int64, len(sketches))
    rows = np.diff(bounds)
    out = rows > ALONE
    meeting = np.repeat(np.arange(len(rows)), rows)
    asking = np.flatnonzero((asks > 0) & ~out[meeting])
    one, other = np.repeat(asking, rows[meeting[asking]]), spread_runs(bounds[meeting[asking]], rows[meeting[asking]])
    fits = (asks[other] != 1) & (names[one] != names[other]) & ((asks[other] == 0) | (one < other))
    fits &= 100 * np.minimum(sizes[one], sizes[other]) >= percent * np.maximum(sizes[one], sizes[other])
    one, other = one[fits], other[fits]
    width = np.minimum(length[one], length[other])
    for w in np.unique(width).tolist():
        a, b = one[width == w], other[width == w]
        used = np.unique(np.concatenate([a, b]))
        bits = folded([sketches[i] for i in used.tolist()], w)
        step = max(1, (1 << 22) // w)
        for at in range(0, len(a), step):
            i, j = a[at:at + step], b[at:at + step]
            apart = np.bitwise_count(bits[np.searchsorted(used, i)] ^ bits[np.searchsorted(used, j)]).sum(axis=1, dtype=np.int64)
            out[meeting[i[apart <= largest_difference(sizes[i] + sizes[j], percent)]]] = True
    return out


def proposals(table: pa.Table, percent: int, most: int) -> list[tuple[int, int]]:
    """Pairs of one meeting that the sketches allow: of each asking class and foreign component the ``most`` closest.

    ``asks`` is 0 for a class that answers, 1 for one that asks, 2 for both. With one proposal the two components count as joined for the rest of the meeting.
    """
    ids, names, asks, sizes = (table.column(c).to_numpy() for c in ("doc_id", "component", "asks", "n_shingles"))
    names = names.copy()
    sketches = table.column("sketch").to_pylist()
    bits = folded(sketches, min(map(len, sketches)))
    refuted = table.column("refuted").to_pylist()
    targets, out = np.flatnonzero(asks != 1), []
    for i in np.flatnonzero(asks > 0).tolist():
        others = targets[names[targets] != names[i]]
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
        if refuted[i]:
            others = others[~np.isin(ids[others], refuted[i])]
        apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
        fits = apart <= largest_difference(sizes[others] + sizes[i], percent)
        others, apart = others[fits], apart[fits]
        if not len(others):
            continue
        order = np.lexsort((ids[others], apart, names[others]))
        others = others[order]
        new = np.flatnonzero(np.diff(names[others], prepend=names[others[0]] - 1))
        rank = np.arange(len(others)) - np.repeat(new, np.diff(np.append(new, len(others))))
        chosen = others[rank < most]
        out += [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for j in chosen.tolist()]
        if most == 1:
            names[np.isin(names, names[chosen])] = names[i]
    return out


def meetings(members: DataFrame, sketches: DataFrame, refuted: DataFrame, percent: int, most: int) -> DataFrame:
    """Proposed pairs ``a, b`` of ``members`` (``family, whole, doc_id, component, n_shingles``); ``refuted`` pairs are left out.

    Members of a whole family meet by scheme, so that only sizes that can link do; in a star they do anyway. Those
    outside the largest component of a meeting ask, all members answer, both in blocks that spread over tasks.
    """
    spark = members.sparkSession
    ship_package(spark)
    bands = np.asarray(Schemes.of(percent, 1 << 40).high).tolist()
    band = F.aggregate(F.array(*[F.lit(h) for h in bands]), F.lit(0), lambda n, h: n + (F.col("n_shingles") > h).cast("int"))
    schemes = F.when(F.col("whole"), F.array("band", F.col("band") - 1)).otherwise(F.array(F.lit(-1)))
    dealt = members.withColumn("band", band).withColumn("scheme", F.explode(schemes)).where("scheme >= 0 or not whole")
    parts = dealt.groupBy("family", "scheme", "component").agg(F.count("*").alias("n"))
    sums = parts.groupBy("family", "scheme").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("large")).where("k > 1")
    blocks = lambda n: F.ceil(F.greatest(n / BLOCK, F.lit(1.0))).cast("long")
    sums = sums.select("family", "scheme", F.col("large.component").alias("large"), blocks(F.col("n")).alias("answer_blocks"),
                       blocks(F.col("n") - F.col("large.n")).alias("ask_blocks"))
    met = dealt.join(sums, ["family", "scheme"]).withColumn("h", F.xxhash64("doc_id"))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["family", "scheme", "doc_id", "component", "n_shingles"]
    one_block = F.col("answer_blocks") == 1
    # In a meeting of one block a class is one row, whether it asks or not.
    at_once = met.where(one_block).select(
        *columns, F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("t"), F.when(F.col("component") != F.col("large"), 2).otherwise(0).alias("asks"))
    asking = met.where(~one_block & (F.col("component") != F.col("large"))).select(
        *columns, F.pmod("h", "ask_blocks").alias("q"), everywhere("answer_blocks").alias("t"), F.lit(1).alias("asks"))
    answering = met.where(~one_block).select(*columns, everywhere("ask_blocks").alias("q"), F.pmod("h", "answer_blocks").alias("t"), F.lit(0).alias("asks"))
    keys = ["family", "scheme", "q", "t"]
    known = refuted.select(F.col("a").alias("doc_id"), F.col("b").alias("other")).unionAll(refuted.select("b", "a"))
    together = at_once.unionAll(asking).unionAll(answering).join(sketches, ["doc_id", "n_shingles"]).join(
        known.groupBy("doc_id").agg(F.collect_list("other").alias("refuted")), "doc_id", "left")
    together = together.select(*keys, "doc_id", "component", "n_shingles", "sketch", "refuted", "asks")
    # Salted by the blocks, so that a large family spreads; no block has more than about BLOCK classes of either kind.
    together = together.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

    def task(batches):
        for table, bounds in whole_groups(batches, keys):
            for k in np.flatnonzero(promising(table, bounds, percent)).tolist():
                if pairs := proposals(table.slice(int(bounds[k]), int(bounds[k + 1] - bounds[k])), percent, most):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], names=["a", "b"])

    return together.mapInArrow(task, "a long, b long").distinct()


def gathered(stars: DataFrame, scratch: Scratch) -> DataFrame:
    """``family, whole, doc_id``: who meets, of distinct ``first, doc_id``.

    Stars that share classes meet as a whole where that is no more pairs than in all of them by themselves.
    """
    names = components(stars.select(F.col("doc_id").alias("a"), F.col("first").alias("b")), scratch, "families")
    names = names.select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    pairs = F.pow(F.count("*").cast("double"), F.lit(2))
    apart = stars.groupBy("first").agg(pairs.alias("pairs")).join(names.withColumnRenamed("doc_id", "first"), "first").groupBy("family").agg(
        F.sum("pairs").alias("apart"))
    whole = names.groupBy("family").agg(pairs.alias("pairs")).join(apart, "family").where("pairs <= apart").select("family")
    whole = scratch.table(names.join(whole, "family").select("family", F.lit(True).alias("whole"), "doc_id"), "whole")
    # All classes of a star are of one family.
    rest = stars.join(whole.select(F.col("doc_id").alias("first")), "first", "left_anti")
    return whole.unionAll(rest.select(F.col("first").alias("family"), F.lit(False).alias("whole"), "doc_id"))


def join_similar(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest id reachable over links, itself included.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard-join")
    signed = scratch.table(signed_sets(docs, shingle, percent), "signed")
    slim = scratch.table(signed.select("doc_id", "n_shingles", "f", "g"), "slim")
    usable = signed.where("doc_id is not null and n_shingles > 0")
    classes = scratch.table(slim.where("doc_id is not null and n_shingles > 0").groupBy("f", "g", "n_shingles").agg(F.min("doc_id").alias("doc_id")), "classes")
    first_rows = usable.join(classes.select("doc_id", "f", "g"), ["doc_id", "f", "g"], "left_semi")
    standing = scratch.table(first_rows.select("doc_id", "n_shingles", "sketch", "keys"), "standing")
    scratch.drop("signed")
    keyed = standing.select("doc_id", F.explode("keys").alias("piece"))
    shared = keyed.groupBy("piece").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("n > 1")
    shared = scratch.table(shared, "shared")
    ends = shared.where("n > 2").select("piece", "least", "most")
    inner = scratch.table(keyed.join(ends, "piece").where("doc_id <> least and doc_id <> most"), "inner")
    standing = standing.select("doc_id", "n_shingles", "sketch")

    def pairs_found(pairs: DataFrame) -> DataFrame:
        """The links among some pairs, by the full sets of their texts."""
        ids = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
        rows = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(ids) if is_small(ids) else ids, "doc_id", "left_semi")
        texts = scratch.table(rows, "texts")
        found = scratch.table(confirmed(pairs, texts, shingle, percent).distinct(), f"links-{len(found_links)}")
        scratch.drop("wanted", "texts")
        found_links.append(found)
        return found

    found_links: list[DataFrame] = []
    hubs = shared.select(F.col("least").alias("a"), F.col("most").alias("b")).unionAll(
        inner.select(F.col("least").alias("a"), F.col("doc_id").alias("b"))).unionAll(inner.select("doc_id", "most")).distinct()
    near = scratch.table(allowed(hubs, standing, percent), "allowed")
    names = components(pairs_found(near), scratch, "names-0")
    component = lambda df, names: df.join(names.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    open_ = component(inner.select("piece", "doc_id"), names).groupBy("piece").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("doc_id").alias("first")).where("low <> high")
    stars = scratch.table(inner.select("piece", "doc_id").join(open_.select("piece", "first"), "piece").select("doc_id", "first").distinct(), "open")
    families = scratch.table(gathered(stars, scratch).join(standing.select("doc_id", "n_shingles").distinct(), "doc_id"), "family-members")
    sketches = scratch.table(standing.join(stars.select("doc_id").distinct(), "doc_id", "left_semi"), "sketches")
    scratch.drop("shared", "inner", "open", "whole", "standing", "allowed")
    refuted, most, round_ = spark.createDataFrame([], "a long, b long"), 1, 0
    while not families.isEmpty():
        round_ += 1
        asked = scratch.table(meetings(component(families, names), sketches, refuted, percent, most), f"asked-{round_}")
        if asked.isEmpty():
            break
        denied = scratch.table(asked.join(pairs_found(asked), ["a", "b"], "left_anti"), f"denied-{round_}")
        names = components(reduce(DataFrame.unionAll, found_links), scratch, f"names-{round_}")
        refuted = refuted.unionAll(denied)
        # A meeting that made a proposal has both its classes.
        one, other = (families.select("family", "whole", F.col("doc_id").alias(c)) for c in "ab")
        again = denied.join(one, "a").join(other, ["family", "whole", "b"]).select("family", "whole").distinct()
        families = scratch.table(families.join(again, ["family", "whole"], "left_semi"), f"again-{round_}")
        most *= MORE
    named = component(classes, names).select("f", "g", "n_shingles", "component")
    return slim.join(named, ["f", "g", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
