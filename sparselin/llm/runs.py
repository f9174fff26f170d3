"""Periodic runs of words, found in a grammar of each text.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
``MIN_LENGTH`` words and ``MIN_REPEATS`` periods, that no neighbouring word extends keeping the period.

Re-Pair compresses the word ids of a text: the most frequent pair of neighbours becomes a nonterminal, until no
pair is left twice. Pairs that do not touch a more frequent one are replaced in the same pass, so a pass serves
all texts of a batch, and few passes serve a long text. The top symbols of a text are the leaves of a balanced
tree over them, whose nodes are nonterminals that occur once.

Every run lies in a smallest node, whose boundary between left and right part it crosses, and is maximal there.
So the runs across the boundary of each nonterminal are computed once, at its first place: a run of four periods
has two of them left or right of the boundary, which leaves a word that follows itself q words on, a candidate
that prefix hashes confirm and extend. They are then carried to all places of the nonterminal in the derivation.
Of the stretches with one period only those in no other are runs (at the edge of a nonterminal they may be parts of
longer ones), and of several periods of one stretch the smallest.

Words are told apart by 64-bit hashes, stretches by two 31-bit polynomial prefix hashes: a false result takes a
collision of both. Rows: a null or empty text has no words and no runs; repeated rows and null ids are rows of
their own; a text is never split. Columns named like the made ones are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.llm.store import extended, map_batches, named, others, unused
from sparselin.llm.words import U64, joined, mix, spread_runs, words_of

MIN_LENGTH, MIN_REPEATS = 6, 4
# Primes below 2^31, so products of residues fit 64 bits.
PRIMES = (2147483647, 2147483629)
# Candidate periods looked at together.
STEP = 1 << 21
MADE = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


@dataclass
class Grammar:
    """Of a batch of texts, by word positions in the batch.

    Nonterminal ``x`` first lies at ``first[x]`` and has ``size[x]`` words, ``left[x]`` of them in its left part.
    ``rule`` and ``at`` list all its places. ``top`` are the places of the top symbols.
    """

    first: np.ndarray
    left: np.ndarray
    size: np.ndarray
    rule: np.ndarray
    at: np.ndarray
    top: np.ndarray


def repair(ids: np.ndarray, bounds: np.ndarray) -> Grammar:
    """Re-Pair every text of a batch; texts share no ids."""
    at = np.arange(len(ids))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    symbol, width = ids, np.ones(int(ids.max(initial=-1)) + 1, np.int64)
    first, left, size, rule, places, top = [], [], [], [], [], []
    n_rules = n_pass = 0
    while len(symbol):
        n_pass += 1
        many = np.bincount(symbol, minlength=len(width)) > 1
        found = many[symbol]
        pair = np.flatnonzero(found[:-1] & found[1:] & (owner[:-1] == owner[1:]))
        same = symbol[pair] == symbol[pair + 1]
        if same.any():
            # In a row of one symbol every other pair counts.
            new = np.ones(len(symbol), bool)
            new[1:] = (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(symbol)), 0))
            pair = pair[~same | ((pair - head[pair]) % 2 == 0)]
        keys, slot, counts = np.unique(symbol[pair] * len(width) + symbol[pair + 1], return_inverse=True, return_counts=True)
        repeated = counts[slot] > 1
        pair, slot = pair[repeated], slot[repeated]
        # Texts without a repeated pair are done.
        going = np.zeros(len(bounds), bool)
        going[owner[pair]] = True
        stay = going[owner]
        if not stay.all():
            top.append(at[~stay])
            pair = (np.cumsum(stay) - 1)[pair]
            symbol, at, owner = symbol[stay], at[stay], owner[stay]
            if not len(symbol):
                break
        # More frequent pairs go first; a hash that changes with the pass breaks ties.
        weight = (counts.astype(U64) << U64(40) | mix(keys.astype(U64) + U64(n_pass)) >> U64(24))[slot]
        touch = np.diff(pair) == 1
        chosen = np.ones(len(pair), bool)
        chosen[1:] &= ~touch | (weight[1:] > weight[:-1])
        chosen[:-1] &= ~touch | (weight[:-1] > weight[1:])
        chosen &= np.bincount(slot[chosen], minlength=len(keys))[slot] > 1
        pair, slot = pair[chosen], slot[chosen]
        _, lead, name = np.unique(slot, return_index=True, return_inverse=True)
        a, b = symbol[pair[lead]], symbol[pair[lead] + 1]
        first.append(at[pair[lead]])
        left.append(width[a])
        size.append(width[a] + width[b])
        rule.append(n_rules + name)
        places.append(at[pair])
        n_rules += len(lead)
        symbol = symbol.copy()
        symbol[pair] = len(width) + name
        width = np.concatenate([width, size[-1]])
        rest = np.ones(len(symbol), bool)
        rest[pair + 1] = False
        symbol, at, owner = symbol[rest], at[rest], owner[rest]
    return Grammar(*(np.concatenate([np.empty(0, np.int64), *x]) for x in (first, left, size, rule, places)),
                   np.sort(np.concatenate([np.empty(0, np.int64), *top])))


class Stretches:
    """Equality of stretches of ids by prefix hashes."""

    def __init__(self, ids: np.ndarray):
        self._parts = []
        for k, prime in enumerate(PRIMES):
            p = U64(prime)
            values = mix(ids.astype(U64) + U64(k + 1)) % p
            base, powers = int(mix(np.array([k + 7], U64))[0] % p), np.ones(1, U64)
            while len(powers) <= len(ids):
                powers = np.concatenate([powers, powers * U64(pow(base, len(powers), prime)) % p])
            self._parts.append((p, powers, np.concatenate([[0], np.cumsum(values * powers[:len(ids)] % p)]).astype(U64) % p))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches from ``a`` and from ``b > a`` on are equal."""
        same = np.ones(len(a), bool)
        for p, powers, sums in self._parts:
            one, other = sums[a + size] + p - sums[a], sums[b + size] + p - sums[b]
            same &= one % p * powers[b - a] % p == other % p
        return same

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """For how many words, ``most`` at most, what follows ``a`` and ``b > a`` is equal; or what precedes them."""
        low, high = np.zeros_like(most), most.copy()
        open_ = np.flatnonzero(high > 0)
        while len(open_):
            half = (low[open_] + high[open_] + 1) // 2
            shift = half if back else 0
            same = self.equal(a[open_] - shift, b[open_] - shift, half)
            low[open_[same]] = half[same]
            high[open_[~same]] = half[~same] - 1
            open_ = open_[low[open_] < high[open_]]
        return low


def nodes(grammar: Grammar, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``left end, boundary, right end`` of all nonterminals, then of the tree over the top symbols."""
    top = grammar.top
    start = np.searchsorted(top, bounds)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(start))
    k, n = np.arange(len(top)) - start[owner], np.diff(start)[owner]
    inner = np.flatnonzero(k > 0)
    k, n, owner = k[inner], n[inner], owner[inner]
    # Symbol k is where a node of this many symbols on either side has its boundary.
    reach = k & -k
    ends = np.append(top, bounds[-1])
    right = np.where(k + reach < n, ends[np.minimum(inner + reach, len(top))], bounds[owner + 1])
    return (np.concatenate([grammar.first, top[inner - reach]]), np.concatenate([grammar.first + grammar.left, top[inner]]),
            np.concatenate([grammar.first + grammar.size, right]))


def crossing(ids: np.ndarray, stretches: Stretches, left: np.ndarray, middle: np.ndarray, right: np.ndarray):
    """``node, start, end, period`` of the runs at the boundary of each node, as far as the node reaches."""
    found = []
    for back in (False, True):
        # Two periods lie on this side of the boundary, four in the node; with period 1 three words do.
        side = middle - left if back else right - middle
        most = np.minimum((right - left) // MIN_REPEATS, side // 2)
        total = np.concatenate([[0], np.cumsum(most)])
        cuts = np.searchsorted(total, np.arange(0, total[-1] + STEP, STEP), "right") - 1
        for a, b in zip(cuts, [*cuts[1:], len(most)]):
            node = np.repeat(np.arange(a, b), most[a:b])
            q = np.arange(len(node)) - np.repeat(total[a:b] - total[a], most[a:b]) + 1
            for step in (1, 2):
                fits = side[node] >= q + step
                node, q = node[fits], q[fits]
                here = middle[node] - step if back else middle[node] + step - 1
                same = ids[here] == ids[here - q if back else here + q]
                node, q = node[same], q[same]
            need = np.maximum(q, 2)
            fits = side[node] >= q + need
            node, q, need = node[fits], q[fits], need[fits]
            at = middle[node]
            one = at - q - need if back else at
            same = stretches.equal(one, one + q, need)
            node, q = node[same], q[same]
            at = middle[node] - (q if back else 0)
            start = at - stretches.reach(at, at + q, at - left[node], back=True)
            end = at + q + stretches.reach(at, at + q, right[node] - at - q)
            long = end - start >= np.maximum(MIN_REPEATS * q, MIN_LENGTH)
            found.append(np.stack([node, start, end, q])[:, long])
    return np.concatenate(found, axis=1)


def maximal(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that lie in no other of their period, each with its smallest period, by start and period."""
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    # Stretches of larger periods count as behind those of smaller ones.
    far = end + q * (int(end.max(initial=0)) + 1)
    before = np.concatenate([[-1], np.maximum.accumulate(far)[:-1]]) if len(far) else far
    start, end, q = (x[far > before] for x in (start, end, q))
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[least], end[least], q[least]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def batch_runs(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of all runs of the texts of a batch, by start; texts share no ids."""
    grammar = repair(ids, bounds)
    left, middle, right = nodes(grammar, bounds)
    n_rules = len(grammar.first)
    wide = np.flatnonzero(right - left >= MIN_LENGTH)
    node, start, end, q = crossing(ids, Stretches(ids), left[wide], middle[wide], right[wide])
    node = wide[node]
    ruled = node < n_rules
    # A run of a nonterminal lies at all its places.
    order = np.argsort(grammar.rule, kind="stable")
    counts = np.bincount(grammar.rule, minlength=n_rules)
    heads = np.cumsum(counts) - counts
    x = node[ruled]
    copies = counts[x]
    to = grammar.at[order[spread_runs(heads[x], copies)]] - np.repeat(grammar.first[x], copies)
    moved = (np.repeat(v, copies) + shift for v, shift in zip((start[ruled], end[ruled], q[ruled]), (to, to, 0)))
    return maximal(*(np.concatenate([v[~ruled], m]) for v, m in zip((start, end, q), moved)))


def find_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (``text`` and more) with ``n_words``, ``runs`` by start and period, and ``collapsed``.

    ``collapsed`` is the text without the words that a run has behind its first period, joined by blanks.
    """
    names = others(docs, MADE)
    docs = docs.select(*named(names))

    def task(part):
        words = words_of(part.column(names.index("text")))
        # Equal words of one text have one id.
        ids = np.unique(mix(words.hashes() ^ mix(words.owner().astype(U64) + U64(1))), return_inverse=True)[1]
        start, end, q = batch_runs(ids, words.bounds)
        n = len(ids) + 1
        gone = np.cumsum(np.bincount(start + q, minlength=n) - np.bincount(end, minlength=n))[:-1] > 0
        at = np.searchsorted(start, words.bounds)
        own = start - words.bounds[np.repeat(np.arange(len(at) - 1), np.diff(at))]
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array(x.astype(np.int64)) for x in (own, end - start, q)], names=["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(words.counts()), lists, joined(words, ~gone).cast(pa.string())],
            names=[*names, "n_words", "runs", "collapsed"])

    return map_batches(docs, task, extended(docs, names, MADE), 1 << 21)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with a planted period in a tenth of the texts, fixed by the id; their words are joined by blanks.

    With h the CRC-32 of the decimal id, g = floor(h / 10), n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)),
    every word i >= a becomes word a + (i - a) % p where h % 10 = 0. Texts without words or id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    names, cut = docs.columns, unused(docs, "_words")
    # The words are a column of their own, so that the look-ups of the tail do not split the text again.
    words = docs.withColumn(cut, F.when(h % 10 == 0, split))
    n, g = F.size(cut), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = F.slice(cut, a + 1, p)
    # The head, then the period as often as it is begun, cut to the length.
    planted = F.concat(F.slice(cut, 1, a), F.slice(F.flatten(F.array_repeat(tail, F.ceil((n - a) / p).cast("int"))), 1, n - a))
    return words.withColumn("text", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text"))).select(*named(names))


def digest(found: DataFrame) -> DataFrame:
    """The runs of each row in a few columns: their number, the longest one (the first of equals), and checksums."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q"))))
    length, q = -best["l"], best["q"]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["s"].alias("start"), length.alias("length"), q.alias("period"),
        F.floor(1000 * length / q).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
