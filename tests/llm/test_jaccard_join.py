"""The parity-sketch join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparselin.llm import jaccard_join as jj
from sparselin.llm.near_dup import shingle_sets
from test_search import edited, plain_classes


def sets_of(texts, size):
    owner, values = shingle_sets(pa.array(texts), size)
    return owner, values, [frozenset(values[owner == k].tolist()) for k in range(len(texts))]


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_every_link_shares_a_key(prose, percent):
    rng = random.Random(percent)
    texts = []
    for family in range(40):
        base = prose(900 + family, rng.choice([1, 2, 3, 4, 6, 8, 11, 15, 19, 30, 60, 150, 400]))
        texts += [base] + [edited(base, rng, rng.randrange(0, 1 + len(base.split()) // 12)) for _ in range(6)]
    owner, values, sets = sets_of(texts, 3)
    counts = np.array([len(s) for s in sets])
    schemes = jj.Schemes.of(percent, int(counts.max()))
    band = np.where(counts > 0, schemes.band(counts), -1)
    keys = [set() for _ in texts]
    for scheme in (band, np.where(band > 0, band - 1, -1)):
        for k, key in zip(*jj.piece_keys(schemes, scheme, owner, values, len(texts))):
            keys[k].add(int(key))
    sketch = jj.parity_bits(owner, values, np.where(band >= 0, schemes.log_bits[band], 6))
    links = 0
    for i in range(len(texts)):
        for j in range(i):
            common, total = len(sets[i] & sets[j]), counts[i] + counts[j]
            if counts[i] and counts[j] and 100 * common >= percent * (total - common):
                links += 1
                assert keys[i] & keys[j]
                apart = jj.distances([sketch[i]], [sketch[j]])[0]
                assert apart <= total - 2 * common <= jj.largest_difference(total, percent)
    assert links > 100


def test_schemes_cover_all_sizes():
    for percent in (50, 80, 90, 99):
        schemes = jj.Schemes.of(percent, 100_000)
        assert schemes.low[0] == 1 and (schemes.low[1:] == schemes.high[:-1] + 1).all()
        # The largest partner of a size lies in the next band at most.
        assert (schemes.band(schemes.high * 100 // percent)[:-1] <= np.arange(len(schemes.high) - 1) + 1).all()


def test_sketches_bound_the_difference(prose):
    rng = random.Random(2)
    base = prose(5, 300)
    texts = [base] + [edited(base, rng, k) for k in (1, 5, 20, 60)] + [prose(6, 100)]
    owner, values, sets = sets_of(texts, 3)
    for log_bits in (6, 9, 12):
        sketch = jj.parity_bits(owner, values, np.full(len(texts), log_bits))
        assert {len(s) for s in sketch} == {2 ** log_bits // 8}
        for i in range(len(texts)):
            want = np.zeros(2 ** log_bits, np.uint8)
            for v in sets[i]:
                want[v >> 64 - log_bits] ^= 1
            assert np.packbits(want).tobytes() == sketch[i]
            for j in range(i):
                apart, true = jj.distances([sketch[i]], [sketch[j]])[0], len(sets[i] ^ sets[j])
                assert apart <= true and (apart - true) % 2 == 0
    # A wide sketch folds to a narrow one.
    wide, narrow = (jj.parity_bits(owner, values, np.full(len(texts), b)) for b in (10, 7))
    assert (jj.folded(wide, 16) == jj.folded(narrow, 16)).all()


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_classes_of_families(spark, prose, odd, size, percent):
    rng = random.Random(3)
    rows = list(odd)
    for family in range(12):
        base = prose(500 + family, rng.choice([5, 20, 120, 300]))
        for k in range(10):
            rows.append((100 + family * 10 + k, edited(base, rng, rng.randrange(0, 9))))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int").repartition(4)
    got = jj.join_similar(docs, size, percent).collect()
    want = plain_classes(rows, size, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"], r["doc_id"])


@pytest.mark.parametrize("block", [4096, 7])
def test_chains_and_near_misses_in_one_family(spark, prose, monkeypatch, block):
    # Neighbours in a chain link, most pairs are just below the threshold: stars, meetings and refuted proposals.
    monkeypatch.setattr(jj, "BLOCK", block)
    words = prose(9, 400).split(" ")
    rng = random.Random(5)
    rows = [(i, " ".join(words[4 * i:4 * i + 200])) for i in range(30)]
    rows += [(100 + i, edited(" ".join(words[:200]), rng, 5)) for i in range(40)]
    got = jj.join_similar(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_classes(rows, 3, 90)


def test_refuted_proposals_meet_again(spark, prose, monkeypatch):
    # Sketches of few bits allow pairs that full sets refute.
    monkeypatch.setattr(jj, "BITS", 0.05)
    words = prose(9, 300).split(" ")
    rng = random.Random(7)
    rows = [(i, edited(" ".join(words[:150]), rng, rng.randrange(2, 6))) for i in range(40)]
    got = jj.join_similar(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_classes(rows, 3, 90)


def test_no_rows(spark, no_docs):
    assert jj.join_similar(no_docs).count() == 0


def test_pieces_shared_by_chance_tie_no_family(spark, prose, monkeypatch):
    # Two phrases a text: each phrase is in some twenty texts, and over them nearly all texts hang together.
    rng = random.Random(11)
    phrases = [prose(2000 + k, 8) for k in range(60)]
    rows = [(i, " ".join(rng.sample(phrases, 2))) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " " + rows[i][1].split()[0]) for i in range(0, 600, 9)]
    met, meetings = [], jj.meetings

    def counted(members, *more):
        sizes = members.groupBy([c for c in ("family", "whole") if c in members.columns]).count().collect()
        met.append(sum(r["count"] ** 2 for r in sizes))
        return meetings(members, *more)

    monkeypatch.setattr(jj, "meetings", counted)
    got = jj.join_similar(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_classes(rows, 3, 90)
    assert 0 < met[0] < 20_000


def test_meetings_passed_over_propose_nothing(prose):
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        base = prose(rng.randrange(10**6), rng.choice([12, 30, 90]))
        texts += [edited(base, rng, rng.randrange(0, 4)) if rng.random() < 0.5 else prose(rng.randrange(10**6), 30) for _ in range(rng.randrange(2, 6))]
    n = len(texts)
    owner, values, _ = sets_of(texts, 3)
    counts = np.bincount(owner, minlength=n)
    sketch = jj.parity_bits(owner, values, np.full(n, 8) + (counts > 40))
    table = pa.table({"doc_id": np.arange(n), "component": np.arange(n) - np.arange(n) % 2, "n_shingles": counts, "sketch": pa.array(sketch, pa.binary()),
                      "refuted": pa.array([None] * n, pa.list_(pa.int64())), "asks": np.array([rng.choice([0, 2]) for _ in range(n)])})
    bounds = np.unique([0, n, *(rng.randrange(n) for _ in range(25))])
    said = jj.promising(table, bounds, 90)
    found = [bool(jj.proposals(table.slice(int(a), int(b - a)), 90, 1)) for a, b in zip(bounds[:-1], bounds[1:])]
    assert all(x >= y for x, y in zip(said, found)) and any(found) and not all(said)
