"""Periodic runs against a plain search."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparselin.llm import runs
from sparselin.llm.words import joined, words_of
from test_texts import WORD, sha


def plain_runs(words):
    """Every period at every place; of one stretch the smallest period."""
    found, ids = {}, np.unique(words, return_inverse=True)[1]
    for q in range(1, len(words) // runs.MIN_REPEATS + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]]).astype(int)
        for i, j in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            if j + q - i >= max(runs.MIN_LENGTH, runs.MIN_REPEATS * q):
                found.setdefault((i, j + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng, most=200):
    n, letters = rng.randrange(most), rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        a, q, k = rng.randrange(n), rng.randrange(1, 20), rng.randrange(1, 100)
        for i in range(a + q, min(n, a + q + k)):
            words[i] = words[i - q]
    return [f"w{w}" for w in words]


def batch_of(texts):
    words = words_of(pa.array([" ".join(t) for t in texts]))
    names = [(d, w) for d, t in enumerate(texts) for w in t]
    place = {x: i for i, x in enumerate(dict.fromkeys(names))}
    return np.array([place[x] for x in names], np.int64), words.bounds


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_those_of_a_plain_search(seed):
    rng = random.Random(seed)
    texts = [random_words(rng) for _ in range(25)] + [[]]
    ids, bounds = batch_of(texts)
    start, end, q = runs.batch_runs(ids, bounds)
    want = [(a + s, a + s + n, p) for t, a in zip(texts, bounds.tolist()) for s, n, p in plain_runs(t)]
    assert list(zip(start.tolist(), end.tolist(), q.tolist())) == want


def test_a_fibonacci_word_and_a_long_run():
    a, b = ["a"], ["a", "b"]
    while len(b) < 1500:
        a, b = b, b + a
    texts = [b, ["x", "y", "z"] * 700, ["x"] * 5, ["x"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"]]
    ids, bounds = batch_of(texts)
    start, end, q = runs.batch_runs(ids, bounds)
    want = [(s + k, s + k + n, p) for t, s in zip(texts, bounds.tolist()) for k, n, p in plain_runs(t)]
    assert list(zip(start.tolist(), end.tolist(), q.tolist())) == want


def test_steps_of_candidates_change_nothing(monkeypatch):
    monkeypatch.setattr(runs, "STEP", 37)
    test_runs_are_those_of_a_plain_search(3)


@pytest.mark.parametrize("seed", range(10))
def test_the_grammar_derives_its_texts(seed):
    rng = random.Random(seed)
    texts = [random_words(rng) for _ in range(10)]
    ids, bounds = batch_of(texts)
    g = runs.repair(ids, bounds)
    # All places of a nonterminal hold the words of its first one, and it has two at least.
    for x, at in zip(g.rule.tolist(), g.at.tolist()):
        assert (ids[at:at + g.size[x]] == ids[g.first[x]:g.first[x] + g.size[x]]).all()
    assert (np.bincount(g.rule, minlength=len(g.first)) > 1).all() and (g.left < g.size).all()
    # No pair of top symbols is left twice in a text, but for a row of one symbol.
    size = dict(zip(zip(g.rule.tolist(), g.at.tolist()), g.size[g.rule].tolist()))
    longest = {}
    for (x, at), n in size.items():
        longest[at] = max(longest.get(at, (0, -1)), (n, x))
    covered = 0
    for at, end in zip(g.top.tolist(), [*g.top[1:].tolist(), len(ids)]):
        assert end - at == 1 or longest[at][0] >= end - at
        covered += end - at
    assert covered == len(ids)


def test_odd_rows(spark, odd, odd_docs):
    got = runs.find_runs(odd_docs).collect()
    want = []
    for i, t in odd:
        words = WORD.findall(t or "")
        found = plain_runs(words)
        want.append((str(i), str(len(words)), found, plain_collapsed(words, found)))
    assert sorted((str(r["doc_id"]), str(r["n_words"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == sorted(want)
    assert {"a.b", "_row", "n_lines"} <= set(got[0].asDict())


def test_columns_of_the_made_names_are_replaced(spark):
    docs = spark.createDataFrame([("a a a a a a", 1, "x", 2)], "text string, runs int, Collapsed string, n_words int")
    row, = runs.find_runs(docs).collect()
    assert row.asDict(True) == {"text": "a a a a a a", "n_words": 6, "runs": [{"start": 0, "length": 6, "period": 1}], "collapsed": "a"}


def test_no_rows(spark, no_docs):
    assert runs.find_runs(no_docs).count() == 0


def test_planted_tails_and_digests(spark, odd):
    rows = [(i, t) for i, t in odd] + [(i, "a b c d e f g h i j k l m n o p q r s t u v w x y z") for i in range(1000, 1100)]
    got = runs.digest(runs.find_runs(runs.with_periodic_tails(spark.createDataFrame(rows, "doc_id long, text string")))).collect()
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        found = plain_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want.append((str(i), len(found), *best, 1000 * best[1] // best[2] if found else None,
                     sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(plain_collapsed(words, found))))
    assert sorted([(str(r[0]), *r[1:]) for r in got], key=repr) == sorted(want, key=repr)
    assert any(w[1] for w in want[len(odd):])


def test_joined_keeps_some_words():
    texts = ["a b  c", None, "", "d", "é f\ng"]
    words = words_of(pa.array(texts))
    keep = np.array([True, False, True, False, False, True, True])
    assert joined(words, keep, step=2).to_pylist() == ["a c", "", "", "", "f g"]
    assert joined(words, np.ones(7, bool)).to_pylist() == ["a b c", "", "", "d", "é f g"]
