"""Quality rules, line and substring deduplication against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparselin.llm import line_dedup, quality, substring_dedup
from sparselin.llm.mph import PerfectHash
from sparselin.llm.words import chain, span_hashes, words_of, U64
import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0d]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def test_words_and_hashes(odd):
    texts = [t for _, t in odd]
    words = words_of(pa.array(texts))
    raw = words.body.tobytes()
    got = [raw[s:s + n].decode() for s, n in zip(words.starts, words.sizes)]
    assert got == [w for t in texts for w in WORD.findall(t or "")]
    assert words.counts().tolist() == [len(WORD.findall(t or "")) for t in texts]
    # Equal words have equal hashes, and different ones different.
    assert len(set(zip(got, words.hashes().tolist()))) == len(set(got)) == len(set(words.hashes().tolist()))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 16, 35])
def test_chain_depends_on_all_values_of_the_window(size):
    values = span_hashes(np.arange(200, dtype=np.uint8), np.arange(100), np.full(100, 3))
    assert len(chain(values, size)) == 101 - size and len(set(chain(values, size).tolist())) == 101 - size
    twice = np.concatenate([values, values])
    assert (chain(twice, size)[:101 - size] == chain(twice, size)[100:]).all()
    for k in range(size):
        other = values.copy()
        other[10 + k] ^= U64(1)
        assert chain(other, size)[10] != chain(values, size)[10]
    assert len(chain(values[:size - 1], size)) == 0


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {p for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    filled = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(filled) - len(set(filled)), len(covered)


def test_quality_of_odd_rows(odd, odd_docs):
    got = sorted(tuple(str(x) for x in (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]))
                 for r in quality.judge(odd_docs).collect())
    want = []
    for i, t in odd:
        n, chars, symbols, dup, rep = plain_counts(t)
        want.append(tuple(str(x) for x in (i, n, chars, symbols, dup, rep, n < 50 or 100 * rep > 50 * n)))
    assert got == sorted(want)


def test_rules_bite(spark, prose):
    good = "the " + prose(1, 100) + " of the"
    texts = [good, good.replace(" ", " ### "), prose(2, 100).replace("the", ""), "x" * 3000 + " the of " + " ".join("y" * 40 for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False}


def test_quality_plan_has_no_python(odd_docs):
    assert "Python" not in quality.judge(odd_docs)._jdf.queryExecution().executedPlan().toString()


def plain_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    owner = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                owner[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(owner[key(x)]) < 2 or i == min(owner[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def line_rows(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["text"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [1, 1 << 20])
def test_lines_of_odd_rows(odd, odd_docs, spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    assert line_rows(line_dedup.drop_repeated_lines(odd_docs)) == plain_lines(odd)
    rng = np.random.default_rng(5)
    pool = [f"  Line number {i} ÄÖ " for i in range(40)] + ["short", "", "ÄÄÄÄÄ", "ääääääääää", "\tSHOUTED LINE\x0b"]
    rows = [(int(rng.integers(0, 80)), "\n".join(rng.choice(pool, 6))) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_rows(line_dedup.drop_repeated_lines(docs)) == plain_lines(rows)


def test_other_columns_stay(odd_docs, no_docs):
    out = line_dedup.drop_repeated_lines(odd_docs)
    assert set(out.columns) == set(odd_docs.columns) and out.first()["a.b"] == 1 and dict(out.dtypes)["n_lines"] == "bigint"
    out = substring_dedup.remove_repeated(odd_docs)
    assert set(out.columns) == set(odd_docs.columns) and out.first()["_row"] == 3
    for f in (line_dedup.drop_repeated_lines, substring_dedup.remove_repeated, quality.judge):
        assert f(no_docs).count() == 0


def test_perfect_hash_numbers_every_key_once():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    index = PerfectHash.build(a, b)
    assert sorted(index.number(a, b).tolist()) == list(range(5000))
    assert PerfectHash.build(a[:0], b[:0]).number(a, b).max() == -1
    with pytest.raises(ValueError):
        PerfectHash.build(a[[0, 0]], b[[0, 0]])


def plain_windows(rows, size):
    places = defaultdict(list)
    texts = [WORD.findall(t or "") for _, t in rows]
    for d, w in enumerate(texts):
        for i in range(len(w) - size + 1):
            places[tuple(w[i:i + size])].append((d, i))
    gone = {(d, i + k) for found in places.values() if len(found) > 1 for d, i in found for k in range(size)}
    return sorted(((rows[d][0], len(w), sum((d, i) in gone for i in range(len(w))),
                    sha(" ".join(x for i, x in enumerate(w) if (d, i) not in gone))) for d, w in enumerate(texts)), key=str)


def window_rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], sha(r["text"])) for r in df.collect()), key=str)


def test_windows_of_odd_rows(odd, odd_docs):
    assert window_rows(substring_dedup.remove_repeated(odd_docs)) == plain_windows(odd, 35)


@pytest.mark.parametrize("bits", [20, 4])
def test_windows_with_shared_passages(spark, prose, monkeypatch, bits):
    # A sketch of 16 cells passes every window; the result is the same.
    monkeypatch.setattr(substring_dedup, "sketch_bits", lambda docs, size: bits)
    monkeypatch.setattr(substring_dedup, "RANGE_BITS", min(bits, 20))
    rng = np.random.default_rng(4)
    passages = [prose(100 + i, int(rng.integers(30, 70))) for i in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(1000 + i, 40)] + [passages[int(k)] for k in rng.integers(0, 6, int(rng.integers(0, 4)))] + [prose(2000 + i, 30)]
        rows.append((i, " ".join(parts)))
    rows += [(60, "la " * 90), (61, None), (3, rows[3][1]), (3, prose(7, 100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert window_rows(substring_dedup.remove_repeated(docs)) == plain_windows(rows, 35)
