import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparselin.llm import packing, simple8b, token_files
from sparselin.llm.store import Scratch
from sparselin.llm.tokens import Encoder, tokenizer_path

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD_TEXTS = ["", " ", "a  b", "\n", "a\n", " a", "a \n b", "x\ty \t z", "don't I'll 's", "<|endoftext|> a<|endoftext|>", "é é ́x",
             "a\u00a0b \u3000c", "1 234 a1b", "a\x1cb\x1c c", "\0 a \0", "ΣΑΣ Σ İ i̇", "日本 語\r\n x", "😀😀 a", None, "ÀB. Éa, ÿ. a.. ß."]


@pytest.mark.parametrize("file", FILES)
def test_remembered_words_give_the_ids_of_whole_texts(file):
    rng = random.Random(1)
    texts = ODD_TEXTS + ["".join(rng.choice(" \n\ta'sLé1#.\u00a0\u0301,É\u3000") for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    encoder = Encoder(tokenizer_path(file))
    for _ in range(2):
        ids, bounds = encoder.batch(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [encoder.whole(t or "") for t in texts]


@pytest.mark.parametrize("high", [1, 2, 100, 50_000, 2**31, 2**60, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 511, 512, 513, 5000])
def test_simple8b_round_trip(n, high):
    rng = np.random.default_rng(n)
    values = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
    values[rng.random(n) < 0.3] = 0
    words, offsets = simple8b.encode(values)
    assert (simple8b.decode(words, offsets, n) == values).all()
    assert len(offsets) == -(-n // simple8b.BLOCK)


def test_simple8b_limits_of_widths():
    values = np.array([x for k in range(1, 65) for x in (2**k - 1, 2**(k - 1))], np.uint64)
    words, offsets = simple8b.encode(values)
    assert (simple8b.decode(words, offsets, len(values)) == values).all()
    assert len(simple8b.encode(np.zeros(480, np.uint64))[0]) == 8


def expected(odd, file, end):
    encoder, rows, start = Encoder(tokenizer_path(file)), [], 0
    for i, t in sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*encoder.whole(t or ""), end], "<u4")
        rows.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return rows


def test_files_of_odd_rows(spark, odd, odd_docs):
    scratch = Scratch(spark, "test")
    manifest = scratch.table(token_files.write_tokens(odd_docs, scratch.path("f"), FILES[0], 1), "m")
    out = token_files.read_tokens(spark, scratch.path("f"), manifest, token_files.digest, token_files.DIGEST).collect()
    assert sorted(map(tuple, out), key=lambda r: r[1]) == expected(odd, FILES[0], 1)


def test_no_rows(spark, no_docs):
    scratch = Scratch(spark, "test")
    manifest = scratch.table(token_files.write_tokens(no_docs, scratch.path("f"), FILES[0], 1), "m")
    assert token_files.read_tokens(spark, scratch.path("f"), manifest, token_files.digest, token_files.DIGEST).count() == 0
    assert packing.pack(token_files.piece_table(no_docs, FILES[1], 2, 1024)).count() == 0


def check_places(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_pieces_of_odd_rows(spark, odd, odd_docs):
    rows = packing.pack(token_files.piece_table(odd_docs, FILES[1], 2, 64), 64).collect()
    check_places(rows, 64)
    encoder, want = Encoder(tokenizer_path(FILES[1])), []
    for i, t in odd:
        ids = np.array([*encoder.whole(t or ""), 2], "<u4")
        first = len(ids) - (-(-len(ids) // 64) - 1) * 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)


def best_fit(lengths, size):
    """One piece at a time into the fullest sequence that holds it."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= n]
        gap = min(fitting) if fitting else size
        if fitting:
            gaps.remove(gap)
        gaps.append(gap - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_runs_pack_as_well_as_single_pieces(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in np.minimum(rng.geometric(1 / (10 + 15 * seed), 800), 100)]
    pieces = spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, offset string")
    rows = packing.pack(pieces, 100).collect()
    assert len(rows) == 800 and check_places(rows, 100) == best_fit(lengths, 100)


def test_runs_use_as_many_sequences_as_single_pieces():
    rng = np.random.default_rng(8)
    for _ in range(3000):
        size = int(rng.integers(5, 40))
        lengths = sorted((int(x) for x in rng.integers(1, size + 1, rng.integers(1, 30)) // rng.integers(1, 5) + 1 if x <= size), reverse=True)
        runs = packing.match_runs({n: lengths.count(n) for n in lengths}, size)
        firsts, filled = [r[0] for r in runs], {}
        assert firsts == sorted(set(firsts))
        for rank, n in enumerate(lengths):
            first, sequence, offset = runs[np.searchsorted(firsts, rank, "right") - 1]
            filled.setdefault(sequence + rank - first, []).append((offset, n))
        for places in filled.values():
            places.sort()
            assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
            assert sum(n for _, n in places) <= size
        assert len(filled) == best_fit(lengths, size)


def test_lengths_out_of_range(spark):
    with pytest.raises(ValueError):
        packing.match_runs({0: 1}, 10)
    with pytest.raises(ValueError):
        packing.match_runs({11: 1}, 10)


def test_input_bytes_follow_the_sources(spark):
    from sparselin.llm.store import input_bytes
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = input_bytes(docs)
    assert 0 < one < 1 << 20 and input_bytes(docs.join(docs.withColumnRenamed("text", "t"), "doc_id")) == 2 * one
    # A source of unknown size counts nothing, so the session's partitions remain.
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1, "a")]), "doc_id long, text string")
    assert token_files.range_partitions(unknown) == int(spark.conf.get("spark.sql.shuffle.partitions"))
