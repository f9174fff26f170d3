"""Alignment of tokenizations against a plain version with the two libraries."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparselin.llm import alignment
from sparselin.llm.alignment import Fragment
from sparselin.llm.store import Scratch
from sparselin.llm.tokens import byte_letters, tokenizer_path
from test_texts import sha
from test_tokens import ODD_TEXTS

A, B = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    level = Tokenizer.from_file(A)
    level.encode_special_tokens = True
    return level, SentencePieceProcessor(model_file=B)


def plain_tokens(libraries, text):
    """``(id, bytes)`` of both kinds; none where they do not spell the text."""
    level, piece = libraries
    of = {c: b for b, c in byte_letters().items()}
    want = (" " + text).encode() if text else None
    one = [(i, bytes(of[c] for c in level.id_to_token(i))) for i in level.encode(" " + (text or ""), add_special_tokens=False).ids]
    other = []
    for i in piece.encode(text or ""):
        p = piece.id_to_piece(i)
        other.append((i, bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode()))
    if want is None or any(b"".join(b for _, b in x) != want for x in (one, other)):
        return [], []
    return one, other


def plain_groups(one, other):
    def spans(tokens):
        at, out = 0, []
        for i, b in tokens:
            out.append((i, at, at + len(b)))
            at += len(b)
        return out
    one, other = spans(one), spans(other)
    cuts = sorted({e for _, _, e in one} & {e for _, _, e in other})
    groups, low = [], 0
    for cut in cuts:
        groups.append(([i for i, _, e in one if low < e <= cut], [i for i, _, e in other if low < e <= cut]))
        low = cut
    links = [(i, j) for i, a, b in one for j, c, d in other if a < d and c < b]
    return groups, links


def plain_summary(libraries, rows):
    made, counts = [], Counter()
    for i, text in rows:
        one, other = plain_tokens(libraries, text)
        groups, links = plain_groups(one, other)
        counts.update(set(links))
        made.append((i, one, other, groups, links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    show = lambda groups: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return [(str(i), len(one), len(other), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links),
             sum(counts[x] for x in links), sha(show(groups)) if groups else "") for i, one, other, groups, links in made]


def summaries(found):
    return sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in found)


@pytest.fixture(scope="module")
def mixed(prose, odd):
    rng = random.Random(1)
    short = [(i, t[:2500] if t else t) for i, t in odd] + list(enumerate(ODD_TEXTS, 100))
    return short + [(200 + i, "".join(rng.choice([" ", "\n", "a", "the", "tion", "é", "日", "😀", "<s>", "</s>", "<0x41>", "▁", ".", "12", "x" * 9, "\t", " z"])
                                      for _ in range(rng.randrange(60)))) for i in range(60)]


@pytest.mark.parametrize("size,fan,pairs", [(1 << 18, 8, 1 << 21), (40, 2, 1 << 21), (7, 3, 300)])
def test_summaries_of_odd_rows(spark, libraries, mixed, size, fan, pairs):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in mixed], "doc_id long, text string, row string, a_ids int").repartition(3)
    got = alignment.align_and_count(docs, size=size, fan=fan, pairs=pairs).collect()
    assert summaries(got) == sorted(plain_summary(libraries, mixed))


def test_groups_of_the_aligned_table(spark, libraries, mixed):
    aligned = alignment.align(spark.createDataFrame(mixed, "doc_id long, text string"), Scratch(spark, "test"), size=64, fan=2)
    want = []
    for i, t in mixed:
        groups, _ = plain_groups(*plain_tokens(libraries, t))
        want.append((str(i), ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)))
    assert sorted((str(r["doc_id"]), r["groups"]) for r in alignment.groups(aligned).collect()) == sorted(want)


def test_lists_of_ids_and_counts():
    rng = np.random.default_rng(1)
    bounds = np.array([0, 3, 3, 700, 1000])
    for values in (rng.integers(1, 255, 1000), rng.choice([1, 254, 255, 256, 510, 70_000], 1000)):
        flat, found = alignment.counts_of(alignment.count_lists(values, bounds))
        assert (flat == values).all() and (found == bounds).all()
    for kind in (alignment.id_type(50_257, 32_000), alignment.id_type(70_000)):
        ids = rng.integers(0, 1 << 8 * min(kind.itemsize, 3), 1000)
        flat, found = alignment.ids_of(alignment.id_lists(ids, bounds, kind), kind)
        assert (flat == ids).all() and (found == bounds).all()


def fragment_of(tokens, low, high):
    (a_ids, a_ends), (b_ids, b_ends) = tokens
    a, b = ((x > low) & (x <= high) for x in (a_ends, b_ends))
    return Fragment.of(a_ids[a], a_ends[a], b_ids[b], b_ends[b])


def shown(f):
    return [np.asarray(x).tolist() for x in (f.a_ids, f.b_ids, f.a_counts, f.b_counts)] + [f.a_head, f.b_head, f.cut]


@pytest.mark.parametrize("seed", range(20))
def test_fragments_are_a_monoid(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    tokens = []
    for density in rng.random(2):
        ends = np.append(np.flatnonzero(rng.random(n) < density * 0.8) + 1, n)
        ends = np.unique(ends)
        tokens.append((rng.integers(0, 100, len(ends)), ends))
    edges = [0, *sorted(rng.integers(0, n + 1, 6).tolist()), n]
    parts = [fragment_of(tokens, a, b) for a, b in zip(edges, edges[1:])]
    whole = shown(fragment_of(tokens, 0, n))
    left, right = parts[0], parts[-1]
    for p in parts[1:]:
        left = left + p
    for p in parts[-2::-1]:
        right = p + right
    assert shown(left) == shown(right) == shown(alignment.put_together(parts)) == whole
    assert shown(Fragment() + left) == shown(left + Fragment()) == whole
    assert left.open_tail() == (0, 0)


def test_no_rows(spark, no_docs):
    assert alignment.align_and_count(no_docs).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert summaries(alignment.align_and_count(nothing).collect()) == [(str(i), 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]
