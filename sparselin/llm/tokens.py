"""Token ids of whole texts by a public tokenizer file, with each distinct piece of text encoded once.

Both supported kinds cut a text before they merge, so a word can be encoded by itself, in the byte-level
form together with the one white-space character before it. Words are told apart by 64-bit hashes in NumPy,
and only those a worker does not remember go to the tokenizer; the memory is bounded and only a matter of
speed. A text in which a cut might not be safe is encoded whole. Strings that name special tokens are
ordinary text.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparselin.llm.words import LOWER, SPACE, U64, Words, span_hashes, spread_runs, text_bytes, words_of

# Words that a worker remembers: twice as many at most, of some 30 bytes each.
MEMO = 500_000
# Words handed to the tokenizer at once.
LEARN = 2000
# A plain word is letters of ASCII and Latin-1, then marks: each is one part for every supported file.
LETTERS = np.zeros(256, bool)
LETTERS[[b for b in range(128) if chr(b).isalpha()]] = True
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in "!#$%&*,.:;?"]] = True
# Bytes that no plain word has: between the parts, and behind a word.
PART, WORD = 1, 0
# White space outside ASCII, as UTF-8.
WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Runs:
    """Runs of ids by ascending 64-bit keys; run ``k`` is ``pool[heads[k]:heads[k] + sizes[k]]``."""

    def __init__(self, keys: np.ndarray, heads: np.ndarray, sizes: np.ndarray, pool: np.ndarray):
        self.keys, self.heads, self.sizes, self.pool = keys, heads, sizes, pool

    @classmethod
    def of(cls, keys: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> Runs:
        """From runs one after the other."""
        return cls(keys, np.cumsum(sizes, dtype=np.int64) - sizes, sizes.astype(np.int32), pool)

    @classmethod
    def none(cls) -> Runs:
        return cls.of(np.empty(0, U64), np.empty(0, np.int32), np.empty(0, np.uint32))

    def __len__(self) -> int:
        return len(self.keys)

    def some(self, places: np.ndarray) -> Runs:
        sizes = self.sizes[places]
        return Runs.of(self.keys[places], sizes, self.pool[spread_runs(self.heads[places], sizes)])

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is here, and the places of those that are."""
        if not len(self):
            return np.zeros(len(keys), bool), np.empty(0, np.int64)
        places = np.minimum(np.searchsorted(self.keys, keys), len(self) - 1)
        hit = self.keys[places] == keys
        return hit, places[hit]

    def with_(self, more: Runs) -> Runs:
        """The runs of both; no key is in both."""
        keys = np.concatenate([self.keys, more.keys])
        order = np.argsort(keys, kind="stable")
        heads = np.concatenate([self.heads, more.heads + len(self.pool)])
        return Runs(keys[order], heads[order], np.concatenate([self.sizes, more.sizes])[order], np.concatenate([self.pool, more.pool]))


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes batches; made once per Python worker and file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        # A task has one core; threads of the library would only take memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self._model = Tokenizer.from_file(path)
        self._model.encode_special_tokens = True
        normal = str(self._model.normalizer)
        byte_level = "ByteLevel" in str(self._model.pre_tokenizer)
        # White space only separates words, and case does not matter.
        self._folds = byte_level and "Lowercase" in normal and "\\s+" in normal
        # A blank belongs to the word after it, a line feed stands alone.
        self._bytes = byte_level and self._model.normalizer is None
        self._letters = byte_letters()
        # The same merges over parts that are cut and shown in the vocabulary's letters already.
        self._parts = Tokenizer(self._model.model)
        self._parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._end, = self._parts.encode(self._letters[WORD], add_special_tokens=False).ids
        # Words of the last batches, and of those before them.
        self._memo, self._old = Runs.none(), Runs.none()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, text: str) -> list[int]:
        return self._model.encode(text, add_special_tokens=False).ids

    def _plain(self, words: Words, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are plain, and how many marks each ends with."""
        body = words.body
        # Two bytes make a Latin-1 letter, but for the signs of multiplication and division.
        second = np.zeros(len(body), bool)
        second[1:] = (body[:-1] == 0xC3) & (body[1:] != 0x97) & (body[1:] != 0xB7)
        letter = LETTERS[body] | second
        letter[:-1] |= second[1:]
        last = np.maximum.accumulate(np.where(MARKS[body], -1, np.arange(len(body))))
        marks = np.minimum(starts + sizes - 1 - last[starts + sizes - 1], sizes)
        odd = np.concatenate([[0], np.cumsum(~letter)])
        lead = 0 if self._folds else SPACE[body[starts]]
        inside = sizes - marks - lead
        return (odd[starts + sizes - marks] - odd[starts + lead] == 0) & (inside > 0), marks

    def _parted(self, words: Words, starts: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> str:
        """Plain words cut into parts, in the vocabulary's letters, with a blank after each part and a separator after each word."""
        body = words.body
        if self._folds:
            upper = np.flatnonzero((body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)) + 1
            body = body.copy()
            body[upper] += 0x20
        line = np.zeros(len(starts), np.int64) if self._folds else (body[starts] == 0x0A).astype(np.int64)
        letters = sizes - marks - line
        body = np.concatenate([body, np.array([PART, WORD, PART], np.uint8)])
        end = np.full(len(starts), len(body) - 3)
        spans = [(starts, line), (end, line), (starts + line, letters), (end, np.ones_like(line)),
                 (starts + sizes - marks, marks), (end, np.minimum(marks, 1)), (end + 1, np.full_like(line, 2))]
        at, size = (np.stack(x, axis=1).ravel() for x in zip(*spans))
        return body[spread_runs(at, size)].tobytes().decode("latin-1").translate(self._letters | {PART: " "})

    def _learn(self, words: Words, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, one after the other, and how many each has."""
        plain, marks = self._plain(words, starts, sizes)
        ids = []
        # The tokenizer's own results are large: a few thousand words at a time.
        for at in np.array_split(np.flatnonzero(plain), -(-int(plain.sum()) // LEARN) or 1):
            text = self._parted(words, starts[at], sizes[at], marks[at])
            ids.append(np.array(self._parts.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(ids)
        ends = ids == self._end
        counts = np.zeros(len(starts), np.int64)
        edges = np.flatnonzero(ends)
        counts[plain] = np.diff(edges, prepend=-1) - 1
        other = np.flatnonzero(~plain)
        if not len(other):
            return ids[~ends], counts
        raw = [words.body[s:s + k].tobytes().decode() for s, k in zip(starts[other].tolist(), sizes[other].tolist())]
        found = [c.ids for at in range(0, len(raw), LEARN) for c in self._model.encode_batch_fast(raw[at:at + LEARN], add_special_tokens=False)]
        counts[other] = [len(c) for c in found]
        owner = np.concatenate([np.repeat(np.flatnonzero(plain), counts[plain]), np.repeat(other, counts[other])])
        pool = np.concatenate([ids[~ends], np.fromiter(chain.from_iterable(found), np.uint32)])
        return pool[np.argsort(owner, kind="stable")], counts

    def _runs(self, keys: np.ndarray, words: Words, starts: np.ndarray, sizes: np.ndarray) -> Runs:
        """The ids of the distinct words with these ascending keys, at these places."""
        recent, at_recent = self._memo.known(keys)
        old, at_old = self._old.known(keys[~recent])
        new = np.flatnonzero(~recent)[~old]
        pool, counts = self._learn(words, starts[new], sizes[new]) if len(new) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        fresh = Runs.of(keys[new], counts, pool).with_(self._old.some(at_old))
        out = self._memo.some(at_recent).with_(fresh)
        if len(self._memo) + len(fresh) > MEMO:
            self._memo, self._old = fresh, self._memo
        else:
            self._memo = self._memo.with_(fresh)
        return out

    def _spans(self, texts: pa.Array, lead: bool) -> tuple[Words, np.ndarray]:
        """The words to encode, and which texts must be encoded whole; with ``lead`` all start with a blank."""
        words = words_of(texts)
        n = len(words.bounds) - 1
        if self._folds:
            words.body = LOWER[words.body]
            return words, np.zeros(n, bool)
        if not self._bytes:
            return words, np.ones(n, bool)
        body, at = text_bytes(texts)
        white = SPACE[body]
        whole = np.zeros(n, bool)
        # White space other than single blanks and line feeds between words.
        odd = white & (body != 0x20) & (body != 0x0A)
        odd[1:] |= white[1:] & white[:-1]
        whole[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = True
        filled = np.flatnonzero(np.diff(at))
        whole[filled] |= white[at[filled + 1] - 1]
        if not lead:
            whole[filled] |= white[at[filled]]
        for found in WIDE_SPACE.finditer(body.tobytes()):
            whole[np.searchsorted(at, found.start(), "right") - 1] = True
        inner = np.ones(len(words.starts), bool)
        if not lead:
            inner[words.bounds[:-1][words.counts() > 0]] = False
        words.starts = words.starts - inner
        words.sizes = words.sizes + inner
        return words, whole

    def batch(self, texts: pa.Array, lead: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, as unsigned 32-bit integers, and the bounds of each.

        With ``lead`` every text is encoded with one blank before it.
        """
        if lead:
            texts = pc.binary_join_element_wise(pa.scalar(" "), texts.fill_null(""), "")
        words, whole = self._spans(texts, lead)
        counts = words.counts()
        keep = np.repeat(~whole, counts)
        starts, sizes = words.starts[keep], words.sizes[keep]
        keys, first, slot = np.unique(span_hashes(words.body, starts, sizes), return_index=True, return_inverse=True)
        found = self._runs(keys, words, starts[first], sizes[first])
        as_is = [self.whole(texts[i].as_py() or "") for i in np.flatnonzero(whole).tolist()]
        # Each text is a run of slots: its words, or itself as a whole.
        runs = np.where(whole, 1, counts)
        slots = np.empty(int(runs.sum()), np.int64)
        as_whole = np.repeat(whole, runs)
        slots[~as_whole] = slot
        slots[as_whole] = len(keys) + np.arange(len(as_is))
        lengths = np.concatenate([found.sizes, np.fromiter(map(len, as_is), np.int64, len(as_is))]).astype(np.int64)
        pool = np.concatenate([found.pool, np.fromiter(chain.from_iterable(as_is), np.uint32)])
        heads = np.concatenate([found.heads, len(found.pool) + np.cumsum(lengths[len(keys):]) - lengths[len(keys):]])
        flat = pool[spread_runs(heads[slots], lengths[slots])]
        ends = np.concatenate([[0], np.cumsum(lengths[slots])])
        return flat, ends[np.concatenate([[0], np.cumsum(runs)])]


def tokenizer_path(name: str) -> str:
    """Where an installed public tokenizer file lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)
