"""Public tokenizers in tasks: loaded once a worker, with the pieces of frequent words kept."""

from __future__ import annotations

import os
from functools import cache
from itertools import islice

import numpy as np

from .blocks import distinct_spans, unicode_spaces, word_spans

#: Words kept in a worker's memory, at some 200 bytes each: those that came up again, and those lately seen once.
KEPT, LATELY = 200_000, 100_000


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_pieces(path: str, texts: list[str]) -> np.ndarray:
    """How many tokens the library gives for each text, without special tokens added."""
    if path.endswith(".model"):
        return np.array([len(x) for x in _sentencepiece(path).encode(texts, num_threads=1)], np.int64)
    return np.array([len(x) for x in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)], np.int64)


@cache
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class _Words:
    """A worker's ids of words: those that came up more than once stay, up to KEPT, and the last ones seen once, in two
    generations of LATELY or so."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.kept: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.kind = np.dtype("<u2" if len(vocabulary) < 65536 else "<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a pre-token
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def together(self, words: list[str], each: int = 1000) -> list[bytes]:
        """Words of letters alone, each one pre-token, many in one text; apart again where a token ends a pre-token."""
        out: list[bytes] = []
        for i in range(0, len(words), each):
            some = words[i : i + each]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(self.closes[ids]) + 1) * self.kind.itemsize
            if len(ends) != len(some):  # a letter that lower case makes more than a letter of
                out += self.one_by_one(some)
                continue
            raw, begin = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[begin:end])
                begin = end
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """The library's ids. ASCII capitals in a word of letters are as lower case."""
        plain = [w.lower() if w.isascii() and w.isalpha() else w for w in words]
        distinct = list(dict.fromkeys(plain))
        ids = {w: x for w in distinct if (x := self.kept.get(w) or self.recent.get(w) or self.older.get(w))}
        letters = [w for w in distinct if w.isalpha() and w not in ids]
        others = [w for w in distinct if not w.isalpha() and w not in ids]
        ids |= zip(letters, self.together(letters), strict=True)
        ids |= zip(others, self.one_by_one(others), strict=True)
        return [ids[w] for w in plain]

    def of(self, words: list[str], often: np.ndarray) -> list[bytes]:
        """The ids of each of these distinct words; often: whether it came up more than once."""
        kept, recent, older = self.kept, self.recent, self.older
        ids = [kept.get(w) or recent.get(w) or older.get(w) for w in words]
        if len(kept) < KEPT:
            kept.update(islice(((w, x) for w, x in zip(words, ids, strict=True) if x is not None), KEPT - len(kept)))
        new = [i for i, x in enumerate(ids) if x is None]
        found = self.encode([words[i] for i in new])
        for i, x in zip(new, found, strict=True):
            ids[i] = x
        if len(recent) > LATELY:
            self.older, self.recent = recent, {}
        self.recent.update((words[i], x) for i, x in zip(new, found, strict=True))
        if len(kept) < KEPT:
            often = often[new]
            kept.update(islice(((words[i], x) for i, x, o in zip(new, found, often.tolist(), strict=True) if o), KEPT - len(kept)))
        return ids


@cache
def _words(path: str) -> _Words:
    return _Words(path)


_MARK = np.zeros(256, bool)  # ASCII punctuation, without what contractions and special strings are made of
_MARK[[ord(x) for x in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True


def _apart(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Takes the punctuation at a word's end off a letter before it, of ASCII or Latin with accents: such marks are one
    pre-token of their own. (Not after U+0130, which lower case makes a letter and a mark.)"""
    at = np.flatnonzero(_MARK[raw[ends - 1]])
    cut, first = ends[at], starts[at]
    moving = np.arange(len(at))
    while len(moving):
        moving = moving[_MARK[raw[cut[moving] - 1]]]
        cut[moving] -= 1
        moving = moving[cut[moving] > first[moving]]
    at, cut = at[cut > first], cut[cut > first]
    last = raw[cut - 1]
    low = last | 32
    letter = (last < 128) & (low >= 97) & (low <= 122)
    lead = np.where(cut - starts[at] > 1, raw[cut - 2], 0)
    letter |= (last >= 128) & (((lead == 0xC4) & (last != 0xB0)) | (lead == 0xC5) | ((lead == 0xC3) & (last != 0x97) & (last != 0xB7)))
    at, cut = at[letter], cut[letter]
    shorter = ends.copy()
    shorter[at] = cut
    return np.sort(np.append(starts, cut)), np.sort(np.append(shorter, ends[at]))


def encode_words(path: str, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts (UTF-8 end to end, and their offsets) end to end, and the offsets of each text's ids, for a
    tokenizer that drops white space: ids are those of the words between white space, one after another. Each distinct
    word of a call is looked up once; the library gives the ids of those not yet known."""
    state = _words(path)
    starts, ends = _apart(raw, *word_spans(raw, at, unicode_spaces(raw))[:2])
    word_at = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, state.kind), np.zeros(len(at), np.int64)
    first, number, _ = distinct_spans(raw, starts, ends)
    times = np.bincount(number)
    text = raw.tobytes()
    ids = state.of([text[i:j].decode() for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], times > 1)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // state.kind.itemsize
    pool, place = np.frombuffer(b"".join(ids), state.kind), np.cumsum(sizes) - sizes
    n = sizes[number]
    done = np.append(0, np.cumsum(n))
    return pool[np.repeat(place[number] - done[:-1], n) + np.arange(done[-1])], done[word_at]
