"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

from .common import memory, only

#: Words whose hashes a worker remembers: the first it meets, which are mostly common ones.
REMEMBERED = 100_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


_words = WordHashes()
memory("shingles", _words.clear)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted by hash. Words are separated by ASCII white space, A-Z lower-cased.

    A text with fewer words than a shingle, but not none, has its whole word sequence as the only one.
    """
    only("shingles")
    split = [t.lower().split() for t in texts]
    sizes = [len(s) for s in split]
    hashes = np.fromiter(map(_words.__getitem__, chain.from_iterable(split)), np.uint64, sum(sizes))
    count = max(0, len(hashes) - width + 1)
    rolled = np.full(count, width, np.uint64)
    for k in range(width):
        rolled = mix((rolled * _M1) ^ hashes[k:k + count])
    out, start = [], 0
    for words, n in zip(split, sizes):
        if n >= width:
            own = np.sort(rolled[start:start + n - width + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out
